"""Window work on long keyed series without putting a whole key into one task.

A plain ``Window.partitionBy(rec)`` sorts one recording in one task, which breaks down when one key holds a large share of
all rows. Here series are always cut into segments and work runs per (key, segment); a short key is one segment. There is
one plan for every size.

* ``bounded``    - frames of bounded reach (lag/lead, +-n rows): edge rows are copied to neighbours;
* ``fills``      - unbounded prefix sums and last/next known values: per-segment summaries, a pass
  over those (one row per key and segment), then local windows;
* ``dense_index`` - 0-based position within a key, from counts per segment.

Segments are stretches of ``SEGMENT_ROWS`` values of a dense index or, where there is none, the parts of a range partitioning
by key and order, so that no bucket width has to fit the data. Both are read more than once and checkpointed first.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklab.session import stored

#: Rows of a segment; tests set it so low that the smallest keys are cut.
SEGMENT_ROWS = int(os.environ.get("TRACKLAB_SEGMENT_ROWS", "4096"))
SEG = "_seg"
CORE = "_core"


def by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add a segment that does not decrease along ``order`` within a key: the part of a range partitioning, made fixed by a checkpoint."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order) if parts > 1 else df.coalesce(1)
    return stored(ranged.withColumn(SEG, F.spark_partition_id().cast("bigint")))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows to as many tasks as a shuffle has, for Python steps whose work is large beside their bytes: adaptive execution would merge them by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def segment_of(idx: str, size: int = SEGMENT_ROWS) -> Column:
    return F.floor(F.col(idx) / F.lit(size)).cast("bigint")


def with_segment(df: DataFrame, idx: str = "i", size: int = SEGMENT_ROWS) -> DataFrame:
    return df.withColumn(SEG, segment_of(idx, size))


def seg_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, SEG).orderBy(*order)


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "i") -> DataFrame:
    """Add the 0-based rank of each row within its key: its rank in its segment after the rows of earlier segments."""
    cut = by_range(df, keys, order)
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    skip = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip")
    sizes = (
        cut.groupBy(*keys, SEG)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(SEG).alias("_k_seg"), skip)
    )
    local = F.row_number().over(seg_window(keys, order))
    same = F.col(SEG) == F.col("_k_seg")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        cut.withColumn(out, local)
        .join(sizes, same)
        .withColumn(out, (F.col("_skip") + F.col(out) - 1).cast("bigint"))
        .drop(SEG, "_k_seg", "_skip", *[f"_k_{k}" for k in keys])
    )


def halo(
    df: DataFrame, before: int, after: int, idx: str = "i", size: int = SEGMENT_ROWS
) -> DataFrame:
    """Copy rows near a segment edge to the neighbour that needs them as context.

    Adds the segment column and a flag marking the row's own segment.  Windows over ``seg_window``
    reaching at most ``before``/``after`` rows are then exact on the flagged rows.
    """
    if size < before + after + 1:
        raise ValueError("segment is smaller than its halo")
    pos = F.col(idx) - segment_of(idx, size) * size
    own = segment_of(idx, size)
    copies = F.array_compact(
        F.array(
            own,
            F.when(pos < after, own - 1),
            F.when(pos >= size - before, own + 1),
        )
    )
    return df.withColumn(SEG, F.explode(copies)).withColumn(CORE, F.col(SEG) == segment_of(idx, size))


def core(df: DataFrame) -> DataFrame:
    """Drop the halo copies and the helper columns."""
    return df.where(F.col(CORE)).drop(SEG, CORE)


def bounded(
    df: DataFrame,
    keys: Sequence[str],
    reach: int,
    steps: Sequence[Callable[[WindowSpec], dict[str, Column]]],
    idx: str = "i",
    size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Apply successive window steps whose combined reach is at most ``reach`` rows each way."""
    out = halo(df, reach, reach, idx, max(size, 2 * reach + 1))
    w = seg_window(keys, [idx])
    for step in steps:
        out = out.withColumns(step(w))
    return core(out)


def fills(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    idx: str | None = "i",
    size: int = SEGMENT_ROWS,
    inclusive: bool = True,
    prior: dict[str, Column] | None = None,
) -> DataFrame:
    """Unbounded per-key columns along ``order``.

    ``sums``: inclusive prefix sums.  ``before``/``after``: latest/earliest non-null value at or before/
    after each row (strictly so unless ``inclusive``).  ``prior``: like ``before``, but always strictly so.  ``size`` is the extent of the dense ``idx`` per segment; with ``idx``
    ``None`` the series is cut by range.
    """
    sums, before, after, prior = sums or {}, before or {}, after or {}, prior or {}
    near = 0 if inclusive else 1
    part = [*keys, SEG]
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = w.rowsBetween(Window.unboundedPreceding, -near)
    # Spark builds a frame that shrinks anew for every row; the same rows from the end make one that grows.
    ahead = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -near)
    local = {
        **{k: F.coalesce(F.sum(v).over(upto), F.lit(0)) for k, v in sums.items()},
        **{k: F.last(v, ignorenulls=True).over(back) for k, v in before.items()},
        **{k: F.last(v, ignorenulls=True).over(ahead) for k, v in after.items()},
        **{k: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for k, v in prior.items()},
    }
    before = before | prior
    s = by_range(df, keys, order) if idx is None else stored(with_segment(df, idx, size))
    rank = F.struct(*[F.col(c) for c in order])
    edges = s.groupBy(*keys, SEG).agg(
        *[F.sum(v).alias(f"_e_{k}") for k, v in sums.items()],
        *[F.max_by(v, F.when(v.isNotNull(), rank)).alias(f"_e_{k}") for k, v in before.items()],
        *[F.min_by(v, F.when(v.isNotNull(), rank)).alias(f"_e_{k}") for k, v in after.items()],
    )
    past = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.col(SEG).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys,
        SEG,
        *[F.coalesce(F.sum(f"_e_{k}").over(past), F.lit(0)).alias(f"_c_{k}") for k in sums],
        *[F.last(f"_e_{k}", ignorenulls=True).over(past).alias(f"_c_{k}") for k in before],
        *[F.last(f"_e_{k}", ignorenulls=True).over(future).alias(f"_c_{k}") for k in after],
    )
    # Spark goes by the size of the stored file, which may be a hundredth of what its rows take in memory, and would broadcast the series itself.
    # A merge needs no more than the windows do: the same partitions in the same order.
    out = s.withColumns({f"_l_{k}": c for k, c in local.items()}).join(carried.hint("merge"), [*keys, SEG])
    out = out.withColumns(
        {k: (F.col(f"_c_{k}") + F.col(f"_l_{k}")) if k in sums else F.coalesce(f"_l_{k}", f"_c_{k}") for k in local}
    )
    return out.drop(SEG, *[f"{p}_{k}" for k in local for p in ("_l", "_c")])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    pred: Column,
    out: str = "run_start",
    idx: str = "i",
    size: int = SEGMENT_ROWS,
    end: str | None = None,
) -> DataFrame:
    """Label maximal stretches of consecutive rows with ``pred`` true by the index they start at and, as ``end``, the one they end at.

    Rows where ``pred`` is false get NULL.  ``idx`` must be dense within the key.
    """
    p = F.col("_p")
    beside = {"_prev": F.lag, "_next": F.lead} if end else {"_prev": F.lag}
    flag = bounded(
        df.withColumn("_p", F.coalesce(pred, F.lit(False))),
        keys,
        1,
        [lambda w: {k: F.coalesce(near("_p").over(w), F.lit(False)) for k, near in beside.items()}],
        idx,
        size,
    )
    before = {"_start": F.when(p & ~F.col("_prev"), F.col(idx))}
    after = {"_end": F.when(p & ~F.col("_next"), F.col(idx))} if end else {}
    got = fills(flag, keys, [idx], before=before, after=after, idx=idx, size=size)
    labels = {out: "_start", end: "_end"} if end else {out: "_start"}
    return got.withColumns({name: F.when(p, F.col(c)) for name, c in labels.items()}).drop("_p", *beside, *labels.values())


def ordered_map(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable, schema) -> DataFrame:
    """Feed whole keys, sorted, to ``fn(batches)``; a key's rows may span several Arrow batches.

    The sort is Spark's (it spills), so ``fn`` holds one running state rather than a group.
    """
    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(fn, schema)
