"""Greedy thinning of rows by distance, over successor pointers.

A row is kept when it lies at least ``ds`` from the row kept before it. Which row would follow a kept one, its successor,
depends on that row alone, so the walk is a path through fixed pointers and need not be taken row by row:

* a key is cut into segments of bounded length. Within one, every row finds its successor, and the row at which a
  path from it leaves the segment (its exit);
* only rows that some path may leave by are carried on: exits of rows that are successors themselves, and that of the first
  row. Each looks for its successor in the segments after its own, 1, 2, 4, ... at a time, which gives an
  edge from exit to exit; exits met for the first time look on in turn;
* edges are doubled until the path from the key's first row is known; every segment on it then learns the row by which it
  is entered, and marks its kept rows.

No step needs a whole key: tasks hold one segment, and the edges are a few rows per segment.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab import params as P
from tracklab.plans.segments import SEG, SEGMENT_ROWS, segment_of
from tracklab.session import stored

AT = "_at"
#: Rows of a stretch: an exit is looked for in later stretches round by round, so one should hold several kept rows.
STRETCH_ROWS = 16 * SEGMENT_ROWS


def successors(xy: np.ndarray, ds: float) -> np.ndarray:
    """For every row the first later one at least ``ds`` away, or -1."""
    n = len(xy)
    found = np.full(n, -1)
    seeking, step = np.arange(n - 1), 1
    while seeking.size:
        far = np.sqrt(((xy[seeking + step] - xy[seeking]) ** 2).sum(axis=1)) >= ds
        found[seeking[far]] = seeking[far] + step
        step += 1
        seeking = seeking[~far]
        seeking = seeking[seeking + step < n]
    return found


def exits(found: np.ndarray) -> np.ndarray:
    """The last row of the path from every row, by doubling the pointers."""
    last = np.where(found < 0, np.arange(found.size), found)
    while not np.array_equal(last, further := last[last]):
        last = further
    return last


def _segments(df: DataFrame, keys: Sequence[str], idx: str, coords: Sequence[str], size: int) -> DataFrame:
    """One row per key and segment: its rows in order."""
    row = F.struct(F.col(idx).cast("long").alias("at"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(coords)])
    return df.select(*keys, segment_of(idx, size).alias(SEG), row.alias("r")).groupBy(*keys, SEG).agg(F.array_sort(F.collect_list("r")).alias("rows"))


def _unpack(column: pa.ListArray, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    one = column[k].values
    fields = [np.asarray(one.field(j).to_numpy(zero_copy_only=False), np.float64) for j in range(1, dims + 1)]
    return np.asarray(one.field(0)), np.stack(fields, axis=1)


class _Rows:
    """Output rows of one batch: pointers into its key columns, and value columns."""

    def __init__(self, batch: pa.RecordBatch, names: Sequence[str]):
        self.batch, self.names, self.source, self.values = batch, list(names), [], []

    def add(self, k: int, *columns: np.ndarray) -> None:
        self.source.append(np.full(len(columns[0]), k))
        self.values.append(columns)

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.source:
            taken = pa.array(np.concatenate(self.source))
            made = [self.batch.column(c).take(taken) for c in self.names]
            made += [pa.array(np.concatenate(v)) for v in zip(*self.values)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, schema)], names=schema.names)


def _mapped(df: DataFrame, fields: Sequence[T.StructField], keep: Sequence[str], work) -> DataFrame:
    """Run ``work(batch, k, rows)`` on every row ``k``; columns ``keep`` lead every output row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*[df.schema[c] for c in keep], *fields])
    schema, names = to_arrow_schema(out), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(batch, names)
            for k in range(batch.num_rows):
                work(batch, k, rows)
            yield from rows.batches(schema)

    return df.mapInArrow(run, out)


def _fields(dims: int, *names: str) -> list[T.StructField]:
    return [*[T.StructField(n, T.LongType()) for n in names], *[T.StructField(f"c{k}", T.DoubleType()) for k in range(dims)]]


def _candidates(segments: DataFrame, keys: Sequence[str], dims: int, ds: float) -> DataFrame:
    """Exits of rows that are successors within their segment; the first row's exit is marked as a possible root."""

    def work(batch: pa.RecordBatch, k: int, rows: _Rows) -> None:
        at, xy = _unpack(batch.column("rows"), k, dims)
        found = successors(xy, ds)
        last = exits(found)
        leave = np.unique(last[np.unique(found[found >= 0])])
        leave = np.append(leave, last[0])
        root = np.append(np.full(leave.size - 1, -1), at[0])
        rows.add(k, at[leave], root, *[xy[leave, j] for j in range(dims)])

    return _mapped(segments, _fields(dims, AT, "first_at"), [*keys, SEG], work)


def _entries(segments: DataFrame, seeking: DataFrame, keys: Sequence[str], dims: int, ds: float) -> DataFrame:
    """For every seeking row and segment it looks into: the row by which it enters and the exit from there, if any."""
    asked = seeking.groupBy(*keys, F.col("target").alias(SEG)).agg(F.array_sort(F.collect_list(F.struct(AT, *[f"c{k}" for k in range(dims)]))).alias("asked"))

    def work(batch: pa.RecordBatch, k: int, rows: _Rows) -> None:
        at, xy = _unpack(batch.column("rows"), k, dims)
        who, where = _unpack(batch.column("asked"), k, dims)
        enter = np.full(len(who), -1)
        for n, place in enumerate(where):
            far = np.sqrt(((xy - place) ** 2).sum(axis=1)) >= ds
            if far.any():
                enter[n] = far.argmax()
        some = enter >= 0
        if some.any():
            leave = exits(successors(xy, ds))[enter[some]]
            rows.add(k, who[some], at[enter[some]], at[leave], *[xy[leave, j] for j in range(dims)])

    return _mapped(segments.join(asked, [*keys, SEG]), _fields(dims, AT, "enter_at", "leave_at"), [*keys, SEG], work)


def _edges(segments: DataFrame, known: DataFrame, keys: Sequence[str], dims: int, ds: float) -> DataFrame:
    """(key, row, segment, enter_at, leave_at): where the path from an exit goes on, for all exits that may be met."""
    place = [f"c{k}" for k in range(dims)]
    ends = segments.groupBy(*keys).agg(F.max(SEG).alias("last"))
    seeking = known.select(*keys, AT, *place, F.col(SEG).alias("from"), F.lit(1).cast("long").alias("width")).join(ends, list(keys)).where(F.col("from") < F.col("last"))
    known, edges = known.select(*keys, AT), None
    seeking = stored(seeking)
    while not seeking.isEmpty():
        looked = seeking.withColumn("target", F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + F.col("width"), "last"))))
        nearest = F.min_by(F.struct(SEG, "enter_at", "leave_at", *place), SEG).alias("met")
        met = stored(_entries(segments, looked, keys, dims, ds).groupBy(*keys, AT).agg(nearest).select(*keys, AT, "met.*"))
        edges = met.select(*keys, AT, SEG, "enter_at", "leave_at") if edges is None else edges.unionByName(met.select(*keys, AT, SEG, "enter_at", "leave_at"))
        new = met.select(*keys, F.col("leave_at").alias(AT), *place, F.col(SEG).alias("from"), F.lit(1).cast("long").alias("width")).dropDuplicates([*keys, AT])
        new = new.join(known, [*keys, AT], "left_anti").join(ends, list(keys))
        on = seeking.join(met.select(*keys, AT), [*keys, AT], "left_anti").withColumns({"from": F.col("from") + F.col("width"), "width": 2 * F.col("width")})
        seeking = stored(on.unionByName(new))
        known = stored(known.unionByName(seeking.select(*keys, AT)).distinct())
        seeking = seeking.where(F.col("from") < F.col("last"))
    return edges


def _on_path(roots: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exits that the path from the roots meets: edges are doubled until no path is as long."""
    reached, jump = roots, edges.select(*keys, AT, F.col("leave_at").alias("to"))
    while True:
        step = stored(jump.join(reached, [*keys, AT]).select(*keys, F.col("to").alias(AT)))
        if step.isEmpty():
            return reached
        reached = stored(reached.unionByName(step))
        beyond = jump.select(*keys, F.col(AT).alias("to"), F.col("to").alias("beyond"))
        jump = stored(jump.join(beyond, [*keys, "to"]).select(*keys, AT, F.col("beyond").alias("to")))


def greedy(df: DataFrame, keys: Sequence[str], idx: str, coords: Sequence[str], ds: float, size: int = STRETCH_ROWS) -> DataFrame:
    """(key, ``idx``) of the kept rows; the first row of a key is kept. ``idx`` is a whole number, once per key.

    A row without a position is never far from another, and kept only as the first of its key, which then keeps no other.
    """
    dims, keys = len(coords), list(keys)
    segments = stored(_segments(df, keys, idx, coords, size))
    known = stored(_candidates(segments, keys, dims, ds))
    head = F.min(F.when(F.col("first_at") >= 0, F.struct(SEG, "first_at", AT))).alias("head")
    heads = known.groupBy(*keys).agg(head).select(*keys, "head.*")
    # Exits of a segment's first row count only in the key's first segment.
    firsts = heads.select(*keys, F.col(SEG).alias("_first"))
    held = known.join(firsts, keys).where((F.col("first_at") < 0) | (F.col(SEG) == F.col("_first"))).drop("_first", "first_at").dropDuplicates([*keys, AT])
    edges = _edges(segments, held, keys, dims, ds)
    enter = heads.select(*keys, SEG, F.col("first_at").alias("enter_at"))
    if edges is not None:
        path = _on_path(heads.select(*keys, AT), edges, keys)
        enter = enter.unionByName(edges.join(path, [*keys, AT]).select(*keys, SEG, "enter_at"))

    def work(batch: pa.RecordBatch, k: int, rows: _Rows) -> None:
        at, xy = _unpack(batch.column("rows"), k, dims)
        found, kept = successors(xy, ds), []
        here = int(np.searchsorted(at, batch.column("enter_at")[k].as_py()))
        while here >= 0:
            kept.append(here)
            here = found[here]
        rows.add(k, at[kept])

    kept = _mapped(segments.join(enter, [*keys, SEG]), _fields(0, "kept_at"), keys, work)
    return kept.withColumnRenamed("kept_at", idx)


def greedy_subsample(eligible: DataFrame, keys: Sequence[str], ds: float = P.SUBSAMPLE_M, size: int = STRETCH_ROWS) -> DataFrame:
    """Planar distance over all eligible rows of a recording, across runs."""
    return greedy(eligible, keys, "i", ["x", "y"], ds, size)


def greedy_arc(placed: DataFrame, keys: Sequence[str], ds: float = P.SUBSAMPLE_M, size: int = STRETCH_ROWS) -> DataFrame:
    """Distance along the run."""
    return greedy(placed, keys, "i", ["pos"], ds, size)
