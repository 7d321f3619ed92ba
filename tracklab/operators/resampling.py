"""Autocorrelation, block lengths and distributed bootstrap intervals.

Every statistic here is a function of sums (mean, RMS, differences of those).  A replicate is a set of
Poisson weights drawn from a hash of the row's identity, so workers add ``weight x value`` into one
accumulator per replicate and only those accumulators are shuffled.  Results do not depend on how rows
are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab import params as P
from tracklab.plans.segments import SEGMENT_ROWS, dense_index, fills
from tracklab.session import stored

#: Draws made at once; their arrays stay in a core's cache.
DRAWS = 1 << 15
#: Bits of a draw that look up its weight.
CELL_BITS = 12
#: Accumulators that a task holds before it sends them on; equal keys meet again after the shuffle.
HELD_BYTES = 64 << 20


def lag_autocorr(
    series: DataFrame, keys: Sequence[str], max_lag: float = P.LAG_MAX_M, bin_m: float = P.LAG_BIN_M
) -> DataFrame:
    """Autocorrelation of ``v`` against separation ``pos`` inside runs (``run``), per lag bin.

    Rows at one position are merged first (their products follow from sums), then positions within
    ``max_lag`` meet through an equi-join on distance buckets.
    """
    keys = list(keys)
    moments = series.groupBy(*keys).agg(F.avg("v").alias("_mu"), F.var_pop("v").alias("_var"))
    dev = series.join(moments, keys).withColumn("_d", F.col("v") - F.col("_mu"))
    spot = dev.groupBy(*keys, "_var", "run", "pos").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_s"), F.sum(F.col("_d") * F.col("_d")).alias("_q")
    )
    spot = stored(spot)
    same = spot.select(
        *keys,
        "_var",
        F.lit(0).cast("bigint").alias("bin"),
        ((F.col("_s") * F.col("_s") - F.col("_q")) / 2).alias("_num"),
        (F.col("_n") * (F.col("_n") - 1) / 2).cast("bigint").alias("_cnt"),
    ).where("_cnt > 0")
    own = F.floor(F.col("pos") / max_lag)
    a = spot.select(
        *keys,
        "_var",
        "run",
        F.explode(F.array(own, own + 1)).alias("_b"),
        F.col("pos").alias("_pa"),
        F.col("_n").alias("_na"),
        F.col("_s").alias("_sa"),
    )
    b = spot.select(
        *keys, "run", own.alias("_b"), F.col("pos").alias("_pb"), F.col("_n").alias("_nb"), F.col("_s").alias("_sb")
    )
    gap = F.col("_pb") - F.col("_pa")
    near = (
        a.join(b, [*keys, "run", "_b"])
        .where((gap > 0) & (gap < max_lag))
        .select(
            *keys,
            "_var",
            F.floor(gap / bin_m).alias("bin"),
            (F.col("_sa") * F.col("_sb")).alias("_num"),
            (F.col("_na") * F.col("_nb")).alias("_cnt"),
        )
    )
    n_bins = int(max_lag / bin_m)
    sums = (
        same.unionByName(near)
        .where(F.col("bin") < n_bins)
        .groupBy(*keys, "bin")
        .agg(F.sum("_num").alias("_num"), F.sum("_cnt").alias("pairs"), F.max("_var").alias("_var"))
    )
    return sums.select(*keys, "bin", "pairs", F.try_divide(F.col("_num") / F.col("pairs"), F.col("_var")).alias("ac"))


def bin_centres(max_lag: float = P.LAG_MAX_M, bin_m: float = P.LAG_BIN_M) -> list[float]:
    return [round((k + 0.5) * bin_m, 2) for k in range(int(max_lag / bin_m))]


def block_length(
    series: DataFrame, keys: Sequence[str], threshold: float = P.DECORR_THRESHOLD, fallback: float = P.DECORR_FALLBACK_M
) -> DataFrame:
    """Decorrelation distance, sample spacing and moving-block length per series."""
    keys = list(keys)
    centres = F.array(*[F.lit(c) for c in bin_centres()])
    first = lag_autocorr(series, keys).groupBy(*keys).agg(F.min(F.when(F.col("ac") < threshold, F.col("bin"))).alias("_k"))
    runs = series.groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("_n"), (F.max("pos") - F.min("pos")).alias("_span")
    )
    spacing = runs.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.coalesce(F.avg(F.when(F.col("_n") > 1, F.col("_span") / (F.col("_n") - 1))), F.lit(0.05)).alias("spacing_m"),
    )
    out = spacing.join(first, keys, "left").withColumn("decorr_m", F.get(centres, F.col("_k").cast("int")))
    block_m = 2 * F.coalesce("decorr_m", F.lit(fallback))
    return out.select(
        *keys,
        "n",
        "spacing_m",
        "decorr_m",
        block_m.alias("block_m"),
        F.greatest(F.lit(2), F.bround(F.try_divide(block_m, F.col("spacing_m")), 0)).cast("bigint").alias("L"),
        F.try_divide(F.col("decorr_m"), F.col("spacing_m")).alias("samples_per_decorr"),
    )


def ci_reliability(lengths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Longest block over the pairs (first pair on ties) and whether its sampling resolves it."""
    best = F.max_by(F.struct("L", "pair", "samples_per_decorr"), F.struct("L", -F.col("pair_no")))
    out = lengths.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
    ok = F.col("samples_per_decorr").isNull() | (F.col("samples_per_decorr") >= P.MIN_SAMPLES_PER_DECORR)
    return out.withColumn("reliable", ok)


#: Largest rate that is drawn at once. A larger one is split into equal independent parts, whose sum has the same law.
MOST_RATE = 32.0


def poisson_plan(rate: float) -> tuple[int, np.ndarray]:
    """(independent parts, cumulative probabilities of one part up to a tail of 1e-12)."""
    parts = max(1, math.ceil(rate / MOST_RATE))
    own = rate / parts
    p = cdf = math.exp(-own)
    steps = [cdf]
    while 1 - cdf > 1e-12 and p > 0:
        p *= own / len(steps)
        cdf += p
        steps.append(cdf)
    return parts, np.array(steps)


#: Modulus of the draws, a prime whose arithmetic fits 64-bit whole numbers of any engine.
PRIME = (1 << 31) - 1


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """In place: a number of equal remainder by ``PRIME``, below 2^33 + 2^31 for any x and below 2^31 + 5 if folded twice."""
    np.right_shift(x, 31, out=spare)
    x &= np.uint64(PRIME)
    x += spare


def _least(x: np.ndarray, spare: np.ndarray) -> None:
    """In place: the remainder of numbers below 2 ``PRIME``; smaller ones wrap around and stay."""
    np.subtract(x, np.uint64(PRIME), out=spare)
    np.minimum(x, spare, out=x)


def _residues(a: np.ndarray, b: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Draws below ``PRIME`` per (row, replicate): the row's line a + rep b, mixed by two fifth powers, which permute the residues."""
    a, b, reps = a.astype(np.uint64), b.astype(np.uint64), reps.astype(np.uint64)
    x = reps[None, :] * b[:, None]
    x += a[:, None]
    y, spare = np.empty_like(x), np.empty_like(x)
    _fold(x, spare)
    _fold(x, spare)
    _least(x, spare)
    for key in (a, b):
        np.multiply(x, x, out=y)
        _fold(y, spare)
        np.multiply(y, y, out=y)
        _fold(y, spare)
        _fold(y, spare)
        x *= y
        _fold(x, spare)
        x += key[:, None]
        _fold(x, spare)
        _least(x, spare)
    return x


def weight_cells(cuts: np.ndarray) -> np.ndarray:
    """Weight of all draws that share their first bits, -1 where a threshold lies among them."""
    low = np.arange(1 << CELL_BITS, dtype=np.int64) << (31 - CELL_BITS)
    high = np.minimum(low + (1 << (31 - CELL_BITS)) - 1, PRIME - 1)
    first, last = (np.searchsorted(cuts, x / PRIME) for x in (low, high))
    return np.where(first == last, first, -1).astype(np.float64)


def poisson_draws(a: np.ndarray, b: np.ndarray, reps: np.ndarray, plan: tuple[int, np.ndarray], cells: np.ndarray | None = None) -> np.ndarray:
    """Poisson weights per (row, replicate) from the row's two words: how many thresholds its uniform draw passes.

    Every part has a stream of its own. ``cells`` are the plan's ``weight_cells``.
    """
    parts, cuts = plan
    cells = weight_cells(cuts) if cells is None else cells
    total = None
    for part in range(parts):
        x = _residues((a + 48271 * part) % PRIME, b, reps)
        w = cells[(x >> np.uint64(31 - CELL_BITS)).view(np.int64)]
        open_ = np.nonzero(w < 0)
        w[open_] = np.searchsorted(cuts, x[open_] / PRIME)
        total = w if total is None else total + w
    return total


def draw_words(seed: int, identity: Sequence[str]) -> list[Column]:
    """Two numbers below ``PRIME`` from the MD5 of the seed and the row's identity; the second is not zero."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))
    word = lambda k: F.conv(F.substring(digest, k, 8), 16, 10).cast("long")
    return [(word(1) % PRIME).alias("_word1"), (1 + word(9) % (PRIME - 1)).alias("_word2")]


def replicate_sums(
    rows: DataFrame, keys: Sequence[str], identity: Sequence[str], values: Sequence[str], replicates: int, seed: int,
    rate: str | None = None,
) -> DataFrame:
    """Weighted sums per replicate: ``(*keys, rep, w, s_<value>...)``.

    Draws depend on the identity alone, not on the keys: keys that hold the same rows are drawn alike.

    ``rate`` names a column, constant within a key, with the expected number of draws per row.
    """
    keys, values = list(keys), list(values)
    src = rows.select(
        *keys,
        *[F.col(v).cast("double").alias(v) for v in values],
        *draw_words(seed, identity),
        (F.col(rate).cast("double") if rate else F.lit(1.0)).alias("_rate"),
    )
    reps = np.arange(1, replicates + 1, dtype=np.int64)
    fields = [src.schema[k] for k in keys] + [T.StructField("rep", T.IntegerType()), T.StructField("w", T.DoubleType())]
    fields += [T.StructField(f"s_{v}", T.DoubleType()) for v in values]
    out_schema = T.StructType(fields)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        plans: dict[float, tuple[tuple[int, np.ndarray], np.ndarray]] = {}
        step = max(1, DRAWS // replicates)
        for pdf in batches:
            for k, g in pdf.groupby(keys, sort=False, dropna=False):
                k = k if isinstance(k, tuple) else (k,)
                rt = float(g["_rate"].iloc[0])
                if rt not in plans:
                    plan = poisson_plan(rt)
                    plans[rt] = plan, weight_cells(plan[1])
                one, two = g["_word1"].to_numpy(), g["_word2"].to_numpy()
                vals = np.column_stack([np.ones(len(g))] + [g[v].to_numpy() for v in values])
                tot = acc.setdefault(k, np.zeros((replicates, len(values) + 1)))
                for a in range(0, len(g), step):
                    w = poisson_draws(one[a : a + step], two[a : a + step], reps, *plans[rt])
                    tot += w.T @ vals[a : a + step]
            if len(acc) * replicates * (len(values) + 1) * 8 > HELD_BYTES:
                yield from flush(acc)
                acc.clear()
        yield from flush(acc)

    def flush(acc: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
        for k, tot in acc.items():
            frame = {name: [v] * replicates for name, v in zip(keys, k)}
            frame["rep"] = np.arange(1, replicates + 1, dtype=np.int32)
            frame["w"] = tot[:, 0]
            for n, v in enumerate(values):
                frame[f"s_{v}"] = tot[:, n + 1]
            yield pd.DataFrame(frame)[[f.name for f in fields]]

    part = src.mapInPandas(partial, out_schema)
    return part.groupBy(*keys, "rep").agg(F.sum("w").alias("w"), *[F.sum(f"s_{v}").alias(f"s_{v}") for v in values])


def _interval(stats: DataFrame, keys: Sequence[str], stat: str, level: float = 95.0) -> DataFrame:
    """Percentile interval over the replicates; their number is a parameter, so groups are bounded."""
    lo = (100.0 - level) / 200.0
    q = F.percentile(stat, F.array(F.lit(lo), F.lit(1 - lo)))
    return stats.groupBy(*keys).agg(q.alias("_q")).select(*keys, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def boot_ci(
    rows: DataFrame, keys: Sequence[str], identity: Sequence[str], value: str, stat: str = "mean",
    replicates: int = 2000, seed: int = 42, min_n: int = 8,
) -> DataFrame:
    """Percentile bootstrap interval of a mean or RMS; NULL bounds below ``min_n`` rows."""
    keys = list(keys)
    src = rows.where(F.col(value).isNotNull()).withColumn("_v", F.col(value) if stat == "mean" else F.col(value) * F.col(value))
    shape = (lambda c: c) if stat == "mean" else F.sqrt
    sums = replicate_sums(src, keys, identity, ["_v"], replicates, seed).where("w > 0")
    ci = _interval(sums.withColumn("_t", shape(F.col("s__v") / F.col("w"))), keys, "_t")
    point = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), shape(F.avg("_v")).alias("point"))
    out = point.join(ci, keys, "left")
    enough = F.col("n") >= min_n
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("ci_low", "ci_high")})


def boot_table(
    rows: DataFrame, keys: Sequence[str], identity: Sequence[str], value: str, part: str, contrast: tuple[str, str],
    replicates: int = 2000, seed: int = 42,
) -> DataFrame:
    """Mean and interval of every part, and of the difference of two parts that are drawn independently.

    A row may stand in several parts, for example in an overall one. The difference is the part ``a-b``.
    """
    keys, (a, b) = list(keys), contrast
    src = rows.where(F.col(value).isNotNull())
    sums = stored(replicate_sums(src, [*keys, part], [part, *identity], [value], replicates, seed).where("w > 0"))
    mean = F.col(f"s_{value}") / F.col("w")
    at = lambda name, c: F.max(F.when(F.col(part) == name, c))
    gap = sums.groupBy(*keys, "rep").agg((at(a, mean) - at(b, mean)).alias("_t")).withColumn(part, F.lit(f"{a}-{b}"))
    ci = _interval(sums.select(*keys, part, mean.alias("_t")).unionByName(gap.select(*keys, part, "_t")), [*keys, part], "_t")
    each = src.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("point"))
    both = each.groupBy(*keys).agg(F.sum(F.when(F.col(part).isin(a, b), F.col("n"))).alias("n"), (at(a, F.col("point")) - at(b, F.col("point"))).alias("point"))
    points = each.unionByName(both.withColumn(part, F.lit(f"{a}-{b}")).select(*each.columns))
    return points.join(ci, [*keys, part], "left")


def block_sums(
    series: DataFrame, keys: Sequence[str], values: Sequence[str], size: int = SEGMENT_ROWS
) -> DataFrame:
    """Sums over every run of ``L`` consecutive entries that stays inside one run.

    ``L`` is a column, so frames cannot be literal windows: prefix sums meet their own copy ``L`` entries
    earlier through an equi-join.
    """
    part = [*keys, "run"]
    ordered = dense_index(series, part, ["pos", "i"], "_e")
    pre = fills(ordered, part, ["_e"], sums={f"_p_{v}": F.col(v) for v in values}, idx="_e", size=size)
    end = pre.select(*part, "i", "L", (F.col("_e") - F.col("L")).alias("_from"), *[f"_p_{v}" for v in values])
    start = pre.select(*part, F.col("_e").alias("_from"), *[F.col(f"_p_{v}").alias(f"_b_{v}") for v in values])
    whole = end.where("_from >= -1").join(start, [*part, "_from"], "left")
    return whole.select(
        *part, "i", "L", *[(F.col(f"_p_{v}") - F.coalesce(f"_b_{v}", F.lit(0.0))).alias(v) for v in values]
    )


def _block_reps(series, keys, values, replicates, seed, size):
    """Replicate sums over moving blocks; draws ceil(n/L) blocks on average."""
    keys = list(keys)
    blocks = block_sums(series, keys, values, size)
    draws = series.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.max("L")).alias("_draws"), F.max("L").alias("_L"))
    n_blocks = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"))
    plan = draws.join(n_blocks, keys).withColumn("_rate", F.col("_draws") / F.col("n_blocks"))
    rated = blocks.join(plan, keys)
    sums = replicate_sums(rated, keys, ["run", "i"], values, replicates, seed, "_rate").where("w > 0")
    return sums.join(plan.select(*keys, "_L", "n_blocks"), keys)


def block_ci(
    series: DataFrame, keys: Sequence[str], stat: str = "mean", replicates: int = 2000, seed: int = 42,
    size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Moving-block interval of the mean or RMS of ``v``; NULL bounds below eight blocks.

    ``series`` has ``run``, ``pos``, ``i``, ``v`` and the block length ``L`` (constant per key).
    """
    keys = list(keys)
    src = series.withColumn("_v", F.col("v") if stat == "mean" else F.col("v") * F.col("v"))
    shape = (lambda c: c) if stat == "mean" else F.sqrt
    reps = _block_reps(src, keys, ["_v"], replicates, seed, size)
    reps = reps.withColumn("_t", shape(F.greatest(F.col("s__v"), F.lit(0.0)) / (F.col("w") * F.col("_L")))
                           if stat != "mean" else F.col("s__v") / (F.col("w") * F.col("_L")))
    ci = _interval(reps.where(F.col("n_blocks") >= P.MIN_BLOCKS), keys, "_t")
    point = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("L").alias("L"), shape(F.avg("_v")).alias("point")
    )
    return point.join(ci, keys, "left")


def paired_block_ci(
    series: DataFrame, keys: Sequence[str], replicates: int = 2000, seed: int = 42, size: int = SEGMENT_ROWS
) -> DataFrame:
    """Moving-block interval of RMS(a) - RMS(b) with both sides drawn together."""
    keys = list(keys)
    src = series.withColumns({"_a": F.col("a") * F.col("a"), "_b2": F.col("b") * F.col("b")})
    reps = _block_reps(src, keys, ["_a", "_b2"], replicates, seed, size)
    den = F.col("w") * F.col("_L")
    zero = F.lit(0.0)
    t = F.sqrt(F.greatest(F.col("s__a"), zero) / den) - F.sqrt(F.greatest(F.col("s__b2"), zero) / den)
    ci = _interval(reps.where(F.col("n_blocks") >= P.MIN_BLOCKS).withColumn("_t", t), keys, "_t")
    point = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("L").alias("L"), (F.sqrt(F.avg("_a")) - F.sqrt(F.avg("_b2"))).alias("delta_rms")
    )
    return point.join(ci, keys, "left")


def ci_excludes_zero(df: DataFrame) -> DataFrame:
    hit = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    return df.withColumn("excludes_zero", F.coalesce(hit, F.lit(False)))


def all_overlap(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether all intervals of a group share ground pairwise.

    Intervals on a line overlap pairwise exactly when the largest lower bound does not exceed the
    smallest upper bound, so no pairs are formed.
    """
    return cells.groupBy(*keys).agg(
        (F.max("ci_low") <= F.min("ci_high")).alias("_o"), F.count_if(F.col("ci_low").isNull()).alias("_open")
    ).select(*keys, F.coalesce(F.col("_o") & (F.col("_open") == 0), F.lit(False)).alias("all_overlap"))


def overlaps(a_low, a_high, b_low, b_high):
    """Interval overlap; false when a bound is missing."""
    return F.coalesce((a_low <= b_high) & (b_low <= a_high), F.lit(False))
