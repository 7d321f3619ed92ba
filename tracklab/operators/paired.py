"""Same-frame comparison of models across seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.operators.metrics import fitted

METRICS = ("offset", "heading")


def across_seed(scores: DataFrame, keys: Sequence[str], n_seeds: int = len(P.SEEDS)) -> DataFrame:
    """Frames fitted under every seed of an arm, with the seed mean of offset and heading."""
    return (
        fitted(scores)
        .groupBy(*keys, "arm", "i")
        .agg(
            F.count_distinct("seed").alias("_n"),
            *[F.avg(m).alias(m) for m in METRICS],
        )
        .where(F.col("_n") == n_seeds)
        .drop("_n")
    )


def _pairs(per_arm: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    wide = per_arm.groupBy(*keys, "i").agg(
        *[F.max(F.when(F.col("arm") == a, F.struct(*metrics))).alias(f"_{a}") for a in P.ARMS]
    )
    made = []
    for n, (a, b) in enumerate(P.PAIRS):
        diffs = [(F.col(f"_{a}.{m}") - F.col(f"_{b}.{m}")).alias(f"d_{m}") for m in metrics]
        both = F.col(f"_{a}").isNotNull() & F.col(f"_{b}").isNotNull()
        made.append(F.when(both, F.struct(F.lit(f"{a}-{b}").alias("pair"), F.lit(n).alias("pair_no"), *diffs)))
    rows = wide.select(*keys, "i", F.explode(F.array_compact(F.array(*made))).alias("_p"))
    return rows.select(*keys, "i", "_p.*")


def paired_frames(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per frame and arm pair: difference of seed means, where both arms are fitted in all seeds."""
    return _pairs(across_seed(scores, keys), keys, METRICS)


def paired_frames_per_seed(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per frame, seed and arm pair: difference where both arms are fitted under that seed."""
    return _pairs(fitted(scores), [*keys, "seed"], METRICS)


def long_metrics(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per metric; ``floor`` is the instrument floor the difference is compared with."""
    stacked = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"d_{m}").alias("v")) for m in METRICS])
    ).alias("_m")
    return pairs.select(*keys, "pair", "pair_no", "i", stacked).select(
        *keys, "pair", "pair_no", "i", "_m.metric", "_m.v"
    )


def floor_of() -> Column:
    """Instrument floor for (metric, pair)."""
    c = F.when(F.col("metric") == "offset", F.lit(P.OFFSET_FLOOR_M))
    for a, b in P.PAIRS:
        c = c.when(F.col("pair") == f"{a}-{b}", F.lit((P.HEADING_FLOOR_DEG[a] + P.HEADING_FLOOR_DEG[b]) / 2))
    return c


def sign_of(c: Column) -> Column:
    return F.when(c > 0, "+").when(c < 0, "-").otherwise("0")


def paired_diff(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean difference, its sign and its size relative to the floor."""
    out = long.groupBy(*keys, "pair", "pair_no", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_diff")
    )
    return out.withColumns(
        {"sign": sign_of(F.round("mean_diff", 12)), "pct_floor": 100.0 * F.col("mean_diff") / floor_of()}
    )


def sign_consistency(per_seed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signs in seed order and whether they all agree; one entry per seed."""
    listed = F.array_sort(F.collect_list(F.struct("seed", "sign")))
    out = per_seed.groupBy(*keys, "pair", "metric").agg(listed.alias("_s"))
    signs = F.transform("_s", lambda s: s.sign)
    return out.select(
        *keys,
        "pair",
        "metric",
        F.array_join(signs, " ").alias("signs"),
        (F.size(F.array_distinct(signs)) == 1).alias("consistent"),
    )
