"""Exact interpolated percentiles whose state never grows with the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklab.session import stored

#: Relative accuracy of the sketch that brackets a wanted rank; about ``4 / ACCURACY`` of a group's rows fall in the bracket.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Linear-interpolation percentiles as rows ``(*keys, p, q)``.

    ``F.percentile`` keeps every distinct value of a group in one task.  Here a sketch of bounded size brackets each wanted
    rank between two values of the group, whatever their spread.  Rows below a bracket are only counted; rows inside are
    merged by value and looked at exactly.
    """
    keys = list(keys)
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    wide = 2.0 / accuracy
    ends = [min(1.0, max(0.0, p + d)) for p in probs for d in (-wide, wide)]
    span = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    pos = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    few = F.col("_n") <= 4 * accuracy  # the bracket would not reach the neighbouring ranks; it takes these few rows whole
    bracket = [
        F.struct(
            F.lit(float(p)).alias("p"),
            pos[k].alias("pos"),
            F.when(F.lit(p - wide <= 0.0) | few, F.col("_min")).otherwise(F.col("_e")[2 * k]).alias("lo"),
            F.when(F.lit(p + wide >= 1.0) | few, F.col("_max")).otherwise(F.col("_e")[2 * k + 1]).alias("hi"),
        )
        for k, p in enumerate(probs)
    ]
    wanted = stored(span.select(*keys, F.array(*bracket).alias("_w")))
    near = base.join(wanted, keys)
    below = near.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col("_w")[k]["lo"]).alias(f"_b{k}") for k in range(len(probs))])
    skips = below.select(*keys, F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"_b{k}").alias("skip")) for k, p in enumerate(probs)])).alias("_s")).select(*keys, "_s.*")
    inside = F.filter("_w", lambda w: (F.col("_v") >= w["lo"]) & (F.col("_v") <= w["hi"]))
    held = near.select(*keys, "_v", F.explode(inside).alias("_w")).select(*keys, "_v", "_w.p", "_w.pos")
    merged = held.groupBy(*keys, "p", "pos", "_v").agg(F.count(F.lit(1)).alias("_m")).join(skips, [*keys, "p"])
    upto = Window.partitionBy(*keys, "p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("_end", F.col("skip") + F.sum("_m").over(upto))
    low, high = F.floor("pos"), F.ceil("pos")
    holds = lambda rank: (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_m"))
    frac = F.col("pos") - low
    # Between equal values nothing is interpolated: the two shares of a value need not add up to it.
    share = F.when(holds(low) & holds(high), 1.0).when(holds(low), 1 - frac).otherwise(frac)
    part = share * F.col("_v")
    return merged.where(holds(low) | holds(high)).groupBy(*keys, "p").agg(F.sum(part).alias("q"))


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """One row per key with a column per named percentile."""
    rows = exact_quantiles(stored(df.select(*keys, value)), keys, value, sorted(set(named.values())), accuracy)
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(name) for name, p in named.items()]
    )
