"""Per-model scores, out-of-row behaviour and rejection rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklab import params as P

CLASSES = ("two_row", "single_row", "none", "fitfail")


def fitted(scores: DataFrame) -> DataFrame:
    """Rows that carry a usable fit."""
    return scores.where((F.col("cls") == "two_row") & F.col("offset").isNotNull() & F.col("heading").isNotNull())


def rms(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sqrt(F.avg(c * c))


def pct(cond: Column) -> Column:
    """Share of rows in percent; NULL conditions count as false."""
    return 100.0 * F.avg(F.when(cond, 1.0).otherwise(0.0))


def class_mix(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    shares = [pct(F.col("cls") == c).alias(f"{c}_pct") for c in CLASSES]
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *shares)


def class_mix_across_seeds(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = class_mix(scores, [*keys, "seed"])
    cols = []
    for c in CLASSES:
        cols += [F.avg(f"{c}_pct").alias(f"{c}_mean"), F.stddev_pop(f"{c}_pct").alias(f"{c}_sd")]
    return per.groupBy(*keys).agg(*cols)


def model_metrics(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    fit = (F.col("cls") == "two_row") & F.col("offset").isNotNull() & F.col("heading").isNotNull()
    off, hdg, mc = (F.when(fit, F.col(c)) for c in ("offset", "heading", "mc"))
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count(off).alias("n_fit"),
        rms(off).alias("offset_rms"),
        F.avg(off).alias("offset_mean"),
        rms(hdg).alias("heading_rms"),
        F.avg(hdg).alias("heading_mean"),
        F.avg(mc).alias("mc_mean"),
        F.degrees(F.atan(F.avg(mc))).alias("tilt_deg"),
        F.avg("n_base").alias("mean_base"),
    )


def gap_distribution(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class shares and driven-path error per arm and category, and over all categories (``ALL``)."""
    fit = (F.col("cls") == "two_row") & F.col("offset").isNotNull() & F.col("heading").isNotNull()
    shares = [pct(F.col("cls") == c).alias(f"{c}_pct") for c in CLASSES]
    keys = list(keys)
    grouped = scored.groupingSets(
        [[F.col(k) for k in [*keys, "category"]], [F.col(k) for k in keys]], *keys, "category"
    ).agg(
        F.grouping("category").alias("_all"),
        F.count(F.lit(1)).alias("n"),
        *shares,
        F.count(F.when(fit, 1)).alias("two_row_n"),
        rms(F.when(fit, F.col("offset"))).alias("offset_rms"),
        rms(F.when(fit, F.col("heading"))).alias("heading_rms"),
    )
    label = F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category"))
    return grouped.withColumn("category", label).drop("_all")


def geometry_rules(df: DataFrame) -> DataFrame:
    """Which of the four plausibility rules fire on a fitted row, and whether any does."""
    out = df.withColumns(
        {
            "r_offset": F.abs("offset") > P.FILTER_OFFSET_M,
            "r_heading": F.abs("heading") > P.FILTER_HEADING_DEG,
            "r_parallel": F.abs(F.col("mL") - F.col("mR")) > P.FILTER_PARALLEL,
            "r_points": F.col("n_base") < P.FILTER_MIN_POINTS,
        }
    )
    return out.withColumn("filter_reject", F.expr("r_offset OR r_heading OR r_parallel OR r_points"))


def rejection_rates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share rejected by the state gate, by the geometry filter and by either, per group and overall."""
    keys = list(keys)
    grouped = rows.groupingSets(
        [[F.col(k) for k in [*keys, "category"]], [F.col(k) for k in keys]], *keys, "category"
    ).agg(
        F.grouping("category").alias("_all"),
        F.count(F.lit(1)).alias("n"),
        pct(F.col("gate_reject")).alias("gate_pct"),
        pct(F.col("filter_reject")).alias("filter_pct"),
        pct(F.col("gate_reject") | F.col("filter_reject")).alias("either_pct"),
    )
    label = F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category"))
    return grouped.withColumn("category", label).drop("_all")


RULES = ("offset", "heading", "parallel", "points")


def rejection_mechanism(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Filter rejection by run phase, and each rule's share among the rejected rows."""
    rej = F.col("filter_reject")
    by_phase = []
    for ph in ("edge", "mid", "deep"):
        here = F.col("phase") == ph
        by_phase += [
            F.count_if(here).alias(f"{ph}_n"),
            (100.0 * F.count_if(here & rej) / F.greatest(F.count_if(here), F.lit(1))).alias(f"{ph}_pct"),
        ]
    by_rule = [
        (100.0 * F.count_if(rej & F.col(f"r_{r}")) / F.greatest(F.count_if(rej), F.lit(1))).alias(f"{r}_fire_pct")
        for r in RULES
    ]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pct(rej).alias("rejection_pct"), *by_phase, *by_rule
    )


def rule_overlap(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share per rule, their sum, the share of the union, and the overlap saved."""
    marg = {r: pct(F.col(f"r_{r}")).alias(f"{r}_pct") for r in RULES}
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *marg.values(), pct(F.col("filter_reject")).alias("union_pct")
    )
    total = sum((F.col(f"{r}_pct") for r in RULES[1:]), F.col(f"{RULES[0]}_pct"))
    out = out.withColumn("sum_pct", total)
    return out.withColumn("saved_pp", F.col("sum_pct") - F.col("union_pct"))


def predicate_addendum(frames: DataFrame, yaw: str, floor: str, limit: str) -> DataFrame:
    """What an extra turn predicate would reject beyond the speed floor, in and out of the rows."""
    only = (F.col("vx") > F.col(floor)) & (F.abs(yaw) >= F.col(limit))
    outside = F.col("headland") & ~F.col("contaminated")
    return frames.groupBy("rec").agg(
        F.max(limit).alias("turn_limit"),
        F.count_if(only & outside).alias("added_rejections"),
        F.count_if(only & F.col("eligible")).alias("added_false_positives"),
    )
