"""Confusion metrics, per-image statistics, histograms and cross-recording summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.operators.lookups import top_n
from tracklab.plans.quantiles import quantile_columns
from tracklab.plans.segments import SEGMENT_ROWS


def confusion(rows: DataFrame, keys: Sequence[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Counts of the four outcomes, pooled over all rows of a key."""
    t, p = F.col(truth), F.col(pred)
    return rows.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")
    )


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """Ratios of pooled counts; NULL where a denominator is empty, and left out of the mean IoU."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns(
        {
            "iou_fg": F.try_divide(tp, tp + fp + fn),
            "iou_bg": F.try_divide(tn, tn + fp + fn),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
    )
    both = F.coalesce(F.col("iou_fg"), F.lit(0.0)) + F.coalesce(F.col("iou_bg"), F.lit(0.0))
    n = F.col("iou_fg").isNotNull().cast("int") + F.col("iou_bg").isNotNull().cast("int")
    return out.withColumn("miou", F.try_divide(both, n))


METRICS = ("iou_fg", "iou_bg", "precision", "recall", "f1")


def frame_metrics_by_stratum(per_frame: DataFrame, stratum: str) -> DataFrame:
    """Mean of the per-frame metrics per stratum and over all frames."""
    g = per_frame.rollup(stratum).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in METRICS])
    return g.withColumn(stratum, F.coalesce(stratum, F.lit("ALL")))


def pairwise_overlap(members: DataFrame, keys: Sequence[str], set_id: str, element: str) -> DataFrame:
    """IoU, mutual coverage and centroid distance of every pair of sets sharing an element.

    Sets meet through their elements; an element lists each set once and the number of sets is the number
    of compared models.
    """
    keys = list(keys)
    size = members.groupBy(*keys, set_id).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )
    held = members.groupBy(*keys, element).agg(F.array_sort(F.collect_set(set_id)).alias("_s"))
    pairs = F.flatten(
        F.transform("_s", lambda a: F.transform(F.filter("_s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    both = held.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")
    both = both.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("inter"))
    for side in ("a", "b"):
        cols = [F.col(c).alias(f"{c}_{side}") for c in ("n", "cx", "cy")]
        both = both.join(size.select(*keys, F.col(set_id).alias(side), *cols), [*keys, side])
    return both.select(
        *keys,
        "a",
        "b",
        (F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))).alias("iou"),
        (F.col("inter") / F.col("n_a")).alias("a_in_b"),
        (F.col("inter") / F.col("n_b")).alias("b_in_a"),
        F.hypot(F.col("cx_a") - F.col("cx_b"), F.col("cy_a") - F.col("cy_b")).alias("centroid_dist"),
    )


def overlap_summary(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.min("iou").alias("iou_min"), F.max("iou").alias("iou_max"), F.avg("iou").alias("iou_mean")
    )


def class_stats(instances: DataFrame, image: Sequence[str], classes: dict[int, str]) -> DataFrame:
    """Per image and class: instances, area, position, and side split by instance centroid."""
    aggs = []
    left = F.col("cx") < P.MID_PX
    for cid, name in classes.items():
        here = F.col("cls") == cid
        aggs += [
            F.count_if(here).alias(f"{name}_instances"),
            F.coalesce(F.sum(F.when(here, F.col("area"))), F.lit(0.0)).alias(f"{name}_area"),
            F.avg(F.when(here, F.col("cx"))).alias(f"{name}_mean_x"),
            F.stddev_pop(F.when(here, F.col("cx"))).alias(f"{name}_std_x"),
            F.count_if(here & left).alias(f"{name}_left"),
            F.count_if(here & ~left).alias(f"{name}_right"),
        ]
    out = instances.groupBy(*image).agg(*aggs)
    ge3 = {f"{n}_{s}_ge3": F.col(f"{n}_{s}") >= P.MIN_POINTS for n in classes.values() for s in ("left", "right")}
    return out.withColumns(ge3)


def histogram_fixed(rows: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins over [low, high]; the last bin includes its upper edge; empty bins are listed."""
    keys = list(keys)
    v = F.col(value)
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    got = rows.where((v >= low) & (v <= high)).groupBy(*keys, b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per_key = got.groupBy(*keys).agg(F.sum("n").alias("_t"))
    grid = per_key.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return grid.join(got, [*keys, "bin"], "left").na.fill(0, ["n"])


def viability(stats: DataFrame, by: str) -> DataFrame:
    """Share of images with at least three structures per side, alone and combined, per group and overall."""
    k = P.MIN_POINTS
    t_l, t_r, p_l, p_r = (F.col(c) for c in ("trunk_left", "trunk_right", "pole_left", "pole_right"))
    trunk, pole = (t_l >= k) & (t_r >= k), (p_l >= k) & (p_r >= k)
    comb = (t_l + p_l >= k) & (t_r + p_r >= k)

    def share(c: Column) -> Column:
        return 100.0 * F.avg(c.cast("int"))

    g = stats.rollup(by).agg(
        F.count(F.lit(1)).alias("n"),
        share(t_l >= k).alias("trunk_left_pct"),
        share(t_r >= k).alias("trunk_right_pct"),
        share(trunk).alias("trunk_both_pct"),
        share(pole).alias("pole_both_pct"),
        share(comb).alias("combined_both_pct"),
        F.count_if(~trunk).alias("n_trunk_fail"),
        F.count_if(~trunk & comb).alias("n_rescued"),
        F.avg("trunk_instances").alias("mean_trunks"),
        F.avg("pole_instances").alias("mean_poles"),
    )
    return g.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("ALL")))


def score_summary(rows: DataFrame, keys: Sequence[str], value: str, cuts: Sequence[float], size: int = SEGMENT_ROWS) -> DataFrame:
    """Distribution of a score per group and counts at cut-offs."""
    q = quantile_columns(rows, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    g = rows.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        *[F.count_if(F.col(value) >= c).alias(f"ge_{str(c).replace('.', '_')}") for c in cuts],
    )
    return g.join(q, list(keys))


def top_scores(rows: DataFrame, keys: Sequence[str], value: str, tie: str, n: int = 15) -> DataFrame:
    return top_n(rows, keys, [F.desc(value), F.asc(tie)], n)


def coverage_gaps(mix: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per recording: coverage gaps between arms with the summed spread across seeds; excluded roles are left out."""
    m = mix.join(excluded.select("rec"), "rec", "left_anti")
    wide = m.groupBy("rec").agg(
        *[F.max(F.when(F.col("arm") == a, F.struct("two_row_mean", "two_row_sd"))).alias(a) for a in P.ARMS]
    )
    out = []
    for a, b in (("B", "C"), ("A", "B")):
        diff = F.col(f"{a}.two_row_mean") - F.col(f"{b}.two_row_mean")
        sd = F.col(f"{a}.two_row_sd") + F.col(f"{b}.two_row_sd")
        out.append(
            F.struct(F.lit(f"{a}-{b}").alias("pair"), diff.alias("gap"), sd.alias("summed_sd"), (F.abs(diff) > sd).alias("separated"))
        )
    return wide.select("rec", F.explode(F.array(*out)).alias("_g")).select("rec", "_g.*")


def coverage_signs(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 0).alias("n_positive"), F.count_if("separated").alias("n_separated")
    )


def coverage_trend(cells: DataFrame, keys: Sequence[str], floor_pct: float = P.VIABLE_COVERAGE_PCT) -> DataFrame:
    """Coverage with both classes against one class, the gain in points, and the viability floor."""
    g = cells.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("cell") == c, F.col(v))).alias(n)
            for c, v, n in (
                ("agnostic", "two_row_pct", "coverage_all"),
                ("trunk_only", "two_row_pct", "coverage_trunk"),
                ("agnostic", "mean_base", "base_all"),
                ("pole_only", "mean_base", "base_pole"),
            )
        ]
    )
    return g.withColumns(
        {"gain_pp": F.col("coverage_all") - F.col("coverage_trunk"), "viable": F.col("coverage_all") >= floor_pct}
    )


def compare_versions(scored: DataFrame, new: float, old: float, key: Sequence[str]) -> DataFrame:
    """Two scorings of the same frames side by side, from one table with a row per frame and version ``win``."""
    cols = [c for c in scored.columns if c not in (*key, "win")]
    at = lambda v: F.max(F.when(F.col("win") == v, F.struct(*cols)))
    j = scored.groupBy(*key).agg(at(new).alias("_new"), at(old).alias("_old")).where("_new is not null and _old is not null")
    j = j.select(*key, "_new.*", *[F.col(f"_old.{c}").alias(f"old_{c}") for c in ("cls", "offset", "heading")])
    two, was = F.col("cls") == "two_row", F.col("old_cls") == "two_row"
    return j.withColumns(
        {
            "shifted": two & was & (F.abs(F.col("offset") - F.col("old_offset")) > 0.1),
            "turned": two & was & (F.abs(F.col("heading") - F.col("old_heading")) > 5),
            "rescued": two & ~was,
            "steep": two & ((F.abs("mL") > P.STEEP_SLOPE) | (F.abs("mR") > P.STEEP_SLOPE)),
            "mismatch": two & (F.abs(F.col("mL") - F.col("mR")) > P.SLOPE_MISMATCH),
        }
    )


def version_summary(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    two = F.col("cls") == "two_row"
    return compared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(c) for c in ("shifted", "turned", "rescued", "steep", "mismatch")],
        F.count_if(two & (F.col("adj") > 0)).alias("with_adjacent"),
    )
