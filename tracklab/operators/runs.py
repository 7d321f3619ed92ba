"""Runs of travel, corridors, scope flags and gating on recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.operators.asof import asof_nearest
from tracklab.plans.quantiles import quantile_columns
from tracklab.plans.segments import (
    SEGMENT_ROWS,
    bounded,
    dense_index,
    fills,
    islands,
)
from tracklab.session import stored


def detect_runs(
    df: DataFrame, keys: Sequence[str], pred: Column, min_travel: float, size: int = SEGMENT_ROWS
) -> DataFrame:
    """Maximal stretches of ``pred`` whose end-to-start change in ``y`` exceeds ``min_travel``.

    Returns one row per run: bounds ``a``..``b``, ``y_first``/``y_last``, median ``x`` and ``pass_id``.
    """
    keys = list(keys)
    marked = islands(df, keys, pred, "run_start", size=size).where(F.col("run_start").isNotNull())
    if size is not None:
        marked = stored(marked)
    runs = (
        marked.groupBy(*keys, "run_start")
        .agg(
            F.min("i").alias("a"),
            F.max("i").alias("b"),
            F.min_by("y", "i").alias("y_first"),
            F.max_by("y", "i").alias("y_last"),
            F.min("t").alias("t0"),
            F.max("t").alias("t1"),
        )
        .where(F.abs(F.col("y_last") - F.col("y_first")) > min_travel)
    )
    medians = quantile_columns(marked, [*keys, "run_start"], "x", {"x_median": 0.5})
    runs = runs.join(medians, [*keys, "run_start"])
    return dense_index(runs, keys, ["a"], "pass_id")


def chain_cluster(
    runs: DataFrame, keys: Sequence[str], gap: float = P.CORRIDOR_GAP_M, size: int = SEGMENT_ROWS
) -> DataFrame:
    """Cluster run medians along one axis and give every run its nearest cluster centre.

    A new cluster starts where the step to the previous member reaches ``gap``.
    """
    keys = list(keys)
    ranked = dense_index(runs, keys, ["x_median", "pass_id"], "_rank")
    ranked = bounded(
        ranked,
        keys,
        1,
        [lambda w: {"_new": (F.col("x_median") - F.lag("x_median").over(w) >= gap).cast("int")}],
        idx="_rank",
        size=size,
    )
    ranked = fills(
        ranked, keys, ["_rank"], sums={"_cluster": F.coalesce(F.col("_new"), F.lit(0))}, idx="_rank", size=size
    )
    centres = ranked.groupBy(*keys, "_cluster").agg(F.avg("x_median").alias("x_median"))
    centres = centres.withColumnRenamed("_cluster", "corridor")
    placed = asof_nearest(runs, centres, keys, "x_median", ["corridor"])
    return placed.withColumnRenamed("x_median_right", "centre").drop("gap")


def expect_runs(runs: DataFrame, recordings: DataFrame, enforce: bool = True) -> DataFrame:
    """Compare the run count per recording with the configured one, where one is configured."""
    n = runs.groupBy("rec").agg(F.count(F.lit(1)).alias("n_runs"))
    out = recordings.join(n, "rec", "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))
    ok = F.col("n_runs") == F.col("expected")
    out = out.withColumn("ok", ok)
    if enforce:
        broken = F.raise_error(
            F.concat(F.lit("run count differs in recording "), F.col("rec").cast("string"))
        ).cast("boolean")
        out = out.where(F.when(F.coalesce(ok, F.lit(True)), F.lit(True)).otherwise(broken))
    return out


def eligibility(df: DataFrame) -> DataFrame:
    """Stationary / headland / eligible flags from speed, run membership and contamination."""
    out = df.withColumn("stationary", F.col("speed") < P.STATIONARY_BELOW_MS)
    out = out.withColumn("headland", F.col("pass_id") < 0)
    return out.withColumn("eligible", ~F.col("headland") & ~F.col("stationary") & ~F.col("contaminated"))


def attach_runs(df: DataFrame, runs: DataFrame, keys: Sequence[str], size: int = SEGMENT_ROWS) -> DataFrame:
    """Give rows the run and corridor they fall in (-1 when in none)."""
    start = runs.select(*keys, F.col("a").alias("i"), F.struct("b", "pass_id", "corridor").alias("_run"))
    hit = df.join(start, [*keys, "i"], "left")
    hit = fills(hit, keys, ["i"], before={"_run": F.col("_run")}, size=size)
    inside = F.col("i") <= F.col("_run.b")
    return hit.withColumns(
        {
            "pass_id": F.when(inside, F.col("_run.pass_id")).otherwise(F.lit(-1)).cast("bigint"),
            "corridor": F.when(inside, F.col("_run.corridor")).otherwise(F.lit(-1)).cast("bigint"),
        }
    ).drop("_run")


def _outside() -> Column:
    return F.col("headland") & ~F.col("contaminated")


def out_of_scope(df: DataFrame) -> DataFrame:
    return df.where(_outside())


def scope(df: DataFrame, name: str) -> DataFrame:
    """``eligible`` rows, or headland rows that are not contaminated (``non_in_row``)."""
    if name == "eligible":
        return df.where("eligible")
    if name == "non_in_row":
        return out_of_scope(df)
    raise ValueError(f"unknown scope {name}")


def flank_marks(df: DataFrame, keys: Sequence[str], size: int = SEGMENT_ROWS) -> DataFrame:
    """All rows with the ``flank_category`` of those out of scope; the others get NULL."""
    corr = F.when(F.col("eligible"), F.col("corridor"))
    out = fills(df, keys, ["i"], before={"_before": corr}, after={"_after": corr}, size=size, inclusive=False)
    cat = (
        F.when(F.col("stationary"), "stationary")
        .when(F.col("_before") == F.col("_after"), "turn")
        .otherwise("transition")
    )
    return out.withColumn("category", F.when(_outside(), cat)).drop("_before", "_after")


def flank_category(df: DataFrame, keys: Sequence[str], size: int = SEGMENT_ROWS) -> DataFrame:
    """Stationary, else turn when both neighbouring eligible rows share a corridor, else transition."""
    return out_of_scope(flank_marks(df, keys, size))


def run_phase(df: DataFrame, keys: Sequence[str], pred: Column, size: int = SEGMENT_ROWS) -> DataFrame:
    """Centrality of each ``pred`` row inside its stretch of consecutive indices, and its phase."""
    out = islands(df, list(keys), pred, "_s", size=size, end="_e").where(F.col("_s").isNotNull())
    span = F.col("_e") - F.col("_s")
    at = F.when(span == 0, F.lit(0.5)).otherwise((F.col("i") - F.col("_s")) / span)
    out = out.withColumn("centrality", 1.0 - 2.0 * F.abs(at - 0.5))
    phase = (
        F.when(F.col("centrality") < P.PHASE_EDGE_BELOW, "edge")
        .when(F.col("centrality") > P.PHASE_DEEP_ABOVE, "deep")
        .otherwise("mid")
    )
    return out.withColumn("phase", phase).drop("_s", "_e")


def fit_threshold(
    df: DataFrame, keys: Sequence[str], value: str, prob: float, out: str
) -> DataFrame:
    """Percentile of ``value`` over the eligible rows of each key."""
    return quantile_columns(df.where("eligible"), keys, value, {out: prob})


def state_gate(df: DataFrame, keys: Sequence[str], size: int = SEGMENT_ROWS) -> DataFrame:
    """Keep flag: moving, along the row, and turning less than the eligible p99 heading rate."""
    limit = fit_threshold(df, keys, "heading_rate", 0.99, "turn_limit")
    out = df.join(limit, list(keys), "left")
    keep = (
        (F.col("speed") > P.STATIONARY_BELOW_MS)
        & (F.abs("vy") > P.ALONG_ROW_ABOVE_MS)
        & (F.col("heading_rate") < F.col("turn_limit"))
    )
    return out.withColumn("keep", F.coalesce(keep, F.lit(False)))


def build_manifest(series: DataFrame, min_travel: float, size: int = SEGMENT_ROWS) -> DataFrame:
    """Series with poses to frame manifest: kinematics, runs, corridors and scope flags."""
    from tracklab.operators.kinematics import kinematics

    kin = stored(kinematics(series, ["rec"], size))
    runs = detect_runs(kin, ["rec"], F.abs("vy") > P.ALONG_ROW_ABOVE_MS, min_travel, size)
    placed = chain_cluster(stored(runs), ["rec"], size=size)
    return eligibility(attach_runs(kin, placed, ["rec"], size))


def run_summary(manifest: DataFrame) -> DataFrame:
    """Per run: corridor, direction, time bounds and eligible rows."""
    inside = manifest.where("pass_id >= 0")
    g = inside.groupBy("rec", "pass_id").agg(
        F.min("corridor").alias("corridor"),
        F.min_by("y", "i").alias("y0"),
        F.max_by("y", "i").alias("y1"),
        F.min("t").alias("t0_s"),
        F.max("t").alias("t1_s"),
        F.count_if("eligible").alias("eligible"),
    )
    return g.withColumn("dir", F.when(F.col("y1") < F.col("y0"), "down").otherwise("up")).drop("y0", "y1")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Per recording: row counts by flag, runs, corridors, largest corridor share, path length."""
    per_corridor = (
        manifest.where("eligible").groupBy("rec", "corridor").agg(F.count(F.lit(1)).alias("n"))
    )
    share = per_corridor.groupBy("rec").agg(
        (100.0 * F.max("n") / F.sum("n")).alias("max_corridor_pct"), F.count(F.lit(1)).alias("n_corridors")
    )
    loose = (F.col("headland") | F.col("stationary")) & ~F.col("contaminated")
    total = manifest.groupBy("rec").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("contaminated").alias("contaminated"),
        F.count_if("stationary").alias("stationary"),
        F.count_if("headland").alias("headland"),
        F.count_if(loose).alias("loose"),
        F.count_if("eligible").alias("eligible"),
        (F.coalesce(F.max("pass_id"), F.lit(-1)) + 1).alias("n_passes"),
        F.sum("ds").alias("path_length_m"),
    )
    return total.join(share, "rec", "left")
