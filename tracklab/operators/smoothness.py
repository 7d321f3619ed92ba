"""Smoothness of command streams: delta views, hold spans, comparison across arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.operators.commands import STREAM
from tracklab.operators.metrics import rms
from tracklab.plans.quantiles import quantile_columns
from tracklab.plans.segments import SEGMENT_ROWS, bounded, dense_index, islands

MODEL = ["rec", "arm", "seed"]
VIEWS = ("inclusive", "exclusive", "hold_exit")
COLUMNS = ("omega_cmd", "omega_cmd_ramp")
# fixed values: seeds grouped for the within-arm contrast
CONTRAST_SEEDS = {"A": (), "B": (42, 43), "C": (43, 44)}


def delta_views(cmds: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Consecutive command pairs inside a pass, labelled by which of the two rows were fresh."""

    def pair(w):
        nxt = {c: F.lead(c).over(w) - F.col(c) for c in COLUMNS}
        return {
            "gap": F.lead("t").over(w) - F.col("t"),
            "_nf": F.lead("fresh").over(w),
            **{f"dw_{c}": v for c, v in nxt.items()},
        }

    d = bounded(cmds, STREAM, 1, [pair], idx="e", size=size).where("gap > 0")
    view = (
        F.when(F.col("fresh") & F.col("_nf"), "exclusive")
        .when(~F.col("fresh") & F.col("_nf"), "hold_exit")
        .when(F.col("fresh"), "hold_entry")
        .otherwise("hold_hold")
    )
    d = d.withColumn("view", view)
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"dw_{c}").alias("dw")) for c in COLUMNS]))
    return d.select(*STREAM, "i", "t", "gap", "view", long.alias("_c")).select(*STREAM, "i", "t", "gap", "view", "_c.*")


def smoothness(deltas: DataFrame, cmds: DataFrame) -> DataFrame:
    """RMS, jitter and RMS per second of the deltas, and saturation, per model, column and view."""
    seen = F.array_compact(
        F.array(F.lit("inclusive"), F.when(F.col("view").isin("exclusive", "hold_exit"), F.col("view")))
    )
    x = deltas.withColumn("view", F.explode(seen))
    m = x.groupBy(*MODEL, "column", "view").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        rms("dw").alias("rms_dw"),
        F.stddev_pop("dw").alias("jitter_sd"),
        rms(F.col("dw") / F.col("gap")).alias("rms_dw_s"),
    )
    sat = cmds.groupBy(*MODEL).agg(
        (100.0 * F.avg(F.col("saturated").cast("int"))).alias("_all"),
        (100.0 * F.avg(F.when(F.col("fresh"), F.col("saturated").cast("int")))).alias("_fresh"),
    )
    pick = F.when(F.col("view") == "exclusive", F.col("_fresh")).otherwise(F.col("_all"))
    return m.join(sat, MODEL).withColumn("saturation_pct", pick).drop("_all", "_fresh")


def pair_composition(deltas: DataFrame) -> DataFrame:
    """Pair counts by view and the share that is zero by construction."""
    zero = F.col("view").isin("hold_entry", "hold_hold")
    return deltas.where(F.col("column") == COLUMNS[0]).groupBy(*MODEL).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("view") == "exclusive").alias("n_exclusive"),
        F.count_if(F.col("view") == "hold_exit").alias("n_hold_exit"),
        F.count_if(zero).alias("n_zero"),
        (100.0 * F.count_if(zero) / F.count(F.lit(1))).alias("zero_pct"),
    )


def _spans(cmds: DataFrame, size: int) -> DataFrame:
    """Held stretches along the whole model stream; stretches meeting at a pass boundary join."""
    at = dense_index(cmds, MODEL, ["pass_id", "i"], "s")
    held = islands(at, MODEL, ~F.col("fresh"), "span_start", idx="s", size=size)
    held = held.where(F.col("span_start").isNotNull())
    return held.groupBy(*MODEL, "span_start").agg(F.count(F.lit(1)).alias("length"), F.max("hold_run").alias("longest_run"))


def stream_summary(cmds: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Fresh and held rows by reason, hold spans, saturation and limiter activity per model."""
    r = F.col("hold_reason")
    base = cmds.groupBy(*MODEL).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("fresh").alias("fresh"),
        F.count_if(~F.col("fresh")).alias("held"),
        F.count_if(r.isin("abstain", "both")).alias("held_abstain"),
        F.count_if(r.isin("state_gate", "both")).alias("held_state_gate"),
        F.count_if(r == "both").alias("held_both"),
        F.count_if("saturated").alias("saturated"),
        F.count_if(F.abs(F.col("omega_cmd") - F.col("omega_cmd_ramp")) > 1e-6).alias("ramp_changed"),
    )
    sp = _spans(cmds, size).groupBy(*MODEL).agg(
        F.count(F.lit(1)).alias("hold_spans"),
        F.max("longest_run").alias("max_hold_run"),
        F.avg("longest_run").alias("mean_hold_run"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("hold_spans", "max_hold_run", "mean_hold_run")}
    return base.join(sp, MODEL, "left").withColumns(zero)


def hold_spans(cmds: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Length statistics of held stretches; median and p95 are cut to whole rows."""
    sp = _spans(cmds, size)
    q = quantile_columns(sp, MODEL, "length", {"_p50": 0.5, "_p95": 0.95})
    total = cmds.groupBy(*MODEL).agg(F.count(F.lit(1)).alias("_rows"))
    g = sp.groupBy(*MODEL).agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.sum("length").alias("n_held"),
        F.avg("length").alias("mean_len"),
        F.max("length").alias("max_len"),
        F.sum(F.when(F.col("length") > P.SPAN_SHORT_ROWS, F.col("length")).otherwise(0)).alias("_short"),
        F.sum(F.when(F.col("length") > P.SPAN_LONG_ROWS, F.col("length")).otherwise(0)).alias("_long"),
    )
    return g.join(q, MODEL).join(total, MODEL).select(
        *MODEL,
        "n_spans",
        "n_held",
        "mean_len",
        F.floor("_p50").alias("median_len"),
        F.floor("_p95").alias("p95_len"),
        "max_len",
        (F.col("max_len") * P.NOMINAL_DT_S).alias("max_len_s"),
        (100.0 * F.col("_short") / F.col("_rows")).alias("over_1s_pct"),
        (100.0 * F.col("_long") / F.col("_rows")).alias("over_5s_pct"),
    )


def across_seed_deltas(deltas: DataFrame, view: str, column: str, n_seeds: int = len(P.SEEDS)) -> DataFrame:
    """Seed mean of the delta on leading frames present under every seed."""
    d = deltas.where(F.col("column") == column)
    d = d if view == "inclusive" else d.where(F.col("view") == view)
    g = d.groupBy("rec", "arm", "i").agg(F.count_distinct("seed").alias("_n"), F.avg("dw").alias("dw"))
    return g.where(F.col("_n") == n_seeds).drop("_n")


def smoothness_compare(across: DataFrame) -> DataFrame:
    """RMS difference of two arms on the frames both have."""
    wide = across.groupBy("rec", "i").agg(*[F.max(F.when(F.col("arm") == a, F.col("dw"))).alias(a) for a in P.ARMS])
    made = [
        F.when(
            F.col(a).isNotNull() & F.col(b).isNotNull(),
            F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")),
        )
        for a, b in P.PAIRS
    ]
    rows = wide.select("rec", "i", F.explode(F.array_compact(F.array(*made))).alias("_p")).select("rec", "i", "_p.*")
    return rows


def seed_group_contrast(metrics: DataFrame, value: str) -> DataFrame:
    """Mean of a metric in two groups of seeds within an arm; not comparable when a group is empty."""
    marked = F.lit(False)
    for arm, seeds in CONTRAST_SEEDS.items():
        if seeds:
            marked = marked | ((F.col("arm") == arm) & F.col("seed").isin(*seeds))
    g = metrics.groupBy("rec", "arm").agg(
        F.avg(F.when(marked, F.col(value))).alias("marked"), F.avg(F.when(~marked, F.col(value))).alias("clean")
    )
    both = F.col("marked").isNotNull() & F.col("clean").isNotNull()
    return g.select(
        "rec",
        "arm",
        both.alias("comparable"),
        F.when(both, F.col("marked")).alias("marked"),
        F.when(both, F.col("clean")).alias("clean"),
        (F.col("marked") - F.col("clean")).alias("delta"),
    )


def sensor_agreement(frames: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Agreement of two yaw-rate sources on moving rows, and the tails of each on eligible rows."""
    a, b = F.col("yaw_odom"), F.col("yaw_imu")
    mv = F.col("moving")
    d = F.degrees(F.abs(a - b))
    got = frames.groupBy("rec").agg(
        F.corr(F.when(mv, a), F.when(mv, b)).alias("corr_moving"),
        F.corr(F.when(mv, F.abs(a)), F.when(mv, F.abs(b))).alias("abs_corr_moving"),
        F.avg(F.when(mv, d)).alias("mean_abs_diff"),
        F.max(F.when(mv, d)).alias("max_abs_diff"),
        F.degrees(F.max(F.when(F.col("eligible"), F.abs(a)))).alias("odom_max"),
        F.degrees(F.max(F.when(F.col("eligible"), F.abs(b)))).alias("imu_max"),
    )
    for name, c in (("odom", a), ("imu", b)):
        ok = frames.where("eligible").withColumn("_v", F.degrees(F.abs(c)))
        got = got.join(quantile_columns(ok, ["rec"], "_v", {f"{name}_p99": 0.99}), "rec")
    return got
