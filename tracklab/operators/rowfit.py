"""Robust fits of plant rows to ground points, one pair of sides per frame.

A frame holds at most a detector's output, so windows keyed by frame stay small.  Points are shuffled
once by frame; every later window and aggregate (also per sweep cell) reuses that partitioning.
Points carry ``side`` (L/R), ``X`` forward, ``Y`` left and ``o``, the detection ordinal for ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklab import params as P


def _median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def neighbours(part: Sequence[str], near: str, half: float = P.SEED_HALF_M) -> Column:
    """Number of near points within ``half`` of this one in ``Y``."""
    return F.expr(
        f"count_if({near}) OVER (PARTITION BY {', '.join(part)} ORDER BY Y "
        f"RANGE BETWEEN {half}D PRECEDING AND {half}D FOLLOWING)"
    )


def dense_seed(points: DataFrame, part: Sequence[str], near: str) -> DataFrame:
    """Median ``Y`` around the near point with most neighbours (first detection on ties)."""
    w = Window.partitionBy(*part)
    out = points.withColumn("_c", neighbours(part, near))
    best = F.min_by("Y", F.when(F.expr(near), F.struct(-F.col("_c"), F.col("o")))).over(w)
    out = out.withColumn("_y", best)
    inside = F.expr(near) & (F.abs(F.col("Y") - F.col("_y")) <= P.SEED_HALF_M)
    return out.withColumn("seed_y", _median(F.when(inside, F.col("Y"))).over(w)).drop("_c", "_y")


def consensus_sweep(points: DataFrame, part: Sequence[str], near: str) -> DataFrame:
    """Offset around the seed with most near inliers (first on ties) and the median of those."""
    w = Window.partitionBy(*part)
    shifts = [-P.SWEEP_SPAN_M + P.SWEEP_STEP_M * k for k in range(P.SWEEP_STEPS)]
    hits = [
        F.count_if(F.expr(near) & (F.abs(F.col("Y") - (F.col("seed_y") + F.lit(s))) < P.INLIER_M)).over(w)
        for s in shifts
    ]
    out = points.withColumn("_h", F.array(*hits))
    best = F.element_at(F.array(*[F.lit(s) for s in shifts]), F.array_position("_h", F.array_max("_h")).cast("int"))
    out = out.withColumn("best_c", F.col("seed_y") + best)
    inside = F.expr(near) & (F.abs(F.col("Y") - F.col("best_c")) < P.INLIER_M)
    out = out.withColumn("inl_near", F.coalesce(inside, F.lit(False)))
    return out.withColumn("near_y", _median(F.when(F.col("inl_near"), F.col("Y"))).over(w)).drop("_h")


def fit_sides(
    points: DataFrame, frame: Sequence[str], near_m: float | str = P.NEAR_M, extend: bool = True, cell: Sequence[str] = ()
) -> DataFrame:
    """One row per (frame, cell, side): inliers, row position, line, rejection reason.

    ``near_m`` is a number or the name of a column.  ``extend=False`` keeps the near points only.
    """
    part = [*frame, *cell, "side"]
    w = Window.partitionBy(*part)
    near = f"(X < {near_m})" if isinstance(near_m, str) else f"(X < {float(near_m)}D)"
    p = dense_seed(points.repartition(*frame) if not cell else points, part, near)
    p = consensus_sweep(p, part, near)
    far = ~F.expr(near) & (F.col("X") <= P.FAR_M) & (F.abs(F.col("Y") - F.col("near_y")) <= P.FAR_TOL_M)
    inl = F.col("inl_near") | (F.coalesce(far, F.lit(False)) if extend else F.lit(False))
    p = p.withColumn("inl", inl)
    p = p.withColumn("row_y", _median(F.when(F.col("inl"), F.col("Y"))).over(w))
    outer = (
        ~F.col("inl")
        & (F.signum("Y") == F.signum("row_y"))
        & (F.abs("Y") > F.abs("row_y") + (P.INLIER_M + P.ADJACENT_GAP_M))
        & (F.lit(True) if extend else F.expr(near))
    )
    y_in, x_in = F.when(F.col("inl"), F.col("Y")), F.when(F.col("inl"), F.col("X"))

    def y_between(lo, hi):
        return _median(F.when(F.col("inl") & (F.col("X") >= lo) & (F.col("X") < hi), F.col("Y")))

    g = p.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(F.expr(near)).alias("n_near"),
        F.count_if("inl").alias("n_inl"),
        F.max("near_y").alias("near_y"),
        F.max("row_y").alias("row_y"),
        (F.max(x_in) - F.min(x_in)).alias("x_span"),
        F.size(F.collect_set(F.bround(x_in, 1))).alias("n_x"),
        F.count_if(outer).alias("n_adjacent"),
        _median(F.when(outer, F.col("Y"))).alias("adjacent_y"),
        F.regr_slope(y_in, x_in).alias("slope"),
        F.regr_intercept(y_in, x_in).alias("icept"),
        F.avg(y_in).alias("mean_y"),
        y_between(1.0, 3.0).alias("y_1_3"),
        y_between(3.0, 5.0).alias("y_3_5"),
        y_between(5.0, 9.0).alias("y_5_9"),
    )
    few, thin = ("too_few_near_seed", "too_few_total") if extend else ("too_few_points", "too_few_inliers")
    reason = (
        F.when(F.col("n_near") < (2 if extend else P.MIN_POINTS), few)
        .when(F.col("n_inl") < P.MIN_POINTS, thin)
        .when(F.abs("row_y") > P.MAX_ABS_Y_M, "abs_y_too_large")
        .when((F.col("x_span") < P.MIN_X_SPAN_M) | (F.col("n_x") < P.MIN_DISTINCT_X), "horizontal_cluster")
        .otherwise("ok")
    )
    g = g.withColumn("reason", reason)
    adj = (F.col("reason") == "ok") & (F.col("n_adjacent") >= 3)
    return g.withColumns({"ok": F.col("reason") == "ok", "adjacent": adj})


def both_sides(sides: DataFrame, frame: Sequence[str], cell: Sequence[str] = ()) -> DataFrame:
    """Left and right fit of a frame as structs ``l`` and ``r`` (NULL when a side saw nothing)."""
    cols = [c for c in sides.columns if c not in (*frame, *cell, "side")]
    pick = [F.max(F.when(F.col("side") == s, F.struct(*cols))).alias(a) for s, a in (("L", "l"), ("R", "r"))]
    return sides.groupBy(*frame, *cell).agg(*pick)


def centre_line(pairs: DataFrame, look: float = P.LOOK_M) -> DataFrame:
    """Mid line of the two side lines where both sides are accepted; NULL otherwise."""
    ok = F.col("l.ok") & F.col("r.ok") & (F.col("l.n_inl") >= 2) & (F.col("r.n_inl") >= 2)
    m_l, m_r = F.col("l.slope"), F.col("r.slope")
    mid = (m_l * look + F.col("l.icept") + (m_r * look + F.col("r.icept"))) / 2
    flags = F.array_compact(
        F.array(
            F.when((F.abs(m_l) > P.STEEP_SLOPE) | (F.abs(m_r) > P.STEEP_SLOPE), "steep_slope"),
            F.when(F.abs(m_l - m_r) > P.SLOPE_MISMATCH, "slope_mismatch"),
        )
    )
    return pairs.withColumns(
        {
            "offset": F.when(ok, mid),
            "heading": F.when(ok, F.degrees(F.atan((m_l + m_r) / 2))),
            "mL": F.when(ok, m_l),
            "mR": F.when(ok, m_r),
            "mc": F.when(ok, (m_l + m_r) / 2),
            "width": F.when(ok, F.col("l.mean_y") - F.col("r.mean_y")),
            "flags": F.when(ok, flags),
        }
    )


def frame_class(l_ok: Column, r_ok: Column, offset: Column) -> Column:
    l_ok, r_ok = F.coalesce(l_ok, F.lit(False)), F.coalesce(r_ok, F.lit(False))
    return (
        F.when(l_ok & r_ok & offset.isNotNull(), "two_row")
        .when(l_ok & r_ok, "fitfail")
        .when(l_ok | r_ok, "single_row")
        .otherwise("none")
    )


def classify_frames(
    points: DataFrame, frame: Sequence[str], spine: DataFrame | None = None, near_m: float | str = P.NEAR_M,
    cell: Sequence[str] = (),
) -> DataFrame:
    """Per-frame model scores from detected points.

    With ``spine`` every listed frame appears, those without detections as ``none``.
    """
    lines = centre_line(both_sides(fit_sides(points, frame, near_m, cell=cell), frame, cell))
    n = F.coalesce("l.n_raw", F.lit(0)) + F.coalesce("r.n_raw", F.lit(0))
    adj = F.coalesce(F.col("l.adjacent").cast("int"), F.lit(0)) + F.coalesce(F.col("r.adjacent").cast("int"), F.lit(0))
    got = lines.withColumns({"n_base": n, "adj": adj})
    if spine is not None:
        got = spine.join(got, list(frame), "left")
        got = got.withColumns({"n_base": F.coalesce("n_base", F.lit(0)), "adj": F.coalesce("adj", F.lit(0))})
    return got.withColumn("cls", frame_class(F.col("l.ok"), F.col("r.ok"), F.col("offset")))


def median_rows(points: DataFrame, frame: Sequence[str], near_m: float = P.NEAR_M) -> DataFrame:
    """Median-row model: side medians, mid lines in two range bins, half-spacing for a single side."""
    part = [*frame, "side"]
    p = points.where((F.col("X") > 0) & (F.col("X") < near_m)).repartition(*frame)
    p = p.withColumn("_m", _median(F.col("Y")).over(Window.partitionBy(*part)))
    inl = F.abs(F.col("Y") - F.col("_m")) < P.FAR_TOL_M

    def binned(lo, hi):
        return _median(F.when((F.col("X") >= lo) & (F.col("X") < hi), F.col("Y")))

    g = p.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(inl).alias("n_in"),
        _median(F.when(inl, F.col("Y"))).alias("row_y"),
        binned(1.0, 3.0).alias("y2"),
        binned(3.0, 5.0).alias("y4"),
    )
    g = g.withColumn("ok", (F.col("n") >= P.MIN_POINTS) & (F.col("n_in") >= P.MIN_POINTS))
    f = both_sides(g, frame)
    l_ok, r_ok = F.coalesce("l.ok", F.lit(False)), F.coalesce("r.ok", F.lit(False))
    c2, c4 = (F.col("l.y2") + F.col("r.y2")) / 2, (F.col("l.y4") + F.col("r.y4")) / 2
    two = l_ok & r_ok
    return f.withColumns(
        {
            "cls": F.when(two, "two_row").when(l_ok | r_ok, "single_row").otherwise("none"),
            "offset": F.when(two, F.coalesce(c2, (F.col("l.row_y") + F.col("r.row_y")) / 2)),
            "heading": F.when(two, F.degrees(F.atan2(c4 - c2, F.lit(2.0)))),
            "side_row": F.when(l_ok & ~r_ok, F.col("l.row_y")).when(r_ok & ~l_ok, F.col("r.row_y")),
            "side_sign": F.when(l_ok & ~r_ok, -1.0).when(r_ok & ~l_ok, 1.0),
        }
    )


def single_side_centre(frames: DataFrame) -> DataFrame:
    """Centre from one row and half the row spacing (primary and sensitivity prior)."""
    at = F.col("side_row")
    return frames.withColumns(
        {
            "offset_primary": at + F.col("side_sign") * P.HALF_SPACING_PRIMARY_M,
            "offset_sensitivity": at + F.col("side_sign") * P.HALF_SPACING_SENSITIVITY_M,
        }
    )


def centre_far(pairs: DataFrame) -> DataFrame:
    """Offset from the 1-3 m bin, heading over 2 to 7 m, else over 2 to 4 m."""

    def mid(c):
        return (F.col(f"l.{c}") + F.col(f"r.{c}")) / 2

    c2, c4, c7 = mid("y_1_3"), mid("y_3_5"), mid("y_5_9")
    long, short = F.degrees(F.atan2(c7 - c2, F.lit(5.0))), F.degrees(F.atan2(c4 - c2, F.lit(2.0)))
    return pairs.withColumns(
        {
            "far_offset": F.coalesce(c2, (F.col("l.row_y") + F.col("r.row_y")) / 2),
            "far_heading": F.coalesce(long, short),
        }
    )


def abstention(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Why the missing side of a single-row frame was rejected and what had been seen of it."""
    one = frames.where("cls = 'single_row'")
    bad = F.when(F.coalesce("l.ok", F.lit(False)), F.col("r")).otherwise(F.col("l"))
    one = one.withColumn("_b", bad)
    raw, near = F.coalesce("_b.n_raw", F.lit(0)), F.coalesce("_b.n_near", F.lit(0))
    seen = F.when(raw == 0, "not_seen").when(near < 2, "seen_far_only").otherwise("seen_near")
    one = one.select(
        *keys,
        F.coalesce("_b.reason", F.lit("too_few_near_seed")).alias("reason"),
        seen.alias("seen"),
        F.when(F.coalesce("l.ok", F.lit(False)), "L").otherwise("R").alias("fit_side"),
    )
    total = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    got = one.groupBy(*keys, "reason", "seen", "fit_side").agg(F.count(F.lit(1)).alias("n")).join(total, list(keys))
    return got.withColumn("share_pct", 100.0 * F.col("n") / F.col("_t")).drop("_t")


def lidar_rows(cloud: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Row line per side of a scan: trunk band, densest seed, then two residual refits.

    A refit needs five points; otherwise the previous line is kept and refitting stops.
    """
    y, x = F.col("Y"), F.col("X")
    band = (F.col("Z") > 0.2) & (F.col("Z") < 1.2) & (x > 1) & (x < 8) & (F.abs("Y") < 2.6) & (F.abs("Y") > 0.3)
    p = cloud.where(band).withColumn("side", F.when(y > 0, "L").otherwise("R")).repartition(*frame)
    part = [*frame, "side"]
    w = Window.partitionBy(*part)
    p = dense_seed(p, part, "true").withColumn("n", F.count(F.lit(1)).over(w))
    p = p.withColumn("_in", F.abs(y - F.col("seed_y")) < 0.6)

    def line(flag):
        yy, xx = F.when(F.col(flag), y), F.when(F.col(flag), x)
        return {"_m": F.regr_slope(yy, xx).over(w), "_k": F.regr_intercept(yy, xx).over(w)}

    p = p.withColumn("n_in", F.count_if("_in").over(w)).withColumns(line("_in"))
    p = p.withColumn("_go", F.lit(True))
    for _ in range(2):
        close = F.col("_in") & (F.abs(y - (F.col("_m") * x + F.col("_k"))) < 0.3)
        p = p.withColumn("_r", F.coalesce(close, F.lit(False)))
        p = p.withColumn("_go", F.col("_go") & (F.count_if("_r").over(w) >= 5))
        new = line("_r")
        p = p.withColumns({c: F.when(F.col("_go"), v).otherwise(F.col(c)) for c, v in new.items()})
    g = p.groupBy(*part).agg(
        F.max("n").alias("n"), F.max("n_in").alias("n_in"), F.max("_m").alias("m"), F.max("_k").alias("k")
    )
    ok = (F.col("n") >= 5) & (F.col("n_in") >= 5)
    g = g.withColumns({"m": F.when(ok, F.col("m")), "k": F.when(ok, F.col("k"))})
    f = both_sides(g, frame)
    return f.select(
        *frame,
        F.coalesce("l.n", F.lit(0)).alias("n_left"),
        F.coalesce("r.n", F.lit(0)).alias("n_right"),
        F.col("l.m").alias("m_left"),
        F.col("r.m").alias("m_right"),
        F.degrees(F.atan((F.col("l.m") + F.col("r.m")) / 2)).alias("lidar_heading"),
    )


def crosscheck(anchors: DataFrame, lidar: DataFrame, camera: DataFrame, frame: Sequence[str]) -> DataFrame:
    """LiDAR against camera heading on anchor frames; frames without a fit stay in the count."""
    both = anchors.join(lidar, list(frame), "left").join(camera, list(frame), "left")
    fit = F.col("lidar_heading").isNotNull()
    lid, cam = F.when(fit, F.col("lidar_heading")), F.when(fit, F.col("camera_heading"))
    return both.groupBy("rec").agg(
        F.count(F.lit(1)).alias("n_anchors"),
        F.count(lid).alias("n_fitted"),
        F.avg(lid).alias("lidar_mean"),
        F.stddev_pop(lid).alias("lidar_sd"),
        F.avg(cam).alias("camera_mean"),
        F.stddev_pop(cam).alias("camera_sd"),
        (F.avg(cam) - F.avg(lid)).alias("camera_minus_lidar"),
    )


def row_widths(points: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Distance between the two side lines of well-covered, centred, shallow frames."""
    side = points.groupBy(*frame, "side").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("Y", "X").alias("m"), F.regr_intercept("Y", "X").alias("c")
    )
    f = both_sides(side.where("n >= 6"), frame)
    c_l, c_r = F.col("l.c"), F.col("r.c")
    good = (
        (F.abs((c_l + c_r) / 2) < 0.4) & (F.abs("l.m") < 0.4) & (F.abs("r.m") < 0.4) & (c_l - c_r > 0)
    )
    return f.where(good).select(*frame, (c_l - c_r).alias("width"))
