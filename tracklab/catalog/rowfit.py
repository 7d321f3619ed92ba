"""Row-fit and sweep queries."""

from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.catalog.comparison import longest, paired_series, positions
from tracklab.catalog.draws import block_ci_sql
from tracklab.operators import rowfit, sweeps
from tracklab.plans import views as V
from tracklab.plans.quantiles import quantile_columns
from tracklab.plans.registry import d6, d9, r6, r9, query
from tracklab.plans.segments import SEGMENT_ROWS
from tracklab.plans.views import add_view
from tracklab.session import stored

#: Replicates of an interval of the class sweep; there are thirty intervals for every arm.
SWEEP_REPLICATES = 500
FRAME = ["rec", "arm", "seed", "i"]


def fit_sql(src: str, part: str, near: str, extend: bool = True) -> str:
    """SQL text of the side fit over ``src``, one row per ``part``."""
    hits = ", ".join(
        f"count(*) FILTER (nr AND abs(Y - (seed_y + ({-P.SWEEP_SPAN_M + P.SWEEP_STEP_M * k!r}::DOUBLE))) < 0.25) OVER p"
        for k in range(P.SWEEP_STEPS)
    )
    shifts = ", ".join(f"{-P.SWEEP_SPAN_M + P.SWEEP_STEP_M * k!r}::DOUBLE" for k in range(P.SWEEP_STEPS))
    few, thin, least = ("too_few_near_seed", "too_few_total", 2) if extend else ("too_few_points", "too_few_inliers", 3)
    inl = "inl_near OR (NOT nr AND X <= 10.0 AND abs(Y - near_y) <= 0.5)" if extend else "inl_near"
    return f"""
      SELECT *, reason = 'ok' AS ok, reason = 'ok' AND n_adjacent >= 3 AS adjacent FROM (SELECT *,
        CASE WHEN n_near < {least} THEN '{few}' WHEN n_inl < 3 THEN '{thin}' WHEN abs(row_y) > 3.0 THEN 'abs_y_too_large'
          WHEN x_span < 1.0 OR n_x < 3 THEN 'horizontal_cluster' ELSE 'ok' END AS reason FROM (
        SELECT {part}, count(*) AS n_raw, count(*) FILTER (nr) AS n_near, count(*) FILTER (inl) AS n_inl,
          max(near_y) AS near_y, max(row_y) AS row_y, max(X) FILTER (inl) - min(X) FILTER (inl) AS x_span,
          count(DISTINCT round_even(X, 1)) FILTER (inl) AS n_x, count(*) FILTER (outr) AS n_adjacent,
          quantile_cont(Y, 0.5) FILTER (outr) AS adjacent_y,
          regr_slope(CASE WHEN inl THEN Y END, X) AS slope, regr_intercept(CASE WHEN inl THEN Y END, X) AS icept,
          avg(Y) FILTER (inl) AS mean_y, quantile_cont(Y, 0.5) FILTER (inl AND X >= 1 AND X < 3) AS y_1_3,
          quantile_cont(Y, 0.5) FILTER (inl AND X >= 3 AND X < 5) AS y_3_5,
          quantile_cont(Y, 0.5) FILTER (inl AND X >= 5 AND X < 9) AS y_5_9
        FROM (SELECT *, coalesce(NOT inl AND sign(Y) = sign(row_y) AND abs(Y) > abs(row_y) + 0.95e0
            {'' if extend else 'AND nr'}, false) AS outr
          FROM (SELECT *, quantile_cont(Y, 0.5) FILTER (inl) OVER p AS row_y FROM (SELECT *, coalesce({inl}, false) AS inl
            FROM (SELECT *, quantile_cont(Y, 0.5) FILTER (inl_near) OVER p AS near_y FROM (
              SELECT *, coalesce(nr AND abs(Y - best_c) < 0.25, false) AS inl_near FROM (
                SELECT *, seed_y + ([{shifts}])[list_position(h, list_max(h))] AS best_c FROM (SELECT *, [{hits}] AS h FROM (
                  SELECT *, quantile_cont(Y, 0.5) FILTER (nr AND abs(Y - y0) <= 0.25) OVER p AS seed_y FROM (
                    SELECT *, arg_min(Y, (-c, o)) FILTER (nr) OVER p AS y0 FROM (
                      SELECT *, count(*) FILTER (nr) OVER (PARTITION BY {part} ORDER BY Y
                        RANGE BETWEEN 0.25 PRECEDING AND 0.25 FOLLOWING) AS c
                      FROM (SELECT *, X < {near} AS nr FROM {src}))
                    WINDOW p AS (PARTITION BY {part}))
                  WINDOW p AS (PARTITION BY {part})) WINDOW p AS (PARTITION BY {part}))))
              WINDOW p AS (PARTITION BY {part})))
            WINDOW p AS (PARTITION BY {part}))) GROUP BY {part}))"""


SIDE_COLS = (
    "n_raw", "n_near", "n_inl", "row_y", "slope", "icept", "mean_y", "ok", "adjacent", "reason", "y_1_3", "y_3_5", "y_5_9",
)


def pair_sql(sides: str, key: str) -> str:
    picks = ", ".join(f"any_value({c}) FILTER (side = '{s}') AS {s.lower()}_{c}" for s in "LR" for c in SIDE_COLS)
    return f"""SELECT *, CASE WHEN two THEN (l_slope * 2.0e0 + l_icept + (r_slope * 2.0e0 + r_icept)) / 2 END AS "offset",
        CASE WHEN two THEN degrees(atan((l_slope + r_slope) / 2)) END AS heading, CASE WHEN two THEN l_slope END AS mL,
        CASE WHEN two THEN r_slope END AS mR, CASE WHEN two THEN (l_slope + r_slope) / 2 END AS mc,
        CASE WHEN two THEN l_mean_y - r_mean_y END AS width,
        coalesce(l_n_raw, 0) + coalesce(r_n_raw, 0) AS n_base,
        coalesce(CAST(l_adjacent AS INT), 0) + coalesce(CAST(r_adjacent AS INT), 0) AS adj,
        CASE WHEN two THEN 'two_row' WHEN coalesce(l_ok, false) OR coalesce(r_ok, false) THEN 'single_row' ELSE 'none' END AS cls
      FROM (SELECT *, coalesce(l_ok AND r_ok, false) AS two FROM (SELECT {key}, {picks} FROM ({sides}) GROUP BY {key}))"""


K = "rec, arm, seed, i"
add_view("v_sides", ("v_points",), fit_sql("v_points", f"{K}, side", "5.0"))
add_view("v_centre", ("v_sides",), pair_sql("SELECT * FROM v_sides", K))
add_view(
    "v_model",
    ("v_centre", "v_spine"),
    """SELECT s.rec, s.arm, s.seed, s.i, coalesce(cls, 'none') AS cls, coalesce(n_base, 0) AS n_base, coalesce(adj, 0) AS adj,
         "offset", heading, mL, mR, mc FROM v_spine s LEFT JOIN v_centre c USING (rec, arm, seed, i)""",
)


def sides(spark, sf, **kw):
    return rowfit.fit_sides(V.points(spark, sf), FRAME, **kw)


def pairs(spark, sf):
    return rowfit.centre_line(rowfit.both_sides(sides(spark, sf), FRAME))


@query(
    "E2_dense_seed",
    f"""SELECT {K}, side, round(quantile_cont(Y, 0.5) FILTER (X < 5 AND abs(Y - y0) <= 0.25), 6) AS seed_y FROM (
          SELECT *, arg_min(Y, (-c, o)) FILTER (X < 5) OVER (PARTITION BY {K}, side) AS y0 FROM (
            SELECT *, count(*) FILTER (X < 5) OVER (PARTITION BY {K}, side ORDER BY Y
              RANGE BETWEEN 0.25 PRECEDING AND 0.25 FOLLOWING) AS c FROM v_points)) GROUP BY {K}, side""",
    ("v_points",),
)
def dense_seed(spark, sf):
    p = V.points(spark, sf).repartition(*FRAME)
    got = rowfit.dense_seed(p, [*FRAME, "side"], "(X < 5.0D)")
    return got.groupBy(*FRAME, "side").agg(F.round(F.max("seed_y"), 6).alias("seed_y"))


@query("E3_consensus_sweep", f"SELECT {K}, side, round(near_y, 6) AS near_y, n_near FROM v_sides", ("v_sides",))
def consensus(spark, sf):
    return sides(spark, sf).select(*FRAME, "side", "n_near", *r6("near_y"))


@query("E4_far_extend", f"SELECT {K}, side, n_inl, round(row_y, 6) AS row_y FROM v_sides", ("v_sides",))
def far_extend(spark, sf):
    return sides(spark, sf).select(*FRAME, "side", "n_inl", *r6("row_y"))


@query("E5_fit_side", f"SELECT {K}, side, reason, round(x_span, 6) AS x_span, n_x FROM v_sides", ("v_sides",))
def fit_side(spark, sf):
    return sides(spark, sf).select(*FRAME, "side", "reason", F.col("n_x").cast("bigint"), *r6("x_span"))


@query(
    "E6_adjacent_rows",
    f"SELECT {K}, side, n_adjacent, round(adjacent_y, 6) AS adjacent_y FROM v_sides WHERE adjacent",
    ("v_sides",),
)
def adjacent_rows(spark, sf):
    return sides(spark, sf).where("adjacent").select(*FRAME, "side", "n_adjacent", *r6("adjacent_y"))


CL = ("offset", "heading", "mL", "mR", "mc", "width")


@query(
    "E7_centre_line",
    f"""SELECT {K}, {d9(*CL)},
          CAST(abs(mL) > 0.3 OR abs(mR) > 0.3 AS INT) AS steep, CAST(abs(mL - mR) > 0.2 AS INT) AS mismatch
        FROM v_centre WHERE cls = 'two_row'""",
    ("v_centre",),
)
def centre_line(spark, sf):
    got = pairs(spark, sf).where("offset is not null")
    return got.select(
        *FRAME,
        *r9(*CL),
        F.array_contains("flags", "steep_slope").cast("int").alias("steep"),
        F.array_contains("flags", "slope_mismatch").cast("int").alias("mismatch"),
    )


def model_scores(spark, sf):
    return rowfit.classify_frames(V.points(spark, sf), FRAME, V.spine(spark, sf))


@query("E8_classify_frames", f"SELECT {K}, cls, n_base, CAST(adj AS BIGINT) AS adj FROM v_model", ("v_model",))
def classify_frames(spark, sf):
    return model_scores(spark, sf).select(*FRAME, "cls", "n_base", F.col("adj").cast("bigint"))


@query(
    "E9_fit_side_hybrid",
    f"SELECT {K}, side, reason, n_inl, round(row_y, 6) AS row_y FROM ({fit_sql('v_points', K + ', side', '5.0', False)})",
    ("v_points",),
)
def fit_side_hybrid(spark, sf):
    return sides(spark, sf, extend=False).select(*FRAME, "side", "reason", "n_inl", *r6("row_y"))


add_view(
    "v_median",
    ("v_points",),
    f"""SELECT *, CASE WHEN lok AND rok THEN 'two_row' WHEN lok OR rok THEN 'single_row' ELSE 'none' END AS cls,
          CASE WHEN lok AND rok THEN coalesce((l2 + r2) / 2, (lr + rr) / 2) END AS "offset",
          CASE WHEN lok AND rok THEN degrees(atan2((l4 + r4) / 2 - (l2 + r2) / 2, 2.0e0)) END AS heading,
          CASE WHEN lok AND NOT rok THEN lr WHEN rok AND NOT lok THEN rr END AS side_row,
          CASE WHEN lok AND NOT rok THEN -1.0e0 WHEN rok AND NOT lok THEN 1.0e0 END AS side_sign
        FROM (SELECT {K}, """
    + ", ".join(
        f"coalesce(any_value(n >= 3 AND n_in >= 3) FILTER (side = '{s}'), false) AS {s.lower()}ok, "
        + ", ".join(f"any_value({c}) FILTER (side = '{s}') AS {s.lower()}{a}" for c, a in (("y2", "2"), ("y4", "4"), ("row_y", "r")))
        for s in "LR"
    )
    + f""" FROM (SELECT {K}, side, count(*) AS n, count(*) FILTER (inl) AS n_in, quantile_cont(Y, 0.5) FILTER (inl) AS row_y,
            quantile_cont(Y, 0.5) FILTER (X >= 1 AND X < 3) AS y2, quantile_cont(Y, 0.5) FILTER (X >= 3 AND X < 5) AS y4
          FROM (SELECT *, abs(Y - quantile_cont(Y, 0.5) OVER (PARTITION BY {K}, side)) < 0.5 AS inl FROM v_points
            WHERE X > 0 AND X < 5.0) GROUP BY {K}, side) GROUP BY {K})""",
)


@query(
    "E10_median_row",
    f"SELECT {K}, cls, {d9('offset', 'heading')} FROM v_median",
    ("v_median",),
)
def median_row(spark, sf):
    return rowfit.median_rows(V.points(spark, sf), FRAME).select(*FRAME, "cls", *r9("offset", "heading"))


@query(
    "E11_single_side_centre",
    f"""SELECT {K}, round(side_row + side_sign * 1.2e0, 6) AS offset_primary,
          round(side_row + side_sign * 0.96e0, 6) AS offset_sensitivity FROM v_median WHERE cls = 'single_row'""",
    ("v_median",),
)
def single_side(spark, sf):
    got = rowfit.single_side_centre(rowfit.median_rows(V.points(spark, sf), FRAME)).where("cls = 'single_row'")
    return got.select(*FRAME, *r6("offset_primary", "offset_sensitivity"))


@query(
    "E12_centre_far",
    f"""SELECT {K}, round(coalesce((l_y_1_3 + r_y_1_3) / 2, (l_row_y + r_row_y) / 2), 6) AS far_offset,
          round(coalesce(degrees(atan2((l_y_5_9 + r_y_5_9) / 2 - (l_y_1_3 + r_y_1_3) / 2, 5.0e0)),
            degrees(atan2((l_y_3_5 + r_y_3_5) / 2 - (l_y_1_3 + r_y_1_3) / 2, 2.0e0))), 6) AS far_heading
        FROM v_centre WHERE cls = 'two_row'""",
    ("v_centre",),
)
def centre_far(spark, sf):
    got = rowfit.centre_far(pairs(spark, sf).where("offset is not null"))
    return got.select(*FRAME, *r6("far_offset", "far_heading"))


@query(
    "E13_abstention",
    """SELECT rec, arm, reason, seen, fit_side, n, round(100.0e0 * n / sum(n) OVER (PARTITION BY rec, arm), 6) AS share_pct FROM (
         SELECT rec, arm, CASE WHEN lo THEN coalesce(r_reason, 'too_few_near_seed') ELSE coalesce(l_reason, 'too_few_near_seed') END AS reason,
           CASE WHEN raw = 0 THEN 'not_seen' WHEN near < 2 THEN 'seen_far_only' ELSE 'seen_near' END AS seen,
           CASE WHEN lo THEN 'L' ELSE 'R' END AS fit_side, count(*) AS n
         FROM (SELECT *, coalesce(l_ok, false) AS lo, coalesce(CASE WHEN coalesce(l_ok, false) THEN r_n_raw ELSE l_n_raw END, 0) AS raw,
             coalesce(CASE WHEN coalesce(l_ok, false) THEN r_n_near ELSE l_n_near END, 0) AS near FROM v_centre WHERE cls = 'single_row')
         GROUP BY ALL)""",
    ("v_centre",),
)
def abstention(spark, sf):
    frames = rowfit.classify_frames(V.points(spark, sf), FRAME)
    return rowfit.abstention(frames, ["rec", "arm"]).withColumn("share_pct", F.round("share_pct", 6))


def refit_sql(src: str, part: str) -> str:
    step = "SELECT *, {g} AS go{n}, CASE WHEN {g} THEN regr_slope(CASE WHEN k{n} THEN Y END, X) OVER p ELSE m{q} END AS m{n}, " \
           "CASE WHEN {g} THEN regr_intercept(CASE WHEN k{n} THEN Y END, X) OVER p ELSE c{q} END AS c{n} FROM (" \
           "SELECT *, coalesce(inl AND abs(Y - (m{q} * X + c{q})) < 0.3, false) AS k{n} FROM ({inner})) WINDOW p AS (PARTITION BY " + part + ")"
    inner = f"""SELECT *, regr_slope(CASE WHEN inl THEN Y END, X) OVER p AS m0, regr_intercept(CASE WHEN inl THEN Y END, X) OVER p AS c0
      FROM (SELECT *, abs(Y - quantile_cont(Y, 0.5) FILTER (abs(Y - y0) <= 0.25) OVER (PARTITION BY {part})) < 0.6 AS inl FROM (
        SELECT *, arg_min(Y, (-c, o)) OVER (PARTITION BY {part}) AS y0 FROM (SELECT *,
          count(*) OVER (PARTITION BY {part} ORDER BY Y RANGE BETWEEN 0.25 PRECEDING AND 0.25 FOLLOWING) AS c FROM {src})))
      WINDOW p AS (PARTITION BY {part})"""
    one = step.format(n=1, q=0, g="(count(*) FILTER (k1) OVER p >= 5)", inner=inner)
    two = step.format(n=2, q=1, g="(go1 AND count(*) FILTER (k2) OVER p >= 5)", inner=one)
    return f"""SELECT {part}, count(*) AS n, CASE WHEN count(*) >= 5 AND count(*) FILTER (inl) >= 5 THEN any_value(m2) END AS m
      FROM ({two}) GROUP BY {part}"""


add_view(
    "v_cloud",
    ("v_points",),
    """SELECT rec, i, X, Y, CASE WHEN Y > 0 THEN 'L' ELSE 'R' END AS side, o FROM v_points
       WHERE Z > 0.2 AND Z < 1.2 AND X > 1 AND X < 8 AND abs(Y) < 2.6 AND abs(Y) > 0.3""",
)
add_view(
    "v_lidar",
    ("v_cloud",),
    f"""SELECT rec, i, coalesce(any_value(n) FILTER (side = 'L'), 0) AS n_left, coalesce(any_value(n) FILTER (side = 'R'), 0) AS n_right,
          any_value(m) FILTER (side = 'L') AS m_left, any_value(m) FILTER (side = 'R') AS m_right,
          degrees(atan((any_value(m) FILTER (side = 'L') + any_value(m) FILTER (side = 'R')) / 2)) AS lidar_heading
        FROM ({refit_sql('v_cloud', 'rec, i, side')}) GROUP BY rec, i""",
)


def lidar(spark, sf):
    return rowfit.lidar_rows(V.points(spark, sf).select("rec", "i", "X", "Y", "Z", "o"), ["rec", "i"])


@query(
    "E14_lidar_row",
    f"SELECT rec, i, n_left, n_right, {d6('m_left', 'm_right', 'lidar_heading')} FROM v_lidar",
    ("v_lidar",),
)
def lidar_row(spark, sf):
    return lidar(spark, sf).select("rec", "i", "n_left", "n_right", *r6("m_left", "m_right", "lidar_heading"))


add_view(
    "v_anchor",
    ("v_model", "v_frames"),
    """SELECT rec, corridor, i FROM (SELECT *, row_number() OVER (PARTITION BY rec, corridor, pass_id ORDER BY i) - 1 AS pl FROM (
           SELECT *, first_value(pass_id) OVER (PARTITION BY rec, corridor ORDER BY n DESC, first_i) AS best FROM (
             SELECT m.rec, f.corridor, f.pass_id, m.i, count(*) OVER (PARTITION BY m.rec, f.corridor, f.pass_id) AS n,
               min(m.i) OVER (PARTITION BY m.rec, f.corridor, f.pass_id) AS first_i
             FROM v_model m JOIN v_frames f USING (rec, i) WHERE m.arm = 'C' AND m.seed = 42 AND m.cls = 'two_row' AND f.eligible)))
       WHERE pass_id = best AND pl >= greatest(0, (n - 2) // 2) AND pl < greatest(0, (n - 2) // 2) + 2""",
)


def anchors(spark, sf, scored):
    from tracklab.operators.lookups import mid_run_anchors

    f = V.frames(spark, sf).where("eligible").select("rec", "i", "corridor", "pass_id")
    hits = scored.where("arm = 'C' and seed = 42 and cls = 'two_row'").select("rec", "i").join(f, ["rec", "i"])
    size = SEGMENT_ROWS
    return mid_run_anchors(hits, ["rec", "corridor"], 2, size)


@query("D8_mid_run_anchors", "SELECT rec, corridor, i FROM v_anchor", ("v_anchor",))
def mid_run_anchors(spark, sf):
    return anchors(spark, sf, model_scores(spark, sf)).select("rec", "corridor", "i")


XC = ("lidar_mean", "lidar_sd", "camera_mean", "camera_sd", "camera_minus_lidar")


@query(
    "E15_crosscheck",
    f"""SELECT rec, n_anchors, n_fitted, {d6(*XC)} FROM (SELECT rec, count(*) AS n_anchors, count(lh) AS n_fitted, avg(lh) AS lidar_mean,
          stddev_pop(lh) AS lidar_sd, avg(ch) AS camera_mean, stddev_pop(ch) AS camera_sd, avg(ch) - avg(lh) AS camera_minus_lidar
        FROM (SELECT a.rec, a.i, l.lidar_heading AS lh, CASE WHEN l.lidar_heading IS NOT NULL THEN c.h END AS ch FROM v_anchor a
          LEFT JOIN v_lidar l USING (rec, i) LEFT JOIN (SELECT rec, i, avg(heading) AS h FROM v_model WHERE cls = 'two_row' GROUP BY rec, i) c
          USING (rec, i)) GROUP BY rec)""",
    ("v_anchor", "v_lidar", "v_model"),
)
def crosscheck(spark, sf):
    scored = model_scores(spark, sf)
    camera = scored.where("cls = 'two_row'").groupBy("rec", "i").agg(F.avg("heading").alias("camera_heading"))
    got = rowfit.crosscheck(anchors(spark, sf, scored).select("rec", "i"), lidar(spark, sf), camera, ["rec", "i"])
    return got.select("rec", "n_anchors", "n_fitted", *r6(*XC))


WID = ("p25", "p50", "p75", "mean_width")


@query(
    "E16_row_width",
    f"""SELECT rec, n, {d6(*WID)} FROM (SELECT rec, count(*) AS n, quantile_cont(w, 0.25) AS p25, quantile_cont(w, 0.5) AS p50,
          quantile_cont(w, 0.75) AS p75, avg(w) AS mean_width FROM (
            SELECT rec, lc - rc AS w FROM (SELECT {K}, any_value(m) FILTER (side = 'L') AS lm, any_value(m) FILTER (side = 'R') AS rm,
                any_value(c) FILTER (side = 'L') AS lc, any_value(c) FILTER (side = 'R') AS rc
              FROM (SELECT {K}, side, regr_slope(Y, X) AS m, regr_intercept(Y, X) AS c FROM v_points GROUP BY {K}, side
                HAVING count(*) >= 6) GROUP BY {K})
            WHERE abs((lc + rc) / 2) < 0.4 AND abs(lm) < 0.4 AND abs(rm) < 0.4 AND lc - rc > 0) GROUP BY rec)""",
    ("v_points",),
)
def row_width(spark, sf):
    w = rowfit.row_widths(V.points(spark, sf), FRAME)
    size = SEGMENT_ROWS
    q = quantile_columns(w, ["rec"], "width", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    n = w.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.avg("width").alias("mean_width"))
    return n.join(q, "rec").select("rec", "n", *r6(*WID))


SL = ("corr_lr", "converging_pct", "inward_pct", "const_rms", "line_rms", "mean_abs_diff", "ml_p10", "ml_p50", "ml_p90", "dm_p50")


@query(
    "E17_slope_study",
    f"""SELECT rec, arm, n, {d6(*SL)} FROM (SELECT rec, arm, count(*) AS n, corr(mL, mR) AS corr_lr,
          100.0e0 * avg(CAST(mL - mR < 0 AS INT)) AS converging_pct, 100.0e0 * avg(CAST(mL < 0 AND mR > 0 AS INT)) AS inward_pct,
          sqrt(avg(k * k)) AS const_rms, sqrt(avg("offset" * "offset")) AS line_rms, avg(abs(k - "offset")) AS mean_abs_diff,
          quantile_cont(mL, 0.1) AS ml_p10, quantile_cont(mL, 0.5) AS ml_p50, quantile_cont(mL, 0.9) AS ml_p90,
          quantile_cont(mL - mR, 0.5) AS dm_p50
        FROM (SELECT *, (l_row_y + r_row_y) / 2 AS k FROM v_centre WHERE cls = 'two_row') GROUP BY rec, arm)""",
    ("v_centre",),
)
def slope_study(spark, sf):
    got = pairs(spark, sf).where("offset is not null").select(
        "rec", "arm", "offset", "mL", "mR", (F.col("mL") - F.col("mR")).alias("dm"),
        ((F.col("l.row_y") + F.col("r.row_y")) / 2).alias("k"),
    )
    key = ["rec", "arm"]
    size = SEGMENT_ROWS
    agg = got.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("mL", "mR").alias("corr_lr"),
        (100.0 * F.avg((F.col("dm") < 0).cast("int"))).alias("converging_pct"),
        (100.0 * F.avg(((F.col("mL") < 0) & (F.col("mR") > 0)).cast("int"))).alias("inward_pct"),
        F.sqrt(F.avg(F.col("k") * F.col("k"))).alias("const_rms"),
        F.sqrt(F.avg(F.col("offset") * F.col("offset"))).alias("line_rms"),
        F.avg(F.abs(F.col("k") - F.col("offset"))).alias("mean_abs_diff"),
    )
    qm = quantile_columns(got, key, "mL", {"ml_p10": 0.1, "ml_p50": 0.5, "ml_p90": 0.9})
    qd = quantile_columns(got, key, "dm", {"dm_p50": 0.5})
    return agg.join(qm, key).join(qd, key).select(*key, "n", *r6(*SL))


# --- class preference sweep -------------------------------------------------------------------
CELL_SQL = (
    "['agnostic', "
    + ", ".join(f"CASE WHEN kind = 0 OR t < {t} THEN 'trunk_T{t}' END" for t in P.CLASS_THRESHOLDS)
    + ", "
    + ", ".join(f"CASE WHEN kind = 1 OR p < {t} THEN 'pole_T{t}' END" for t in P.CLASS_THRESHOLDS)
    + ", CASE WHEN kind = 0 THEN 'trunk_only' END, CASE WHEN kind = 1 THEN 'pole_only' END]"
)
add_view(
    "v_cellpoints",
    ("v_points",),
    f"""SELECT rec, arm, seed, i, side, X, Y, cell, row(CASE WHEN cell LIKE 'pole%' THEN 1 - kind ELSE kind END, o) AS o
        FROM (SELECT * EXCLUDE (t, p), unnest({CELL_SQL}) AS cell FROM (SELECT *,
            count(*) FILTER (kind = 0) OVER (PARTITION BY {K}, side) AS t,
            count(*) FILTER (kind = 1) OVER (PARTITION BY {K}, side) AS p FROM v_points)) WHERE cell IS NOT NULL""",
)
CELLS = ", ".join(f"'{c}'" for c in sweeps.ALL_CELLS)
add_view(
    "v_cells",
    ("v_cellpoints", "v_points"),
    f"""SELECT rec, arm, cell, 100.0e0 * coalesce(two, 0) / tot AS two_row_pct, 100.0e0 * coalesce(one, 0) / tot AS single_pct,
          100.0e0 * (tot - coalesce(two, 0) - coalesce(one, 0)) / tot AS none_pct, coalesce(base, 0) / tot AS mean_base,
          offset_rms, heading_rms, coalesce(nf, 0) AS n_two_row_frames
        FROM (SELECT rec, arm, 3 * count(DISTINCT i) AS tot, unnest([{CELLS}]) AS cell FROM v_points GROUP BY rec, arm)
        LEFT JOIN (SELECT rec, arm, cell, sum(two) AS two, sum(one) AS one, sum(base) AS base,
            sqrt(avg(o * o) FILTER (two = 3)) AS offset_rms, sqrt(avg(h * h) FILTER (two = 3)) AS heading_rms,
            count(*) FILTER (two = 3) AS nf
          FROM (SELECT rec, arm, cell, i, count(*) FILTER (cls = 'two_row') AS two, count(*) FILTER (cls = 'single_row') AS one,
              sum(n_base) AS base, avg("offset") AS o, avg(heading) AS h
            FROM ({pair_sql(fit_sql('v_cellpoints', K + ', cell, side', '5.0'), K + ', cell')}) GROUP BY rec, arm, cell, i)
          GROUP BY rec, arm, cell) USING (rec, arm, cell)""",
)
add_view(
    "v_cellframes",
    ("v_cellpoints",),
    f"""SELECT rec, arm, cell, i, unnest(['offset', 'heading']) AS metric, unnest([o, h]) AS v FROM (
          SELECT rec, arm, cell, i, count(*) FILTER (cls = 'two_row') AS two, avg("offset") AS o, avg(heading) AS h
          FROM ({pair_sql(fit_sql('v_cellpoints', K + ', cell, side', '5.0'), K + ', cell')}) GROUP BY rec, arm, cell, i) WHERE two = 3""",
)
add_view(
    "v_cellseries",
    ("v_cellframes", "v_pos", "v_longest"),
    "SELECT c.*, p.run, p.pos, l.L FROM v_cellframes c JOIN v_pos p USING (rec, i) JOIN v_longest l USING (rec, metric)",
)
add_view(
    "v_cellci",
    ("v_cellseries",),
    f"""SELECT rec, arm, cell, metric, rms, ci_low, ci_high FROM (SELECT rec, arm, cell, metric, sqrt(avg(v * v)) AS rms FROM v_cellseries GROUP BY ALL)
        LEFT JOIN ({block_ci_sql('v_cellseries', 'rec, arm, cell, metric', {'v': 'v * v'}, 'sqrt(greatest(s_v, 0) / s__l)', SWEEP_REPLICATES)}) USING (rec, arm, cell, metric)""",
)
CS = ("two_row_pct", "single_pct", "none_pct", "mean_base", "offset_rms", "heading_rms")
CI = ("offset_ci_low", "offset_ci_high", "heading_ci_low", "heading_ci_high")


def _cells(spark, sf):
    """Cells with coverage and error, and the intervals by metric."""
    points = V.points(spark, sf)
    per_frame = stored(sweeps.config_frames(points, ["rec", "arm"]))
    pos, size = positions(spark, sf)
    block = longest(stored(paired_series(spark, sf)[0])).select("rec", "metric", "L")
    ci = sweeps.config_intervals(per_frame, pos, block, ["rec", "arm"], replicates=SWEEP_REPLICATES, size=size)
    return sweeps.config_summary(per_frame, points, ["rec", "arm"]), stored(ci)


@query(
    "H1_config_sweep",
    f"""SELECT c.rec, c.arm, c.cell, n_two_row_frames, {d6(*CS)}, {', '.join(f"round(max(ci_{b}) FILTER (metric = '{m}'), 6) AS {m}_ci_{b}" for m in ('offset', 'heading') for b in ('low', 'high'))}
        FROM v_cells c LEFT JOIN v_cellci i ON i.rec = c.rec AND i.arm = c.arm AND i.cell = c.cell GROUP BY ALL""",
    ("v_cells", "v_cellci"),
)
def config_sweep(spark, sf):
    cells, ci = _cells(spark, sf)
    wide = ci.groupBy("rec", "arm", "cell").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(f"ci_{b}"))).alias(f"{m}_ci_{b}") for m in ("offset", "heading") for b in ("low", "high")]
    )
    return cells.join(wide, ["rec", "arm", "cell"], "left").select("rec", "arm", "cell", "n_two_row_frames", *r6(*CS, *CI))


#: The published floor, and one that cells of these tables reach.
FLOORS = (P.VIABLE_COVERAGE_PCT, 20.0)


@query(
    "H2_select_config",
    f"""SELECT *, bool_or(locked <> 'agnostic') OVER (PARTITION BY rec, arm, floor_pct) AS pause FROM (
          SELECT rec, arm, metric, floor_pct, round(mx, 6) AS max_two_row_pct, n_viable, cell AS argmin, round(rms, 6) AS argmin_rms,
            CASE WHEN cell IS NOT NULL THEN coalesce(lo <= bhi AND blo <= hi, false) END AS overlaps_baseline,
            CASE WHEN cell IS NULL THEN NULL WHEN coalesce(lo <= bhi AND blo <= hi, false) THEN 'agnostic' ELSE cell END AS locked,
            CASE WHEN cell IS NOT NULL THEN n_open = 0 AND coalesce(flat, false) END AS flat
          FROM (SELECT rec, arm, metric, floor_pct, max(two_row_pct) AS mx, count(*) FILTER (ok) AS n_viable,
              arg_min(cell, (rms, no)) FILTER (ok AND rms IS NOT NULL) AS cell, arg_min(rms, (rms, no)) FILTER (ok AND rms IS NOT NULL) AS rms,
              arg_min(struct_pack(x := ci_low), (rms, no)) FILTER (ok AND rms IS NOT NULL).x AS lo, arg_min(struct_pack(x := ci_high), (rms, no)) FILTER (ok AND rms IS NOT NULL).x AS hi,
              any_value(ci_low) FILTER (cell = 'agnostic') AS blo, any_value(ci_high) FILTER (cell = 'agnostic') AS bhi,
              max(ci_low) FILTER (ok) <= min(ci_high) FILTER (ok) AS flat, count(*) FILTER (ok AND ci_low IS NULL) AS n_open
            FROM (SELECT c.rec, c.arm, c.cell, c.two_row_pct, m.metric, f.floor_pct, i.rms, i.ci_low, i.ci_high, c.two_row_pct >= f.floor_pct AS ok,
                list_position([{CELLS}], c.cell) AS no
              FROM v_cells c CROSS JOIN (VALUES ('offset'), ('heading')) m(metric) CROSS JOIN (VALUES ({FLOORS[0]}::DOUBLE), ({FLOORS[1]}::DOUBLE)) f(floor_pct)
              LEFT JOIN v_cellci i ON i.rec = c.rec AND i.arm = c.arm AND i.cell = c.cell AND i.metric = m.metric WHERE c.cell NOT LIKE '%only')
            GROUP BY rec, arm, metric, floor_pct))""",
    ("v_cells", "v_cellci"),
)
def select_config(spark, sf):
    cells, ci = _cells(spark, sf)
    grid = cells.select("rec", "arm", "cell", "two_row_pct", F.explode(F.array(F.lit("offset"), F.lit("heading"))).alias("metric"))
    grid = stored(grid.join(ci.drop("n"), ["rec", "arm", "cell", "metric"], "left"))
    by_floor = [sweeps.select_config(grid, ["rec", "arm", "metric"], f).withColumn("floor_pct", F.lit(f)) for f in FLOORS]
    got = sweeps.with_pause(by_floor[0].unionByName(by_floor[1]), ["rec", "arm", "floor_pct"])
    return got.withColumns({"argmin_rms": F.round("argmin_rms", 6), "max_two_row_pct": F.round("max_two_row_pct", 6)})


# --- near-window sweep ------------------------------------------------------------------------
WINS = ", ".join(f"{w}::DOUBLE" for w in P.WINDOW_GRID_M)
add_view("v_winpoints", ("v_points",), f"SELECT *, unnest([{WINS}]) AS win FROM v_points")
add_view(
    "v_winframes",
    ("v_winpoints",),
    f"""SELECT *, max(CASE WHEN win = 5 THEN CAST(cls = 'two_row' AS INT) END) OVER f AS was, max(CASE WHEN win = 5 THEN "offset" END) OVER f AS bo,
          max(CASE WHEN win = 5 THEN n_base END) OVER f AS bn
        FROM ({pair_sql(fit_sql('v_winpoints', K + ', win, side', 'win'), K + ', win')}) WINDOW f AS (PARTITION BY {K})""",
)
add_view(
    "v_winseed",
    ("v_winframes", "v_spine"),
    """SELECT rec, arm, seed, win, any_value(frames) AS frames, count(*) FILTER (two) AS two, sum(was) AS base_two,
         count(*) FILTER (two AND was = 0) AS recovered, count(*) FILTER (NOT two AND was = 1) AS lost,
         count(*) FILTER (two AND was = 0 AND (abs("offset") > 0.71 OR abs(heading) > 6.7 OR abs(mL - mR) > 0.22 OR bn < 12)) AS odd,
         sqrt(avg("offset" * "offset") FILTER (two)) AS full_rms, sqrt(avg("offset" * "offset") FILTER (two AND was = 0)) AS recovered_rms,
         avg(abs("offset" - bo)) FILTER (two AND was = 1) AS shift_mean, max(abs("offset" - bo)) FILTER (two AND was = 1) AS shift_max,
         count(*) FILTER (two AND was = 1) AS kept
       FROM (SELECT *, cls = 'two_row' AS two FROM v_winframes)
         JOIN (SELECT rec, arm, seed, count(*) AS frames FROM v_spine GROUP BY ALL) USING (rec, arm, seed) GROUP BY rec, arm, seed, win""",
)
add_view(
    "v_winsum",
    ("v_winseed",),
    """SELECT rec, arm, win, avg(100.0e0 * two / greatest(frames, 1)) AS two_row_pct, avg(full_rms) AS full_rms,
         avg(100.0e0 * recovered / greatest(frames - base_two, 1)) AS recovery_pct, avg(recovered_rms) AS recovered_rms,
         avg(100.0e0 * lost / greatest(base_two, 1)) AS lost_pct, avg(100.0e0 * odd / greatest(recovered, 1)) AS odd_pct,
         sum(shift_mean * kept) / sum(kept) AS shift_mean, max(shift_max) AS shift_max FROM v_winseed GROUP BY rec, arm, win""",
)
WS = ("two_row_pct", "full_rms", "recovery_pct", "recovered_rms", "lost_pct", "odd_pct", "shift_mean", "shift_max")


def _window_summary(spark, sf):
    per = sweeps.window_sweep(V.points(spark, sf), V.spine(spark, sf), ["rec", "arm"])
    return sweeps.window_summary(per, ["rec", "arm"])


@query("H4_window_sweep", f"SELECT rec, arm, win, {d6(*WS)} FROM v_winsum", ("v_winsum",))
def window_sweep(spark, sf):
    return _window_summary(spark, sf).select("rec", "arm", "win", *r6(*WS))


@query(
    "H4_window_shifts",
    """SELECT rec, arm, win, round(quantile_cont(abs("offset" - bo), 0.5), 6) AS shift_p50,
         round(quantile_cont(abs("offset" - bo), 0.9), 6) AS shift_p90
       FROM v_winframes WHERE cls = 'two_row' AND was = 1 GROUP BY rec, arm, win""",
    ("v_winframes",),
)
def window_shifts(spark, sf):
    key = ["rec", "arm", "win"]
    s = sweeps.window_shifts(V.points(spark, sf), ["rec", "arm"])
    size = SEGMENT_ROWS
    q = quantile_columns(s, key, "shift", {"shift_p50": 0.5, "shift_p90": 0.9})
    return q.select(*key, *r6("shift_p50", "shift_p90"))


@query(
    "H5_window_optimum",
    """SELECT rec, arm, coalesce(max(win) FILTER (full_rms <= base * 1.1e0), 5.0e0) AS optimum_a, max(win) FILTER (pref = 1) AS optimum_b FROM (
         SELECT *, min(pays) OVER (PARTITION BY rec, arm ORDER BY win) AS pref FROM (SELECT *,
           max(CASE WHEN win = 5 THEN full_rms END) OVER (PARTITION BY rec, arm) AS base,
           CAST(coalesce(two_row_pct - lag(two_row_pct) OVER w >= greatest(100.0e0 * (full_rms - lag(full_rms) OVER w), 0),
             lag(win) OVER w IS NULL) AS INT) AS pays FROM v_winsum WINDOW w AS (PARTITION BY rec, arm ORDER BY win)))
       GROUP BY rec, arm""",
    ("v_winsum",),
)
def window_optimum(spark, sf):
    return sweeps.window_optimum(_window_summary(spark, sf), ["rec", "arm"])
