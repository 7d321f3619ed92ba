"""Confusion, image statistics, summaries, integrity and source queries."""

from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.catalog.rowfit import FRAME, K, fit_sql, model_scores, pair_sql
from tracklab.operators import evaluation, integrity, metrics, runs, sweeps
from tracklab.plans import views as V
from tracklab.plans.registry import d6, r6, query
from tracklab.plans.segments import SEGMENT_ROWS
from tracklab.plans.views import add_view
from tracklab.session import stored
from tracklab.sources import readers


# --- confusion --------------------------------------------------------------------------------
add_view(
    "v_pixels",
    (),
    """SELECT l_partkey % 3 AS rec, l_partkey AS i, CASE WHEN l_partkey % 2 = 0 THEN 'bare' ELSE 'canopy' END AS stratum,
         CAST(round(l_tax * 100) AS BIGINT) > 4 AS truth, CAST(round(l_discount * 100) AS BIGINT) > 5 AS pred FROM lineitem""",
)
CONF = "count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (NOT truth AND NOT pred) AS tn"
RATIO = """CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) END AS iou_fg, CASE WHEN tn + fp + fn > 0 THEN tn / (tn + fp + fn) END AS iou_bg,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1"""
CM = ("iou_fg", "iou_bg", "precision", "recall", "f1")


def _pixels(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 3).alias("rec"),
        F.col("l_partkey").alias("i"),
        F.when(F.col("l_partkey") % 2 == 0, "bare").otherwise("canopy").alias("stratum"),
        (F.round(F.col("l_tax") * 100) > 4).alias("truth"),
        (F.round(F.col("l_discount") * 100) > 5).alias("pred"),
    )


@query(
    "F10_confusion_metrics",
    f"""SELECT stratum, tp, fp, fn, tn, {d6(*CM)}, round((iou_fg + iou_bg) / 2, 6) AS miou FROM (SELECT *, {RATIO} FROM (
          SELECT stratum, {CONF} FROM v_pixels GROUP BY stratum))""",
    ("v_pixels",),
)
def confusion_metrics(spark, sf):
    got = evaluation.confusion_metrics(evaluation.confusion(_pixels(spark, sf), ["stratum"]))
    return got.select("stratum", "tp", "fp", "fn", "tn", *r6(*CM, "miou"))


def _frame_metrics(spark, sf):
    return evaluation.confusion_metrics(evaluation.confusion(_pixels(spark, sf), ["stratum", "i"]))


add_view("v_fmetrics", ("v_pixels",), f"SELECT *, {RATIO} FROM (SELECT stratum, i, {CONF} FROM v_pixels GROUP BY stratum, i)")


@query("F11_frame_metrics", f"SELECT stratum, i, {d6(*CM)} FROM v_fmetrics", ("v_fmetrics",))
def frame_metrics(spark, sf):
    return _frame_metrics(spark, sf).select("stratum", "i", *r6(*CM))


@query(
    "F11_frame_metrics_by_stratum",
    "SELECT coalesce(stratum, 'ALL') AS stratum, count(*) AS n, "
    + ", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in CM)
    + " FROM v_fmetrics GROUP BY ROLLUP (stratum)",
    ("v_fmetrics",),
)
def frame_metrics_by_stratum(spark, sf):
    return evaluation.frame_metrics_by_stratum(_frame_metrics(spark, sf), "stratum").select("stratum", "n", *r6(*CM))


# --- overlap ----------------------------------------------------------------------------------
add_view(
    "v_members",
    ("v_fit", "v_frames"),
    "SELECT rec, s.arm || s.seed AS m, i, x, y FROM v_fit s JOIN v_frames f USING (rec, i)",
)
OVL = ("iou", "a_in_b", "b_in_a", "centroid_dist")
add_view(
    "v_overlap",
    ("v_members",),
    """SELECT p.rec, p.a, p.b, inter / (za.n + zb.n - inter) AS iou, inter / za.n AS a_in_b, inter / zb.n AS b_in_a,
         sqrt(power(za.cx - zb.cx, 2) + power(za.cy - zb.cy, 2)) AS centroid_dist
       FROM (SELECT s.rec, s.m AS a, t.m AS b, count(*) AS inter FROM v_members s JOIN v_members t ON s.rec = t.rec AND s.i = t.i AND s.m < t.m
         GROUP BY ALL) p
       JOIN (SELECT rec, m, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM v_members GROUP BY ALL) za ON za.rec = p.rec AND za.m = p.a
       JOIN (SELECT rec, m, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM v_members GROUP BY ALL) zb ON zb.rec = p.rec AND zb.m = p.b""",
)


def _overlap(spark, sf):
    f = V.frames(spark, sf).select("rec", "i", "x", "y")
    m = metrics.fitted(V.scores(spark, sf)).select("rec", F.concat("arm", F.col("seed").cast("string")).alias("m"), "i")
    return evaluation.pairwise_overlap(m.join(f, ["rec", "i"]), ["rec"], "m", "i")


@query("F12_pairwise_overlap", f"SELECT rec, a, b, {d6(*OVL)} FROM v_overlap", ("v_overlap",))
def pairwise_overlap(spark, sf):
    return _overlap(spark, sf).select("rec", "a", "b", *r6(*OVL))


@query(
    "F12_overlap_summary",
    "SELECT rec, round(min(iou), 6) AS iou_min, round(max(iou), 6) AS iou_max, round(avg(iou), 6) AS iou_mean FROM v_overlap GROUP BY rec",
    ("v_overlap",),
)
def overlap_summary(spark, sf):
    return evaluation.overlap_summary(_overlap(spark, sf), ["rec"]).select("rec", *r6("iou_min", "iou_max", "iou_mean"))


# --- image statistics -------------------------------------------------------------------------
CLASSES = {0: "trunk", 1: "pole"}
add_view(
    "v_inst",
    ("v_boxes",),
    "SELECT rec, seed, i, cls, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS area FROM v_boxes",
)
add_view(
    "v_cstats",
    ("v_inst",),
    "SELECT rec, seed, i, "
    + ", ".join(
        f"""count(*) FILTER (cls = {c}) AS {n}_instances, coalesce(sum(area) FILTER (cls = {c}), 0e0) AS {n}_area, avg(cx) FILTER (cls = {c}) AS {n}_mean_x,
            stddev_pop(cx) FILTER (cls = {c}) AS {n}_std_x, count(*) FILTER (cls = {c} AND cx < 320) AS {n}_left, count(*) FILTER (cls = {c} AND cx >= 320) AS {n}_right"""
        for c, n in CLASSES.items()
    )
    + " FROM v_inst GROUP BY rec, seed, i",
)


def _instances(spark, sf):
    b = V.boxes(spark, sf)
    return b.select(
        "rec",
        "seed",
        "i",
        "cls",
        ((F.col("x1") + F.col("x2")) / 2).alias("cx"),
        ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"),
    )


def _stats(spark, sf):
    return evaluation.class_stats(_instances(spark, sf), ["rec", "seed", "i"], CLASSES)


CSI = [f"{n}_{c}" for n in CLASSES.values() for c in ("instances", "left", "right")]
CSD = [f"{n}_{c}" for n in CLASSES.values() for c in ("area", "mean_x", "std_x")]
GE3 = [f"{n}_{s}" for n in CLASSES.values() for s in ("left", "right")]


@query(
    "F13_class_stats",
    f"SELECT rec, seed, i, {', '.join(CSI)}, {', '.join(f'round({c}, 7) AS {c}' for c in CSD)}, {', '.join(f'CAST({c} >= 3 AS INT) AS {c}_ge3' for c in GE3)} FROM v_cstats",
    ("v_cstats",),
)
def class_stats(spark, sf):
    s = _stats(spark, sf)
    return s.select(
        "rec", "seed", "i", *CSI, *[F.round(c, 7).alias(c) for c in CSD], *[F.col(f"{c}_ge3").cast("int").alias(f"{c}_ge3") for c in GE3]
    )


@query(
    "F14_histogram_fixed",
    """SELECT cls, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT cls, unnest(range(64)) AS bin FROM v_inst WHERE cx BETWEEN 0 AND 640) LEFT JOIN (
         SELECT cls, CAST(least(floor(cx / (640.0e0 / 64)), 63) AS BIGINT) AS bin, count(*) AS n FROM v_inst WHERE cx >= 0 AND cx <= 640 GROUP BY ALL)
       USING (cls, bin)""",
    ("v_inst",),
)
def histogram_fixed(spark, sf):
    return evaluation.histogram_fixed(_instances(spark, sf), ["cls"], "cx", 0.0, 640.0, 64)


@query(
    "F14_side_count_histogram",
    """SELECT side, n_side, count(*) AS n FROM (SELECT unnest(['trunk_left', 'trunk_right', 'pole_left', 'pole_right']) AS side,
         unnest([trunk_left, trunk_right, pole_left, pole_right]) AS n_side FROM v_cstats) GROUP BY ALL""",
    ("v_cstats",),
)
def side_count_histogram(spark, sf):
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("n_side")) for c in GE3]))
    return _stats(spark, sf).select(long.alias("s")).select("s.*").groupBy("side", "n_side").agg(F.count(F.lit(1)).alias("n"))


VI = ("trunk_left_pct", "trunk_right_pct", "trunk_both_pct", "pole_both_pct", "combined_both_pct", "mean_trunks", "mean_poles")


@query(
    "F15_viability",
    f"""SELECT coalesce(CAST(seed AS VARCHAR), 'ALL') AS seed, n, n_trunk_fail, n_rescued, {d6(*VI)} FROM (SELECT seed, count(*) AS n,
          100.0e0 * avg(CAST(tl >= 3 AS INT)) AS trunk_left_pct, 100.0e0 * avg(CAST(tr >= 3 AS INT)) AS trunk_right_pct,
          100.0e0 * avg(CAST(t AS INT)) AS trunk_both_pct, 100.0e0 * avg(CAST(pl >= 3 AND pr >= 3 AS INT)) AS pole_both_pct,
          100.0e0 * avg(CAST(c AS INT)) AS combined_both_pct, count(*) FILTER (NOT t) AS n_trunk_fail, count(*) FILTER (NOT t AND c) AS n_rescued,
          avg(trunk_instances) AS mean_trunks, avg(pole_instances) AS mean_poles
        FROM (SELECT *, tl >= 3 AND tr >= 3 AS t, tl + pl >= 3 AND tr + pr >= 3 AS c FROM (SELECT *, trunk_left AS tl, trunk_right AS tr,
          pole_left AS pl, pole_right AS pr FROM v_cstats)) GROUP BY ROLLUP (seed))""",
    ("v_cstats",),
)
def viability(spark, sf):
    return evaluation.viability(_stats(spark, sf), "seed").select("seed", "n", "n_trunk_fail", "n_rescued", *r6(*VI))


SCQ = ("min", "max", "mean", "p25", "p50", "p75", "p90")


@query(
    "F22_score_summary",
    f"""SELECT event_type, n, ge_5, ge_20, {d6(*SCQ)} FROM (SELECT event_type, count(value) AS n, min(value) AS "min", max(value) AS "max", avg(value) AS mean,
          count(*) FILTER (value >= 5) AS ge_5, count(*) FILTER (value >= 20) AS ge_20, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
          quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90 FROM v_events GROUP BY event_type)""",
    ("v_events",),
)
def score_summary(spark, sf):
    e = V.events(spark, sf)
    size = SEGMENT_ROWS
    return evaluation.score_summary(e, ["event_type"], "value", (5, 20), size).select("event_type", "n", "ge_5", "ge_20", *r6(*SCQ))


@query(
    "F22_top_scores",
    """SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
       FROM v_events) WHERE rank <= 15""",
    ("v_events",),
)
def top_scores(spark, sf):
    got = evaluation.top_scores(V.events(spark, sf), ["event_type"], "value", "event_id", 15)
    return got.select("event_type", "event_id", "value", F.col("rank").cast("bigint"))


add_view(
    "v_gaps",
    ("v_scores",),
    """SELECT rec, pair, gap, sd AS summed_sd, abs(gap) > sd AS separated FROM (SELECT rec, unnest(['B-C', 'A-B']) AS pair,
         unnest([b - c, a - b]) AS gap, unnest([sb + sc, sa + sb]) AS sd FROM (SELECT rec,
           any_value(m) FILTER (arm = 'A') AS a, any_value(m) FILTER (arm = 'B') AS b, any_value(m) FILTER (arm = 'C') AS c,
           any_value(s) FILTER (arm = 'A') AS sa, any_value(s) FILTER (arm = 'B') AS sb, any_value(s) FILTER (arm = 'C') AS sc
         FROM (SELECT rec, arm, avg(p) AS m, stddev_pop(p) AS s FROM (SELECT rec, arm, seed, 100.0e0 * avg(CASE WHEN cls = 'two_row' THEN 1.0e0 ELSE 0.0e0 END) AS p
           FROM v_scores GROUP BY ALL) GROUP BY rec, arm) WHERE rec <> 2 GROUP BY rec))""",
)


def _gaps(spark, sf):
    mix = metrics.class_mix_across_seeds(V.scores(spark, sf), ["rec", "arm"])
    held_out = V.frames(spark, sf).select("rec").where("rec = 2").distinct()
    return evaluation.coverage_gaps(mix, held_out)


@query(
    "F23_coverage_gaps",
    "SELECT rec, pair, round(gap, 6) AS gap, round(summed_sd, 6) AS summed_sd, CAST(separated AS INT) AS separated FROM v_gaps",
    ("v_gaps",),
)
def coverage_gaps(spark, sf):
    return _gaps(spark, sf).select("rec", "pair", *r6("gap", "summed_sd"), F.col("separated").cast("int").alias("separated"))


@query(
    "F23_coverage_signs",
    "SELECT pair, count(*) AS n, count(*) FILTER (gap > 0) AS n_positive, count(*) FILTER (separated) AS n_separated FROM v_gaps GROUP BY pair",
    ("v_gaps",),
)
def coverage_signs(spark, sf):
    return evaluation.coverage_signs(_gaps(spark, sf))


CT = ("coverage_all", "coverage_trunk", "base_all", "base_pole", "gain_pp")


@query(
    "F24_coverage_trend",
    f"""SELECT rec, arm, CAST(coverage_all >= 70 AS INT) AS viable, {d6(*CT)} FROM (SELECT *, coverage_all - coverage_trunk AS gain_pp FROM (
          SELECT rec, arm, any_value(two_row_pct) FILTER (cell = 'agnostic') AS coverage_all, any_value(two_row_pct) FILTER (cell = 'trunk_only') AS coverage_trunk,
            any_value(mean_base) FILTER (cell = 'agnostic') AS base_all, any_value(mean_base) FILTER (cell = 'pole_only') AS base_pole
          FROM v_cells GROUP BY rec, arm))""",
    ("v_cells",),
)
def coverage_trend(spark, sf):
    cells = sweeps.config_sweep(V.points(spark, sf), ["rec", "arm"])
    got = evaluation.coverage_trend(cells, ["rec", "arm"])
    return got.select("rec", "arm", F.col("viable").cast("int").alias("viable"), *r6(*CT))


add_view("v_sides7", ("v_points",), fit_sql("v_points", f"{K}, side", "7.0"))
add_view(
    "v_compared",
    ("v_centre", "v_sides7"),
    f"""SELECT n.*, n.cls = 'two_row' AND o.cls = 'two_row' AND abs(n."offset" - o."offset") > 0.1 AS shifted,
          n.cls = 'two_row' AND o.cls = 'two_row' AND abs(n.heading - o.heading) > 5 AS turned, n.cls = 'two_row' AND o.cls <> 'two_row' AS rescued
        FROM ({pair_sql('SELECT * FROM v_sides7', K)}) n JOIN v_centre o USING ({K})""",
)
VS = """count(*) AS n, count(*) FILTER (shifted) AS shifted, count(*) FILTER (turned) AS turned, count(*) FILTER (rescued) AS rescued,
  count(*) FILTER (cls = 'two_row' AND (abs(mL) > 0.3 OR abs(mR) > 0.3)) AS steep, count(*) FILTER (cls = 'two_row' AND abs(mL - mR) > 0.2) AS mismatch,
  count(*) FILTER (cls = 'two_row' AND adj > 0) AS with_adjacent"""


def _compared(spark, sf):
    both = sweeps.window_frames(V.points(spark, sf), FRAME, (P.NEAR_M, 7.0))
    return evaluation.compare_versions(both, 7.0, P.NEAR_M, FRAME)


@query("F25_compare_versions", f"SELECT rec, arm, seed, {VS} FROM v_compared GROUP BY rec, arm, seed", ("v_compared",))
def compare_versions(spark, sf):
    return evaluation.version_summary(_compared(spark, sf), ["rec", "arm", "seed"])


@query(
    "F25_adjacency_by_run",
    """SELECT c.rec, corridor, pass_id, count(*) AS n FROM v_compared c JOIN v_frames f USING (rec, i) WHERE cls = 'two_row' AND adj > 0 GROUP BY ALL""",
    ("v_compared", "v_frames"),
)
def adjacency_by_run(spark, sf):
    f = V.frames(spark, sf).select("rec", "i", "corridor", "pass_id")
    hit = _compared(spark, sf).where("cls = 'two_row' and adj > 0").join(f, ["rec", "i"])
    return hit.groupBy("rec", "corridor", "pass_id").agg(F.count(F.lit(1)).alias("n"))


# --- threshold sweep --------------------------------------------------------------------------
GRID = [round(0.1 * k, 1) for k in range(1, 10)]
add_view(
    "v_elements",
    ("v_boxes",),
    """SELECT rec, i, l_linenumber AS element, max(conf) FILTER (cls = 1) AS conf, max(y2) > 260 AS truth FROM v_boxes GROUP BY rec, i, l_linenumber""",
)
add_view(
    "v_curve",
    ("v_elements",),
    f"""SELECT rec, i, threshold, CASE WHEN pr + gt - it > 0 THEN it / (pr + gt - it) END AS iou FROM (SELECT rec, i, threshold,
          count(*) FILTER (truth) AS gt, count(*) FILTER (conf >= threshold) AS pr, count(*) FILTER (truth AND conf >= threshold) AS it
        FROM v_elements, (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GRID)}]) AS threshold) GROUP BY rec, i, threshold)""",
)


def _curve_rows(spark, sf):
    e = V.boxes(spark, sf).groupBy("rec", "i", F.col("l_linenumber").alias("element")).agg(
        F.max(F.when(F.col("cls") == 1, F.col("conf"))).alias("conf"), (F.max("y2") > 260).alias("truth")
    )
    return sweeps.threshold_sweep(e, ["rec", "i"], GRID)


@query(
    "H3_threshold_sweep",
    """SELECT rec, threshold, round(avg(iou), 6) AS mean_iou, count(*) FILTER (iou < 0.1) AS n_catastrophic, count(iou) AS n,
         round(quantile_cont(iou, 0.5), 6) AS median_iou FROM v_curve GROUP BY rec, threshold""",
    ("v_curve",),
)
def threshold_sweep(spark, sf):
    from tracklab.plans.quantiles import quantile_columns

    rows = _curve_rows(spark, sf)
    size = SEGMENT_ROWS
    med = quantile_columns(rows, ["rec", "threshold"], "iou", {"median_iou": 0.5})
    got = sweeps.threshold_curve(rows, ["rec"]).join(med, ["rec", "threshold"])
    return got.select("rec", "threshold", "n_catastrophic", "n", *r6("mean_iou", "median_iou"))


@query(
    "H3_best_threshold",
    """SELECT rec, threshold, round(m, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY m DESC, threshold) AS r FROM (
         SELECT rec, threshold, avg(iou) AS m FROM v_curve GROUP BY rec, threshold)) WHERE r = 1""",
    ("v_curve",),
)
def best_threshold(spark, sf):
    got = sweeps.best_threshold(sweeps.threshold_curve(_curve_rows(spark, sf), ["rec"]), ["rec"])
    return got.withColumn("value", F.round("value", 6))


# --- integrity --------------------------------------------------------------------------------
ARTEFACTS = ("click", "view", "purchase", "error", "signup", "refund")


@query(
    "K1_completeness",
    f"""SELECT rec, artefact FROM (SELECT DISTINCT rec, unnest({list(ARTEFACTS)!r}) AS artefact FROM v_events) e
        WHERE NOT EXISTS (SELECT 1 FROM v_events p WHERE p.rec = e.rec AND p.event_type = artefact) AND NOT (artefact = 'refund' AND rec % 5 = 0)""",
    ("v_events",),
)
def completeness(spark, sf):
    e = V.events(spark, sf)
    recs = e.select("rec").distinct()
    exempt = recs.where("rec % 5 = 0").withColumn("artefact", F.lit("refund"))
    return integrity.completeness(recs, e.select("rec", F.col("event_type").alias("artefact")), ARTEFACTS, exempt)


@query(
    "K2_table_parity",
    """WITH l AS (SELECT arm, seed, i, n_base FROM v_scores), r AS (SELECT arm, seed, i, CASE WHEN n_base = 5 THEN 6 ELSE n_base END AS n_base FROM v_scores)
       SELECT arm, seed, i, n_base, 'left' AS side, 1 AS copies FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)
       UNION ALL SELECT arm, seed, i, n_base, 'right', 1 FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""".replace("WITH l AS", ", l AS", 1),
    ("v_scores",),
)
def table_parity(spark, sf):
    left = V.scores(spark, sf).select("arm", "seed", "i", "n_base")
    right = left.withColumn("n_base", F.when(F.col("n_base") == 5, 6).otherwise(F.col("n_base"))).withColumn("arm", F.lower("arm"))
    got = integrity.table_parity(left, right, {"arm": F.upper("arm")})
    return got.withColumn("copies", F.col("copies").cast("int"))


@query(
    "K3_backfill_additive",
    """SELECT s.rec, arm, seed, i, n_base, run, round(pos, 6) AS pos, 0 AS n_drift FROM v_scores s LEFT JOIN v_pos p USING (rec, i)""",
    ("v_scores", "v_pos"),
)
def backfill_additive(spark, sf):
    from tracklab.catalog.comparison import positions

    before = V.scores(spark, sf).select("rec", "arm", "seed", "i", "n_base")
    extra = positions(spark, sf)[0]
    after = integrity.backfill_additive(integrity.backfill_additive(before, extra, ["rec", "i"]), extra, ["rec", "i"])
    drift = integrity.prove_unchanged(before, after, ["run", "pos"]).groupBy("rec").agg(F.count(F.lit(1)).alias("_d"))
    out = after.join(drift, "rec", "left").withColumn("n_drift", F.coalesce("_d", F.lit(0)).cast("int"))
    return out.select("rec", "arm", "seed", "i", "n_base", "run", F.round("pos", 6).alias("pos"), "n_drift")


MARKS = {"DEAD": r"^(La|Le|An|On) ", "PARTIAL": r"^[A-Z][a-z]{1,4} ", "AMENDED": r"^[A-M]"}
add_view(
    "v_lines_log",
    (),
    f"""SELECT conv_id, section, line, greatest(CASE WHEN regexp_matches(line, '{MARKS['AMENDED']}') THEN 1 ELSE 0 END,
          CASE WHEN regexp_matches(line, '{MARKS['PARTIAL']}') THEN 2 ELSE 0 END, CASE WHEN regexp_matches(line, '{MARKS['DEAD']}') THEN 3 ELSE 0 END) AS rk
        FROM (SELECT conv_id, section, unnest(string_split(text, chr(10))) AS line FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
          OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations) WHERE section IS NOT NULL)""",
)


def _status(spark, sf):
    c = V.table(spark, sf, "conversations")
    size = SEGMENT_ROWS
    return integrity.resolve_status(c, ["conv_id"], "turn", F.col("role") == "user", MARKS, r"\b([a-z]{3})\.", size)


@query(
    "K4_resolve_status",
    """SELECT conv_id, section, CASE max(rk) WHEN 3 THEN 'DEAD' WHEN 2 THEN 'PARTIAL' WHEN 1 THEN 'AMENDED' ELSE 'CURRENT' END AS state,
         count(*) FILTER (rk > 0) AS n_markers, count(*) AS n_lines FROM v_lines_log GROUP BY conv_id, section""",
    ("v_lines_log",),
)
def resolve_status(spark, sf):
    return _status(spark, sf)[0]


@query(
    "K4_retired_ids",
    r"""SELECT DISTINCT conv_id, section, unnest(regexp_extract_all(line, '(?:^|[^A-Za-z0-9_])([a-z]{3})\.', 1)) AS retired FROM v_lines_log""",
    ("v_lines_log",),
)
def retired_ids(spark, sf):
    c = V.table(spark, sf, "conversations")
    size = SEGMENT_ROWS
    pattern = r"(?:^|[^A-Za-z0-9_])([a-z]{3})\."
    return integrity.resolve_status(c, ["conv_id"], "turn", F.col("role") == "user", MARKS, pattern, size)[1]


@query(
    "K4_stale_status",
    """SELECT conv_id, section, CASE max(rk) WHEN 3 THEN 'DEAD' WHEN 2 THEN 'PARTIAL' WHEN 1 THEN 'AMENDED' ELSE 'CURRENT' END AS state, 'CURRENT' AS stored
       FROM v_lines_log GROUP BY conv_id, section HAVING max(rk) > 0""",
    ("v_lines_log",),
)
def stale_status(spark, sf):
    now = stored(_status(spark, sf)[0])
    noted = now.select("conv_id", "section", F.lit("CURRENT").alias("state"))
    return integrity.stale_status(now, noted, ["conv_id", "section"])


# --- sources ----------------------------------------------------------------------------------
@query(
    "A1_metric_rows",
    """SELECT rec, arm, seed, i, round("offset", 6) AS "offset", round(heading, 6) AS heading, CAST(len(flags) AS INT) AS n_flags FROM v_fit""",
    ("v_fit",),
)
def metric_rows(spark, sf):
    raw = V.scores(spark, sf).withColumn("flags", F.array_join("flags", "|"))
    got = readers.metric_rows(readers.with_flags(raw))
    return got.select("rec", "arm", "seed", "i", *r6("offset", "heading"), F.size("flags").alias("n_flags"))


@query(
    "A2_parse_frames",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def parse_frames(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("props"))
    return readers.parse_frames(e, "props", "ARRAY<STRUCT<k: BIGINT>>")


@query(
    "A3_annotations",
    """SELECT o_orderkey AS id, count(l_orderkey) AS n, coalesce(CAST(sum(l_linenumber) AS BIGINT), 0) AS s
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def annotations(spark, sf):
    images = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("img_"), F.col("o_orderkey").cast("string")).alias("file_name"))
    anns = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber").alias("annotation"))
    got = readers.join_annotations(images, anns, ["id"])
    return got.groupBy("id").agg(
        F.count("annotation").alias("n"), F.coalesce(F.sum("annotation.l_linenumber"), F.lit(0)).alias("s")
    )


@query(
    "A4_merge_sources",
    "SELECT rec, event_id, row_number() OVER (PARTITION BY rec ORDER BY us, event_id) - 1 AS i FROM v_events",
    ("v_events",),
)
def merge_sources(spark, sf):
    e = V.events(spark, sf).withColumn("session", F.lit("2024"))
    parts = [e.where(F.col("event_type").isin("click", "view")), e.where(~F.col("event_type").isin("click", "view"))]
    got = readers.merge_sources(
        parts, ["rec"], ["us", "event_id"], "session"
    )
    return got.select("rec", "event_id", "i")


@query(
    "A5_scope",
    """SELECT 'eligible' AS scope, rec, i FROM v_frames WHERE eligible UNION ALL SELECT 'non_in_row', rec, i FROM v_frames WHERE headland AND NOT contaminated""",
    ("v_frames",),
)
def scope(spark, sf):
    f = V.frames(spark, sf)
    parts = [runs.scope(f, s).select(F.lit(s).alias("scope"), "rec", "i") for s in ("eligible", "non_in_row")]
    return parts[0].unionByName(parts[1])


@query("A6_topic", "SELECT event_id, user_id, value FROM events WHERE event_type = 'view'")
def topic(spark, sf):
    return readers.topic(V.table(spark, sf, "events"), "view", "event_type").select("event_id", "user_id", "value")


@query("A7_report")
def report(spark, sf):
    from tracklab.sources.reports import nest

    m = metrics.model_metrics(V.scores(spark, sf), ["rec", "arm", "seed"])
    return nest(m, "rec", ["arm", "seed"])


IN = ("duration_s", "mean", "sd")


@query(
    "A8_source_inventory",
    f"""SELECT rec, event_type, n, "min", "max", CAST("min" = "max" AS INT) AS flat, {d6(*IN)} FROM (SELECT rec, event_type, count(*) AS n,
          (max(us) - min(us)) / 1e6 AS duration_s, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS "min", max(value) AS "max"
        FROM v_events GROUP BY rec, event_type)""",
    ("v_events",),
)
def source_inventory(spark, sf):
    got = integrity.inventory(V.events(spark, sf), ["rec", "event_type"], "value", "us")
    return got.select("rec", "event_type", "n", "min", "max", F.col("flat").cast("int").alias("flat"), *r6(*IN))


@query(
    "A8_rows_at_fractions",
    """SELECT rec, fraction, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY us, event_id) - 1 AS k,
         count(*) OVER (PARTITION BY rec) AS n FROM v_events) e JOIN (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS fraction) f
       ON k = floor(fraction * (n - 1))""",
    ("v_events",),
)
def rows_at_fractions(spark, sf):
    e = V.events(spark, sf)
    got = integrity.at_fractions(
        e, ["rec"], ["us", "event_id"], (0.0, 0.25, 0.5, 0.75, 1.0)
    )
    return got.select("rec", "fraction", "event_id", "value")
