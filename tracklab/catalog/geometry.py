"""Geometry, interval and surveyed-reference queries."""

from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.functions import geometry as G
from tracklab.functions import names
from tracklab.operators import intervals, lookups, reference, sweeps
from tracklab.operators.metrics import fitted
from tracklab.plans import views as V
from tracklab.plans.registry import d6, d9, r6, r9, query
from tracklab.plans.segments import SEGMENT_ROWS
from tracklab.plans.views import add_view


def lit(x: float) -> str:
    return f"({float(x)!r}::DOUBLE)"


def ground_sql(u: str, v: str, cal: G.Calibration, near: float, src: str, keep: str) -> str:
    g = cal.ground
    d = [f"{lit(g[n][0])} * ({u}) + {lit(g[n][1])} * ({v}) + {lit(g[n][2])}" for n in range(3)]
    px, py, pz = cal.position
    return f"""SELECT {keep}, X, Y FROM (SELECT *, {lit(px)} + {lit(-pz)} / dz * dx AS X, {lit(py)} + {lit(-pz)} / dz * dy AS Y
      FROM (SELECT *, {d[0]} AS dx, {d[1]} AS dy, {d[2]} AS dz FROM {src}) WHERE dz < -1e-6) WHERE X > 0 AND X < {near}"""


BOX_KEY = "rec, seed, i, l_orderkey, l_linenumber"
BK = ["rec", "seed", "i", "l_orderkey", "l_linenumber"]
add_view("v_px", ("v_boxes",), "SELECT *, (x1 + x2) / 2 AS u, y2 AS v, (x2 - x1) * (y2 - y1) / 409600.0e0 AS frac FROM v_boxes")


def _boxes(spark, sf):
    u, v = G.base_point("box")
    return V.boxes(spark, sf).withColumns({"u": u, "v": v, "frac": G.area_fraction()})


@query(
    "B1_project_px",
    f"SELECT {BOX_KEY}, {d6('X', 'Y')} FROM ({ground_sql('u', 'v', G.FIRST_SITE, 8.0, 'v_px', '*')})",
    ("v_px",),
)
def project_px(spark, sf):
    b = _boxes(spark, sf).withColumn("g", G.project_px(F.col("u"), F.col("v"), G.FIRST_SITE)).where("g is not null")
    return b.select(*BK, "g.*").select(*BK, *r6("X", "Y"))


def px_sql(cal, x, y, src, keep):
    import numpy as np

    back = np.array(cal.rotation).T
    px, py, pz = cal.position
    ray = [f"{lit(back[n][0])} * ({x} - {lit(px)}) + {lit(back[n][1])} * ({y} - {lit(py)}) + {lit(back[n][2])} * (0.0e0 - {lit(pz)})" for n in range(3)]
    k = cal.k
    return f"""SELECT {keep}, ({lit(k[0][0])} * r0 / r2 + {lit(k[0][2])}) * {lit(640 / cal.width)} AS u,
      ({lit(k[1][1])} * r1 / r2 + {lit(k[1][2])}) * {lit(640 / cal.height)} AS v
      FROM (SELECT *, {ray[0]} AS r0, {ray[1]} AS r1, {ray[2]} AS r2 FROM {src}) WHERE r2 > 1e-6"""


@query(
    "B2_project_ground",
    f"SELECT rec, arm, seed, i, ok, ln, {d6('u', 'v')} FROM ({px_sql(G.FIRST_SITE, 'X', 'Y', '(SELECT *, o[1] AS ok, o[2] AS ln FROM v_points)', '*')})",
    ("v_points",),
)
def project_ground(spark, sf):
    p = V.points(spark, sf).withColumn("g", G.project_ground(F.col("X"), F.col("Y"), G.FIRST_SITE)).where("g is not null")
    return p.select(
        "rec", "arm", "seed", "i", F.col("o.l_orderkey").alias("ok"), F.col("o.l_linenumber").alias("ln"), "g.*"
    ).select("rec", "arm", "seed", "i", "ok", "ln", *r6("u", "v"))


@query(
    "B3_second_site_projection",
    f"SELECT {BOX_KEY}, {d6('X', 'Y')} FROM ({ground_sql('u', 'v', G.SECOND_SITE, 8.0, 'v_px', '*')})",
    ("v_px",),
)
def second_site(spark, sf):
    b = _boxes(spark, sf).withColumn("g", G.project_px(F.col("u"), F.col("v"), G.SECOND_SITE)).where("g is not null")
    return b.select(*BK, "g.*").select(*BK, *r6("X", "Y"))


@query(
    "E1_side_points",
    f"""SELECT rec, seed, i, CASE WHEN u < 320 THEN 'L' ELSE 'R' END AS side, count(*) AS n, round(avg(X), 6) AS mean_x, round(avg(Y), 6) AS mean_y
        FROM ({ground_sql('u', 'v', G.FIRST_SITE, 10.0, '(SELECT * FROM v_px WHERE frac <= 0.15)', '*')}) GROUP BY ALL""",
    ("v_px",),
)
def side_points(spark, sf):
    b = _boxes(spark, sf).where(G.size_guard(F.col("frac")) != "drop")
    g = G.project_px(F.col("u"), F.col("v"), G.FIRST_SITE, P.FAR_M)
    b = b.withColumns({"g": g, "side": F.when(F.col("u") < P.MID_PX, "L").otherwise("R")}).where("g is not null")
    return b.groupBy("rec", "seed", "i", "side").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("g.X"), 6).alias("mean_x"), F.round(F.avg("g.Y"), 6).alias("mean_y")
    )


@query(
    "B4_to_local_xy",
    """SELECT i, round((lon - lon0) * (111320.0e0 * cos(radians(lat0))), 6) AS x, round((lat - lat0) * 110540.0e0, 6) AS y
       FROM (SELECT c_custkey AS i, c_nationkey % 2 AS site, c_acctbal / 1e6 AS lon, 53.0e0 + (c_custkey % 55) * 1e-5 AS lat FROM customer)
       JOIN (SELECT c_nationkey % 2 AS site, avg(c_acctbal / 1e6) AS lon0, avg(53.0e0 + (c_custkey % 55) * 1e-5) AS lat0 FROM customer GROUP BY 1)
       USING (site)""",
)
def to_local_xy(spark, sf):
    c = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("i"),
        (F.col("c_nationkey") % 2).alias("site"),
        (F.col("c_acctbal") / 1e6).alias("lon"),
        (53.0 + (F.col("c_custkey") % 55) * 1e-5).alias("lat"),
    )
    origin = c.groupBy("site").agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))
    xy = G.to_local_xy(*[F.col(n) for n in ("lon", "lat", "lon0", "lat0")])
    return c.join(origin, "site").select("i", xy.alias("p")).select("i", "p.*").select("i", *r6("x", "y"))


PERP = """SELECT *, ((py - (ay + tt * (yb - ay))) * (bx - ax) - (px - (ax + tt * (bx - ax))) * (yb - ay)) / sqrt(n2) AS off,
    sqrt(power(px - (ax + tt * (bx - ax)), 2) + power(py - (ay + tt * (yb - ay)), 2)) AS dist, degrees(atan2(bx - ax, yb - ay)) AS bearing
  FROM (SELECT *, greatest(least(((px - ax) * (bx - ax) + (py - ay) * (yb - ay)) / n2, 1), 0) AS tt
    FROM (SELECT *, power(bx - ax, 2) + power(yb - ay, 2) AS n2 FROM {src}))"""


@query(
    "B5_signed_perp",
    f"SELECT i, line_id, {d9('off', 'dist', 'bearing')} FROM ({PERP.format(src='(SELECT t.*, l.* FROM v_track t JOIN v_lines l ON l.line_id = t.i % 25)')})",
    ("v_track", "v_lines"),
)
def signed_perp(spark, sf):
    t = V.track(spark, sf).withColumn("line_id", F.col("i") % 25).join(V.lines(spark, sf), "line_id")
    s = G.signed_perp(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")])
    return t.select("i", "line_id", s.alias("s")).select("i", "line_id", "s.*").select("i", "line_id", *r9("off", "dist", "bearing"))


VIEWXY = "-((({x}) - px) * sin(h) + (({y}) - py) * cos(h)) AS {a}, (({x}) - px) * cos(h) - (({y}) - py) * sin(h) AS {b}"


@query(
    "B6_enu_to_view",
    f"SELECT i, round(X, 9) AS X, round(Y, 9) AS Y FROM (SELECT i, {VIEWXY.format(x='2.45e0 * (i % 25)', y='25.0e0', a='X', b='Y')} FROM (SELECT *, radians(degrees(atan2(hx, hy))) AS h FROM v_track))",
    ("v_track",),
)
def enu_to_view(spark, sf):
    t = V.track(spark, sf)
    v = G.enu_to_view(2.45 * (F.col("i") % 25), F.lit(25.0), F.col("px"), F.col("py"), F.degrees(F.atan2("hx", "hy")))
    return t.select("i", v.alias("v")).select("i", "v.*").select("i", *r9("X", "Y"))


FOLD = """CASE WHEN abs(d) > 90 THEN d - 180.0e0 * sign(d) ELSE d END"""


@query(
    "B7_wrap_fold",
    f"""SELECT rec, event_id, round({FOLD}, 6) AS d FROM (SELECT rec, event_id, ((q % 360) + 360) % 360 - 180.0e0 AS d FROM (
          SELECT rec, event_id, value * 11 - (event_id % 720) + 180.0e0 AS q FROM v_events))""",
    ("v_events",),
)
def wrap_fold(spark, sf):
    d = G.wrap_fold(F.col("value") * 11, (F.col("event_id") % 720).cast("double"))
    return V.events(spark, sf).select("rec", "event_id", F.round(d, 6).alias("d"))


STRATA = (("src1", "bare"), ("src", "canopy"))


@query(
    "B8_group_id_stratum",
    """SELECT doc_id, gid, CASE WHEN starts_with(source, 'src1') THEN 'bare' ELSE 'canopy' END AS stratum FROM (
         SELECT doc_id, source, source || '_' || (doc_id % 40) AS gid FROM documents)""",
)
def group_id_stratum(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    name = F.concat_ws("_", F.col("source"), (F.col("doc_id") % 40).cast("string"))
    d = d.withColumn("name", F.concat(name, F.lit("_png.rf."), F.col("h"), F.lit(".jpg")))
    return d.select("doc_id", names.group_id(F.col("name")).alias("gid"), names.stratum(F.col("name"), STRATA).alias("stratum"))


CLASS_MAP = {"click": 0, "view": 0, "purchase": 1}


@query(
    "B9_collapse_classes",
    """SELECT rec, class_id, count(*) AS n FROM (SELECT rec, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 END AS class_id
       FROM v_events) WHERE class_id IS NOT NULL GROUP BY ALL""",
    ("v_events",),
)
def collapse_classes(spark, sf):
    got = names.collapse_classes(V.events(spark, sf), "event_type", CLASS_MAP)
    return got.groupBy("rec", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "B10_base_point",
    f"""SELECT {BOX_KEY}, {d6('u', 'v', 'cu', 'cv')} FROM (SELECT *, x1 + (x2 - x1) / 2.0e0 AS cu, y1 + (y2 - y1) - 1 AS cv FROM v_px
        WHERE (x2 - x1) * (y2 - y1) >= 40)""",
    ("v_px",),
)
def base_point(spark, sf):
    b = _boxes(spark, sf).withColumns({"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    cu, cv = G.base_point("component")
    b = b.where(F.col("w") * F.col("h") >= P.MIN_COMPONENT_PX).withColumns({"cu": cu, "cv": cv})
    return b.select(*BK, *r6("u", "v", "cu", "cv"))


@query(
    "B11_size_guard",
    f"""SELECT {BOX_KEY}, CASE WHEN frac > 0.15 THEN 'drop' WHEN frac > 0.10 THEN 'near' ELSE 'keep' END AS guard FROM v_px""",
    ("v_px",),
)
def size_guard(spark, sf):
    return _boxes(spark, sf).select(*BK, G.size_guard(F.col("frac")).alias("guard"))


@query(
    "F16_guard_audit",
    """SELECT rec, seed, count(*) AS n_dets, count(*) FILTER (frac > 0.15) AS n_dropped, count(*) FILTER (frac > 0.1 AND frac <= 0.15) AS n_near,
         count(DISTINCT i) FILTER (frac > 0.1) AS n_frames, round(max(frac), 6) AS max_fraction FROM v_px GROUP BY rec, seed""",
    ("v_px",),
)
def guard_audit(spark, sf):
    g = _boxes(spark, sf).withColumn("guard", G.size_guard(F.col("frac")))
    per = g.groupBy("rec", "seed", "i").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("guard") == "drop").alias("d"),
        F.count_if(F.col("guard") == "near").alias("k"),
        F.max("frac").alias("m"),
    )
    return per.groupBy("rec", "seed").agg(
        F.sum("n").alias("n_dets"),
        F.sum("d").alias("n_dropped"),
        F.sum("k").alias("n_near"),
        F.count_if(F.col("d") + F.col("k") > 0).alias("n_frames"),
        F.round(F.max("m"), 6).alias("max_fraction"),
    )


@query(
    "B12_band",
    "SELECT event_id, CASE WHEN s <= 40 THEN 'absent' WHEN s >= 200 THEN 'present' ELSE 'needs_review' END AS verdict FROM (SELECT event_id, floor(value * 4) AS s FROM v_events)",
    ("v_events",),
)
def band(spark, sf):
    return V.events(spark, sf).select("event_id", G.band(F.floor(F.col("value") * 4)).alias("verdict"))


@query(
    "B13_assumption_budget",
    "SELECT i, round(abs(vy) + 2.0e0 * tan(radians(abs(yaw_imu) * 50)), 6) AS budget FROM v_frames",
    ("v_frames",),
)
def assumption_budget(spark, sf):
    b = G.assumption_budget(F.abs("vy"), F.abs("yaw_imu") * 50)
    return V.frames(spark, sf).select("i", F.round(b, 6).alias("budget"))


# --- intervals and screens --------------------------------------------------------------------
HALF = 3
add_view(
    "v_lengths_rec",
    ("v_series",),
    "SELECT rec, count(*) AS n FROM v_series GROUP BY rec",
)
add_view(
    "v_merged",
    ("v_series", "v_lengths_rec"),
    f"""SELECT g.rec, greatest(min(i) - {HALF}, 0) AS a, least(max(i) + {HALF}, any_value(n) - 1) AS b FROM (
          SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY i) AS g FROM (SELECT *,
            CASE WHEN i - {HALF} > lag(i) OVER (PARTITION BY rec ORDER BY i) + {HALF} + 1 THEN 1 ELSE 0 END AS nw FROM v_series WHERE contaminated)) g
        JOIN v_lengths_rec USING (rec) GROUP BY g.rec, g""",
)


def _merged(spark, sf):
    size = SEGMENT_ROWS
    s = V.series(spark, sf)
    n = s.groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    return intervals.merge_intervals(s.where("contaminated"), n, ["rec"], HALF, size), s, size


@query("D1_merge_intervals", "SELECT rec, a, b FROM v_merged", ("v_merged",))
def merge_intervals(spark, sf):
    return _merged(spark, sf)[0]


@query(
    "D2_flag_in_intervals",
    "SELECT s.rec, s.i, CAST(m.a IS NOT NULL AS INT) AS inside FROM v_series s LEFT JOIN v_merged m ON s.rec = m.rec AND s.i BETWEEN m.a AND m.b",
    ("v_series", "v_merged"),
)
def flag_in_intervals(spark, sf):
    m, s, size = _merged(spark, sf)
    got = intervals.flag_in_intervals(s.select("rec", "i"), m, ["rec"], size=size)
    return got.select("rec", "i", F.col("inside").cast("int"))


#: A box so much taller than wide stands for a detection of the target class, 2.
UPRIGHT = 16.5
add_view(
    "v_screen",
    ("v_px",),
    f"""SELECT rec, i, count(*) AS n_hits, max(conf) AS max_conf, max(frac) AS max_fraction, max(frac) < 0.001 AS likely_distant
       FROM v_px WHERE y2 - y1 > {UPRIGHT} * (x2 - x1) AND conf >= 0.2e0 GROUP BY rec, i""",
)


def _screen(spark, sf):
    """All boxes are screened."""
    target = F.col("y2") - F.col("y1") > UPRIGHT * (F.col("x2") - F.col("x1"))
    return intervals.screen(V.boxes(spark, sf).withColumn("cls", F.when(target, 2).otherwise(F.col("cls"))), ["rec", "i"], 2)


@query(
    "D5_screen",
    "SELECT rec, i, n_hits, max_conf, round(max_fraction, 6) AS max_fraction, CAST(likely_distant AS INT) AS likely_distant FROM v_screen",
    ("v_screen",),
)
def screen(spark, sf):
    return _screen(spark, sf).withColumns({"max_fraction": F.round("max_fraction", 6), "likely_distant": F.col("likely_distant").cast("int")})


@query(
    "D4_exclude_flagged",
    "SELECT rec, arm, seed, i FROM v_scores s WHERE NOT EXISTS (SELECT 1 FROM v_screen c WHERE c.rec = s.rec AND c.i = s.i)",
    ("v_scores", "v_screen"),
)
def exclude_flagged(spark, sf):
    done = V.boxes(spark, sf).select("rec").distinct()
    rows = V.scores(spark, sf).select("rec", "arm", "seed", "i")
    return intervals.exclude_flagged(rows, _screen(spark, sf), done, ["rec", "i"])


@query(
    "D6_even_sample",
    """SELECT rec, arm, seed, i FROM (SELECT *, row_number() OVER (PARTITION BY rec, arm, seed ORDER BY i) - 1 AS k,
         count(*) OVER (PARTITION BY rec, arm, seed) AS n FROM v_scores WHERE cls = 'two_row')
       WHERE k IN (SELECT CAST(floor(j * (n - 1) / 5.0e0) AS BIGINT) FROM (SELECT unnest(range(6)) AS j))""",
    ("v_scores",),
)
def even_sample(spark, sf):
    rows = V.scores(spark, sf).where("cls = 'two_row'").select("rec", "arm", "seed", "i")
    size = SEGMENT_ROWS
    return lookups.even_sample(rows, ["rec", "arm", "seed"], "i", 6, size)


VERDICT = "CASE WHEN s <= 15 THEN 'absent' WHEN s >= 30 THEN 'present' ELSE 'needs_review' END"
add_view(
    "v_verdicts",
    ("v_events",),
    f"SELECT rec, event_id, {VERDICT} AS verdict FROM (SELECT rec, event_id, floor(value * 2) AS s FROM v_events WHERE event_type = 'view')",
)
add_view(
    "v_confirmed",
    ("v_verdicts",),
    """SELECT rec, event_id, CASE WHEN u THEN decision ELSE verdict END AS verdict, u AS confirmed FROM (SELECT *,
         coalesce(verdict = 'needs_review' AND decision IN ('present', 'absent'), false) AS u FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'present'
           WHEN event_id % 3 = 1 THEN 'absent' END AS decision FROM v_verdicts))""",
)


def _confirmed(spark, sf):
    e = V.events(spark, sf).where("event_type = 'view'")
    v = e.select("rec", "event_id", G.band(F.floor(F.col("value") * 2), 15, 30).alias("verdict"))
    d = e.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, "present").when(F.col("event_id") % 3 == 1, "absent").alias("decision")
    ).where("decision is not null")
    return intervals.apply_confirmations(v, d, "event_id")


@query("D7_apply_confirmations", "SELECT rec, event_id, verdict, CAST(confirmed AS INT) AS confirmed FROM v_confirmed", ("v_confirmed",))
def apply_confirmations(spark, sf):
    return _confirmed(spark, sf).withColumn("confirmed", F.col("confirmed").cast("int"))


@query(
    "D7_gate_status",
    """SELECT rec, CASE WHEN bool_or(verdict = 'needs_review') THEN 'needs_review' ELSE 'clear' END AS status,
         count(*) FILTER (verdict = 'present') AS n_present, count(*) FILTER (verdict = 'needs_review') AS n_needs_review,
         count(*) FILTER (verdict = 'absent') AS n_absent FROM v_confirmed GROUP BY rec""",
    ("v_confirmed",),
)
def gate_status(spark, sf):
    return intervals.gate_status(_confirmed(spark, sf), ["rec"])


@query(
    "D9_median_representative",
    """SELECT rec, round(median, 6) AS median, i, n_base FROM (SELECT s.*, median, row_number() OVER (PARTITION BY s.rec, s.arm
           ORDER BY abs(n_base - median), i) AS r FROM v_scores s JOIN (SELECT rec, arm, quantile_cont(n_base, 0.5) AS median FROM v_scores
             WHERE seed = 42 GROUP BY rec, arm) m ON m.rec = s.rec AND m.arm = s.arm
         WHERE s.seed = 42 AND s.arm = 'A' AND cls <> 'none') WHERE r = 1""",
    ("v_scores",),
)
def median_representative(spark, sf):
    rows = V.scores(spark, sf).where("seed = 42 and arm = 'A'")
    size = SEGMENT_ROWS
    got = lookups.median_representative(rows, ["rec"], "n_base", "i", F.col("cls") == "none", size)
    return got.withColumn("median", F.round("median", 6))


RULES = (
    ("dense", "r_n >= 30", "-r_n"),
    ("sparse", "r_n <= 26", "r_n"),
    ("dense_again", "r_n >= 30", "-r_n"),
    ("late", "r_n >= 28", "-i"),
)


@query(
    "D11_pick_by_rules",
    """WITH c AS (SELECT l_partkey AS i, count(*) AS r_n FROM lineitem GROUP BY 1),
         r0 AS (SELECT i FROM c WHERE r_n >= 30 ORDER BY -r_n, i LIMIT 1),
         r1 AS (SELECT i FROM c WHERE r_n <= 26 AND i NOT IN (SELECT i FROM r0) ORDER BY r_n, i LIMIT 1),
         r2 AS (SELECT i FROM c WHERE r_n >= 30 AND i NOT IN (SELECT i FROM r0) AND i NOT IN (SELECT i FROM r1) ORDER BY -r_n, i LIMIT 1),
         r3 AS (SELECT i FROM c WHERE r_n >= 28 AND i NOT IN (SELECT i FROM r0) AND i NOT IN (SELECT i FROM r1) AND i NOT IN (SELECT i FROM r2)
           ORDER BY -i, i LIMIT 1)
       SELECT 0 AS rule_no, 'dense' AS rule, i AS id FROM r0 UNION ALL SELECT 1, 'sparse', i FROM r1
       UNION ALL SELECT 2, 'dense_again', i FROM r2 UNION ALL SELECT 3, 'late', i FROM r3""",
)
def pick_by_rules(spark, sf):
    c = V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("i")).agg(F.count(F.lit(1)).alias("r_n"))
    return lookups.pick_by_rules(c, [(n, F.expr(w), F.expr(o)) for n, w, o in RULES], "i")


# --- surveyed lines ---------------------------------------------------------------------------
add_view(
    "v_near",
    ("v_track", "v_lines"),
    f"""SELECT *, CASE WHEN hx * (bx - ax) + hy * (yb - ay) > 0 THEN -off ELSE off END AS true_offset FROM (
          SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(off), line_id) AS r FROM
            ({PERP.format(src='(SELECT t.*, l.* FROM v_track t, v_lines l)')}) WHERE abs(off) <= 1.6) WHERE r = 1""",
)


def _near(spark, sf):
    return reference.nearest_line(V.track(spark, sf), V.lines(spark, sf))


@query("D3_nearest_line", f"SELECT i, line_id, {d9('true_offset', 'bearing')} FROM v_near", ("v_near",))
def nearest_line(spark, sf):
    return _near(spark, sf).withColumn("bearing", F.col("line_bearing")).select("i", "line_id", *r9("true_offset", "bearing"))


add_view(
    "v_truth",
    ("v_near", "v_fit"),
    f"""SELECT *, "offset" - true_offset AS error, heading - ({FOLD}) AS heading_error FROM (SELECT s.*, n.line_id, n.true_offset,
          (((bearing - (degrees(atan2(hx, hy)) + 180.0e0) + 180.0e0) % 360) + 360) % 360 - 180.0e0 AS d
        FROM v_fit s JOIN v_near n USING (i) WHERE sqrt(hx * hx + hy * hy) >= 0.15)""",
)


def _truth(spark, sf):
    return reference.with_truth(fitted(V.scores(spark, sf)), _near(spark, sf), ["i"])


RE = ("rms", "mean", "zero_ref_rms", "heading_rms", "heading_mean")


@query(
    "F17_referenced_error",
    f"""SELECT arm, n, {d6(*RE)} FROM (SELECT arm, count(*) AS n, sqrt(avg(error * error)) AS rms, avg(error) AS mean,
          sqrt(avg("offset" * "offset")) AS zero_ref_rms, sqrt(avg(heading_error * heading_error)) AS heading_rms, avg(heading_error) AS heading_mean
        FROM v_truth GROUP BY arm)""",
    ("v_truth",),
)
def referenced_error(spark, sf):
    return reference.referenced_error(_truth(spark, sf), ["arm"]).select("arm", "n", *r6(*RE))


LINE_SQL = """SELECT line_id, count(*) AS n, avg(error) AS mean, stddev_pop(error) AS std FROM v_truth WHERE arm = 'A' GROUP BY line_id HAVING count(*) >= 40"""


@query("F18_line_residuals", f"SELECT line_id, n, {d6('mean', 'std')} FROM ({LINE_SQL})", ("v_truth",))
def line_residuals(spark, sf):
    return reference.line_residuals(_truth(spark, sf).where("arm = 'A'")).select("line_id", "n", *r6("mean", "std"))


RQ = ("lowest", "highest", "between", "within")


@query(
    "F18_reference_quality",
    f"""SELECT lines, {d6(*RQ)} FROM (SELECT count(*) AS lines, min(mean) AS lowest, max(mean) AS highest, stddev_pop(mean) AS "between",
          avg(std) AS "within" FROM ({LINE_SQL}))""",
    ("v_truth",),
)
def reference_quality(spark, sf):
    got = reference.reference_quality(reference.line_residuals(_truth(spark, sf).where("arm = 'A'")))
    return got.select("lines", *r6(*RQ))


@query(
    "F19_paired_referenced",
    """SELECT pair, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS mean_diff, string_agg(sign, ' ' ORDER BY seed) AS signs,
         CAST(count(DISTINCT sign) = 1 AS INT) AS consistent FROM (SELECT *, CASE WHEN round(s / n, 12) > 0 THEN '+' WHEN round(s / n, 12) < 0 THEN '-' ELSE '0' END AS sign
         FROM (SELECT xa || '-' || xb AS pair, a.seed, count(*) AS n, sum(a."offset" - b."offset") AS s
           FROM (VALUES ('A', 'B'), ('A', 'C'), ('B', 'C')) p(xa, xb) JOIN v_truth a ON a.arm = xa JOIN v_truth b ON b.arm = xb AND a.i = b.i AND a.seed = b.seed
           GROUP BY 1, 2)) GROUP BY pair""",
    ("v_truth",),
)
def paired_referenced(spark, sf):
    got = reference.paired_referenced(_truth(spark, sf))
    return got.withColumns({"mean_diff": F.round("mean_diff", 6), "consistent": F.col("consistent").cast("int")})


@query(
    "F20_within_budget",
    """SELECT arm, count(*) AS n, round(100.0e0 * avg(CAST(abs(error) <= 0.182 AS INT)), 6) AS inner_pct,
         round(100.0e0 * avg(CAST(abs(error) <= 0.312 AS INT)), 6) AS summed_pct FROM v_truth GROUP BY arm""",
    ("v_truth",),
)
def within_budget(spark, sf):
    return reference.within_budget(_truth(spark, sf), ["arm"]).select("arm", "n", *r6("inner_pct", "summed_pct"))


def view_sql(n: int, first: float, step: str) -> str:
    t = f"({first}e0 + k * ({step}))"
    xy = VIEWXY.format(x=f"ax + {t} * (bx - ax)", y=f"ay + {t} * (yb - ay)", a="X", b="Y")
    return f"""SELECT i, count(*) FILTER (X >= 1.0 AND X <= 8.0 AND abs(Y) < 4.0) AS n FROM (SELECT i, {xy} FROM
      (SELECT *, radians(degrees(atan2(hx, hy))) AS h FROM v_near), (SELECT unnest(range({n})) AS k)) GROUP BY i"""


@query(
    "D10_line_in_view",
    f"""SELECT i, a.n AS n_segment, b.n AS n_extended FROM ({view_sql(200, 0.0, '1.0e0 / 199')}) a
        JOIN ({view_sql(400, -1.5, '4.0e0 / 399')}) b USING (i)""",
    ("v_near",),
)
def line_in_view(spark, sf):
    return reference.line_in_view(_near(spark, sf), 1.0, 8.0).select("i", "n_segment", "n_extended")


@query(
    "D10_view_shares",
    f"""SELECT count(*) AS n, count(*) FILTER (a.n > 3) AS segment, count(*) FILTER (b.n > 3) AS extended
        FROM ({view_sql(200, 0.0, '1.0e0 / 199')}) a JOIN ({view_sql(400, -1.5, '4.0e0 / 399')}) b USING (i)""",
    ("v_near",),
)
def view_shares(spark, sf):
    return reference.view_shares(reference.line_in_view(_near(spark, sf), 1.0, 8.0))


LATERAL = [round(-0.20 + 0.01 * k, 2) for k in range(41)]


@query(
    "H10_assumption_sweep",
    f"""SELECT arm, shift, round(sqrt(avg(power("offset" + shift, 2))), 6) AS rms FROM v_fit,
          (SELECT unnest([{', '.join(lit(x) for x in LATERAL)}]) AS shift) GROUP BY arm, shift""",
    ("v_fit",),
)
def assumption_sweep(spark, sf):
    rows = fitted(V.scores(spark, sf)).withColumn("e", F.col("offset"))
    return sweeps.assumption_sweep(rows, ["arm"], LATERAL).withColumn("rms", F.round("rms", 6))
