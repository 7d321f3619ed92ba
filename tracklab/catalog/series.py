"""Keyed time-series queries (kinematics, runs, gating)."""

from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.operators import asof, kinematics, runs
from tracklab.plans import views as V
from tracklab.plans.registry import query
from tracklab.plans.segments import SEGMENT_ROWS
from tracklab.plans.views import add_view
from tracklab.session import stored

MIN_TRAVEL = 0.3


add_view(
    "v_step",
    ("v_series",),
    """SELECT *, ds / greatest(dt, 1e-6) AS step_speed FROM (SELECT *,
         coalesce(t - lag(t) OVER w, 1.0e0 / 14.77e0) AS dt,
         coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0e0) AS ds
       FROM v_series WINDOW w AS (PARTITION BY rec ORDER BY i))""",
)
GRAD = """CASE WHEN lag(t) OVER w IS NULL AND lead(t) OVER w IS NULL THEN 0e0
  WHEN lag(t) OVER w IS NULL THEN (lead({y}) OVER w - {y}) / (lead(t) OVER w - t)
  WHEN lead(t) OVER w IS NULL THEN ({y} - lag({y}) OVER w) / (t - lag(t) OVER w)
  ELSE (power(t - lag(t) OVER w, 2) * lead({y}) OVER w
    + (power(lead(t) OVER w - t, 2) - power(t - lag(t) OVER w, 2)) * {y}
    - power(lead(t) OVER w - t, 2) * lag({y}) OVER w)
    / ((t - lag(t) OVER w) * (lead(t) OVER w - t) * (lead(t) OVER w - lag(t) OVER w)) END"""
BOX = "sum({c}) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15.0e0"
add_view(
    "v_kin",
    ("v_step",),
    f"""SELECT *, {BOX.format(c='step_speed')} AS speed, {BOX.format(c='gy')} AS vy FROM (SELECT *,
         {GRAD.format(y='y')} AS gy FROM v_step WINDOW w AS (PARTITION BY rec ORDER BY i))""",
)
add_view(
    "v_rate",
    ("v_step",),
    f"""SELECT *, {BOX.format(c='hr')} AS heading_rate FROM (SELECT *,
          CASE WHEN sqrt(vx2 * vx2 + vy2 * vy2) < 0.05 THEN 0e0 ELSE coalesce(abs(atan2(
            lag(vx2) OVER w * vy2 - lag(vy2) OVER w * vx2, lag(vx2) OVER w * vx2 + lag(vy2) OVER w * vy2))
            / greatest(t - lag(t) OVER w, 1e-6), 0e0) END AS hr
        FROM (SELECT *, {BOX.format(c='gx')} AS vx2, {BOX.format(c='gy')} AS vy2 FROM (SELECT *,
          {GRAD.format(y='x')} AS gx, {GRAD.format(y='y')} AS gy
          FROM v_step WINDOW w AS (PARTITION BY rec ORDER BY i)))
        WINDOW w AS (PARTITION BY rec ORDER BY i))""",
)
add_view(
    "v_runs",
    ("v_kin",),
    f"""SELECT *, row_number() OVER (PARTITION BY rec ORDER BY a) - 1 AS pass_id FROM (
         SELECT rec, min(i) AS a, max(i) AS b, arg_min(y, i) AS y_first, arg_max(y, i) AS y_last,
           min(t) AS t0, max(t) AS t1, quantile_cont(x, 0.5) AS x_median
         FROM (SELECT *, sum(CASE WHEN p AND NOT coalesce(pp, false) THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY i) AS g
           FROM (SELECT *, abs(vy) > 0.3 AS p, lag(abs(vy) > 0.3) OVER (PARTITION BY rec ORDER BY i) AS pp FROM v_kin))
         WHERE p GROUP BY rec, g HAVING abs(arg_max(y, i) - arg_min(y, i)) > {MIN_TRAVEL})""",
)
add_view(
    "v_placed",
    ("v_runs",),
    """SELECT r.*, arg_min(c.corridor, (abs(r.x_median - c.centre), c.corridor)) AS corridor,
         arg_min(c.centre, (abs(r.x_median - c.centre), c.corridor)) AS centre
       FROM v_runs r JOIN (SELECT rec, cl AS corridor, avg(x_median) AS centre FROM (SELECT *,
           sum(nw) OVER (PARTITION BY rec ORDER BY x_median, pass_id) AS cl FROM (SELECT *,
             CASE WHEN x_median - lag(x_median) OVER (PARTITION BY rec ORDER BY x_median, pass_id) >= 1.2 THEN 1 ELSE 0 END AS nw
           FROM v_runs)) GROUP BY rec, cl) c USING (rec)
       GROUP BY ALL""",
)
add_view(
    "v_manifest",
    ("v_kin", "v_placed"),
    """SELECT *, NOT headland AND NOT stationary AND NOT contaminated AS eligible FROM (
         SELECT k.*, coalesce(p.pass_id, -1) AS pass_id, coalesce(p.corridor, -1) AS corridor,
           k.speed < 0.1 AS stationary, p.pass_id IS NULL AS headland
         FROM v_kin k LEFT JOIN v_placed p ON k.rec = p.rec AND k.i BETWEEN p.a AND p.b)""",
)


def _series(spark, sf):
    size = SEGMENT_ROWS
    return V.series(spark, sf), size


def manifest(spark, sf):
    s, size = _series(spark, sf)
    return runs.build_manifest(s, MIN_TRAVEL, size), size


def _kin(spark, sf):
    s, size = _series(spark, sf)
    return kinematics.kinematics(s, ["rec"], size), size


def _runs(spark, sf):
    k, size = _kin(spark, sf)
    return runs.detect_runs(k, ["rec"], F.abs("vy") > P.ALONG_ROW_ABOVE_MS, MIN_TRAVEL, size), size


@query(
    "C1_asof_nearest",
    """SELECT e.rec, e.event_id, arg_min(v.event_id, (abs(e.us - v.us), v.us)) AS near_id,
         min(abs(e.us - v.us)) AS gap_us
       FROM v_events e JOIN v_events v ON e.rec = v.rec AND v.event_type = 'view'
       WHERE e.event_type = 'click' GROUP BY e.rec, e.event_id""",
    ("v_events",),
)
def asof_nearest(spark, sf):
    e = V.events(spark, sf)
    left = e.where(F.col("event_type") == "click").select("rec", "event_id", "us")
    right = e.where(F.col("event_type") == "view").select("rec", F.col("event_id").alias("near_id"), "us")
    got = asof.asof_nearest(left, right, ["rec"], "us", ["near_id"])
    return got.where("near_id is not null").select("rec", "event_id", "near_id", F.col("gap").alias("gap_us"))


@query(
    "C1_asof_max_gap",
    """SELECT rec, max(gap) / 1000.0e0 AS max_gap_ms, count(*) AS n FROM (
         SELECT e.rec, e.event_id, min(abs(e.us - v.us)) AS gap
         FROM v_events e JOIN v_events v ON e.rec = v.rec AND v.event_type = 'view'
         WHERE e.event_type = 'click' GROUP BY e.rec, e.event_id) GROUP BY rec""",
    ("v_events",),
)
def asof_max_gap(spark, sf):
    got = asof_nearest(spark, sf)
    return got.groupBy("rec").agg((F.max("gap_us") / 1000.0).alias("max_gap_ms"), F.count(F.lit(1)).alias("n"))


@query(
    "C2_join_exact",
    """SELECT s.rec, s.arm, s.seed, s.i, f.vx, f.yaw_odom, g.yaw_imu
       FROM v_scores s JOIN v_frames f USING (rec, i) JOIN v_frames g USING (rec, i)""",
    ("v_scores", "v_frames"),
)
def join_exact(spark, sf):
    f = V.frames(spark, sf)
    sc = V.scores(spark, sf).select("rec", "arm", "seed", "i")
    return asof.join_exact(sc, [f.select("rec", "i", "vx", "yaw_odom"), f.select("rec", "i", "yaw_imu")], ["rec", "i"])


@query(
    "C3_step_speed",
    "SELECT rec, i, round(dt, 6) AS dt, round(ds, 6) AS ds, round(step_speed, 6) AS step_speed FROM v_step",
    ("v_step",),
)
def step_speed(spark, sf):
    s, size = _series(spark, sf)
    s = kinematics.step_speed(s, ["rec"], size)
    return s.select("rec", "i", F.round("dt", 6).alias("dt"), F.round("ds", 6).alias("ds"), F.round("step_speed", 6).alias("step_speed"))


@query("C4_box_smooth", "SELECT rec, i, round(speed, 6) AS speed FROM v_kin", ("v_kin",))
def box_smooth(spark, sf):
    return _kin(spark, sf)[0].select("rec", "i", F.round("speed", 6).alias("speed"))


@query("C5_gradient_smoothed", "SELECT rec, i, round(vy, 6) AS vy FROM v_kin", ("v_kin",))
def gradient(spark, sf):
    return _kin(spark, sf)[0].select("rec", "i", F.round("vy", 6).alias("vy"))


@query(
    "C6_detect_runs",
    """SELECT rec, pass_id, a, b, round(y_first, 6) AS y_first, round(y_last, 6) AS y_last,
         round(x_median, 6) AS x_median FROM v_runs""",
    ("v_runs",),
)
def detect_runs(spark, sf):
    return _runs(spark, sf)[0].select(
        "rec", "pass_id", "a", "b", *[F.round(c, 6).alias(c) for c in ("y_first", "y_last", "x_median")]
    )


@query(
    "C7_chain_cluster",
    """SELECT rec, pass_id, CAST(corridor AS BIGINT) AS corridor, round(centre, 6) AS centre FROM v_placed""",
    ("v_placed",),
)
def chain_cluster(spark, sf):
    r, size = _runs(spark, sf)
    got = runs.chain_cluster(stored(r), ["rec"], size=size)
    return got.select("rec", "pass_id", F.col("corridor").cast("bigint"), F.round("centre", 6).alias("centre"))


@query(
    "C8_expect_runs",
    """SELECT e.rec, e.expected, coalesce(n, 0) AS n_runs, CAST(coalesce(n, 0) = e.expected AS INT) AS ok
       FROM (SELECT DISTINCT rec, 2 + rec % 3 AS expected FROM v_events) e
       LEFT JOIN (SELECT rec, count(*) AS n FROM v_runs GROUP BY rec) r USING (rec)""",
    ("v_events", "v_runs"),
)
def expect_runs(spark, sf):
    known = V.events(spark, sf).select("rec", (2 + F.col("rec") % 3).alias("expected")).distinct()
    got = runs.expect_runs(_runs(spark, sf)[0], known, enforce=False)
    return got.withColumn("ok", F.col("ok").cast("int"))


@query(
    "C9_eligibility",
    """SELECT rec, i, CAST(pass_id AS BIGINT) AS pass_id, CAST(corridor AS BIGINT) AS corridor,
         CAST(stationary AS INT) AS stationary, CAST(headland AS INT) AS headland, CAST(eligible AS INT) AS eligible
       FROM v_manifest""",
    ("v_manifest",),
)
def eligibility(spark, sf):
    flags = [F.col(c).cast("int").alias(c) for c in ("stationary", "headland", "eligible")]
    return manifest(spark, sf)[0].select("rec", "i", "pass_id", "corridor", *flags)


@query(
    "C12_arc_length",
    """SELECT rec, pass_id, i, round(sum(d) OVER (PARTITION BY rec, pass_id ORDER BY i), 6) AS pos FROM (
         SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0e0) AS d
         FROM v_frames WHERE eligible WINDOW w AS (PARTITION BY rec, pass_id ORDER BY i))""",
    ("v_frames",),
)
def arc_length(spark, sf):
    f = V.frames(spark, sf).where("eligible").select("rec", "pass_id", "i", "x", "y")
    size = SEGMENT_ROWS
    return kinematics.arc_length(f, ["rec", "pass_id"], size).select("rec", "pass_id", "i", F.round("pos", 6).alias("pos"))


@query("C13_heading_rate", "SELECT rec, i, round(heading_rate, 5) AS heading_rate FROM v_rate", ("v_rate",))
def heading_rate(spark, sf):
    s, size = _series(spark, sf)
    got = kinematics.heading_rate(s, ["rec"], size)
    return got.select("rec", "i", F.round("heading_rate", 5).alias("heading_rate"))


add_view(
    "v_gate",
    ("v_manifest", "v_rate"),
    """SELECT m.*, r.heading_rate, l.turn_limit,
         coalesce(m.speed > 0.1 AND abs(m.vy) > 0.3 AND r.heading_rate < l.turn_limit, false) AS keep
       FROM v_manifest m JOIN v_rate r USING (rec, i) LEFT JOIN (
         SELECT rec, quantile_cont(r.heading_rate, 0.99) AS turn_limit
         FROM v_manifest m JOIN v_rate r USING (rec, i) WHERE m.eligible GROUP BY rec) l USING (rec)""",
)


def _rated(spark, sf):
    s, size = _series(spark, sf)
    return runs.build_manifest(kinematics.heading_rate(s, ["rec"], size), MIN_TRAVEL, size), size


@query(
    "C14_fit_threshold",
    "SELECT DISTINCT rec, round(turn_limit, 5) AS turn_limit FROM v_gate WHERE turn_limit IS NOT NULL",
    ("v_gate",),
)
def fit_threshold(spark, sf):
    m, size = _rated(spark, sf)
    got = runs.fit_threshold(m, ["rec"], "heading_rate", 0.99, "turn_limit")
    return got.select("rec", F.round("turn_limit", 5).alias("turn_limit"))


@query("C14_state_gate", "SELECT rec, i, CAST(keep AS INT) AS keep FROM v_gate", ("v_gate",))
def state_gate(spark, sf):
    m, size = _rated(spark, sf)
    return runs.state_gate(m, ["rec"], size).select("rec", "i", F.col("keep").cast("int"))


add_view(
    "v_flank",
    ("v_manifest",),
    """SELECT rec, i, CASE WHEN stationary THEN 'stationary' WHEN cb = ca THEN 'turn' ELSE 'transition' END AS category
       FROM (SELECT *,
         last_value(CASE WHEN eligible THEN corridor END IGNORE NULLS) OVER
           (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cb,
         first_value(CASE WHEN eligible THEN corridor END IGNORE NULLS) OVER
           (PARTITION BY rec ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ca FROM v_manifest)
       WHERE headland AND NOT contaminated""",
)


@query("C15_flank_category", "SELECT rec, i, category FROM v_flank", ("v_flank",))
def flank_category(spark, sf):
    m, size = manifest(spark, sf)
    return runs.flank_category(m, ["rec"], size).select("rec", "i", "category")


@query(
    "C16_run_phase",
    """SELECT rec, i, round(cen, 6) AS centrality,
         CASE WHEN cen < 0.34 THEN 'edge' WHEN cen > 0.66 THEN 'deep' ELSE 'mid' END AS phase
       FROM (SELECT rec, i, 1.0e0 - 2.0e0 * abs(CASE WHEN hi = lo THEN 0.5e0 ELSE (i - lo) / (hi - lo) END - 0.5e0) AS cen
         FROM (SELECT rec, i, min(i) OVER (PARTITION BY rec, g) AS lo, max(i) OVER (PARTITION BY rec, g) AS hi
           FROM (SELECT rec, i, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS g FROM v_flank
             WHERE category = 'turn')))""",
    ("v_flank",),
)
def run_phase(spark, sf):
    m, size = manifest(spark, sf)
    marks = runs.flank_marks(m, ["rec"], size).select("rec", "i", "category")
    got = runs.run_phase(marks, ["rec"], F.col("category") == "turn", size)
    return got.select("rec", "i", F.round("centrality", 6).alias("centrality"), "phase")


@query(
    "C17_manifest_summary",
    """SELECT rec, rows, contaminated, stationary, headland, loose, eligible, n_passes, round(path_length_m, 5) AS path_length_m,
         round(max_corridor_pct, 6) AS max_corridor_pct, CAST(n_corridors AS DOUBLE) AS n_corridors
       FROM (SELECT rec, count(*) AS rows, count(*) FILTER (contaminated) AS contaminated,
           count(*) FILTER (stationary) AS stationary, count(*) FILTER (headland) AS headland,
           count(*) FILTER ((headland OR stationary) AND NOT contaminated) AS loose,
           count(*) FILTER (eligible) AS eligible, CAST(max(pass_id) + 1 AS BIGINT) AS n_passes, sum(ds) AS path_length_m
         FROM v_manifest GROUP BY rec)
       LEFT JOIN (SELECT rec, 100.0e0 * max(n) / sum(n) AS max_corridor_pct, count(*) AS n_corridors
         FROM (SELECT rec, corridor, count(*) AS n FROM v_manifest WHERE eligible GROUP BY ALL) GROUP BY rec) USING (rec)""",
    ("v_manifest",),
)
def manifest_summary(spark, sf):
    got = runs.manifest_summary(manifest(spark, sf)[0])
    return got.withColumns(
        {
            "path_length_m": F.round("path_length_m", 5),
            "max_corridor_pct": F.round("max_corridor_pct", 6),
            "n_corridors": F.col("n_corridors").cast("double"),
        }
    )


@query(
    "C17_run_summary",
    """SELECT rec, CAST(pass_id AS BIGINT) AS pass_id, CAST(min(corridor) AS BIGINT) AS corridor, min(t) AS t0_s, max(t) AS t1_s,
         count(*) FILTER (eligible) AS eligible,
         CASE WHEN arg_max(y, i) < arg_min(y, i) THEN 'down' ELSE 'up' END AS dir
       FROM v_manifest WHERE pass_id >= 0 GROUP BY rec, pass_id""",
    ("v_manifest",),
)
def run_summary(spark, sf):
    return runs.run_summary(manifest(spark, sf)[0])


@query(
    "C18_forward_path",
    """SELECT rec, i, CASE WHEN n >= 2 THEN n END AS n_points, CASE WHEN n >= 2 THEN round(reach, 5) END AS reach FROM (
         SELECT rec, i, CAST(count(*) FILTER (NOT cut AND X > -0.5) AS DOUBLE) AS n, max(X) FILTER (NOT cut AND X > -0.5) AS reach
         FROM (SELECT *, bool_or(X > 9.0) OVER (PARTITION BY rec, i ORDER BY j) AS cut FROM (
           SELECT a.rec, a.i, b.i AS j, (b.x - a.x) * cos(a.h) + (b.y - a.y) * sin(a.h) AS X
           FROM (SELECT *, (event_id % 628) / 100.0e0 AS h FROM v_series) a
           JOIN v_series b ON a.rec = b.rec AND b.i BETWEEN a.i AND a.i + 219)) GROUP BY rec, i)""",
    ("v_series",),
)
def forward_path(spark, sf):
    s, size = _series(spark, sf)
    got = kinematics.forward_path(s.withColumn("heading", (F.col("event_id") % 628) / 100.0), ["rec"], size=size)
    reach = F.array_max(F.transform("path", lambda p: p.X))
    n = F.when(F.col("path").isNotNull(), F.size("path")).cast("double")
    return got.select("rec", "i", n.alias("n_points"), F.round(reach, 5).alias("reach"))


@query(
    "C19_heading_from_track",
    """SELECT rec, i, round(degrees(atan2(hx, hy)), 6) AS bearing FROM (SELECT rec, i,
         last_value(x) OVER f - first_value(x) OVER b AS hx, last_value(y) OVER f - first_value(y) OVER b AS hy FROM v_series
         WINDOW f AS (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING),
                b AS (PARTITION BY rec ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
       WHERE sqrt(hx * hx + hy * hy) >= 0.15""",
    ("v_series",),
)
def heading_from_track(spark, sf):
    s, size = _series(spark, sf)
    got = kinematics.heading_from_track(s, ["rec"], size=size)
    return got.select("rec", "i", F.round("bearing", 6).alias("bearing"))
