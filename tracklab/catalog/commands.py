"""Command-stream queries."""

from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.catalog.comparison import DELTA, longest, paired_series, positions
from tracklab.catalog.draws import block_ci_sql
from tracklab.operators import commands, kinematics, resampling, smoothness, sweeps
from tracklab.plans import views as V
from tracklab.plans.registry import d6, d9, r6, r9, query
from tracklab.plans.segments import SEGMENT_ROWS, bounded
from tracklab.plans.views import add_view
from tracklab.session import stored

STREAM = commands.STREAM
MODEL = smoothness.MODEL
SK = "rec, arm, seed, pass_id"


add_view(
    "v_gains",
    ("v_frames",),
    """SELECT *, omega_n * omega_n / v_inrow AS kp, 2.0e0 * omega_n * (pi() / 180.0e0) AS kpsi, 2.5e0 * omega_n * omega_max AS slew_rate
       FROM (SELECT *, 5.8e0 * v_inrow / 20.0e0 AS omega_n FROM (SELECT rec, avg(vx) AS v_inrow, stddev_pop(yaw_imu) AS yaw_std,
         quantile_cont(abs(yaw_imu), 0.99) AS omega_max, quantile_cont(vx, 0.01) AS v_min FROM v_frames WHERE eligible GROUP BY rec))""",
)
add_view(
    "v_streams",
    ("v_scores", "v_frames"),
    """SELECT s.rec, arm, seed, i, cls, "offset", heading, NOT (cls = 'two_row' AND "offset" IS NOT NULL AND heading IS NOT NULL) AS abstained,
         pass_id, t, vx, yaw_odom, yaw_imu FROM v_scores s JOIN v_frames f USING (rec, i) WHERE f.eligible""",
)
add_view(
    "v_cmd",
    ("v_streams", "v_gains"),
    f"""SELECT *, CASE WHEN fresh THEN greatest(least(raw, omega_max), -omega_max) END AS command, abs(raw) > omega_max AS sat,
          row_number() OVER (PARTITION BY {SK} ORDER BY i) - 1 AS e
        FROM (SELECT *, CASE WHEN fresh THEN kp * "offset" + kpsi * (heading - 2.31e0) END AS raw
          FROM (SELECT s.*, kp, kpsi, omega_max, v_min, slew_rate, vx > v_min AS state_ok, NOT abstained AND vx > v_min AS fresh
            FROM v_streams s JOIN v_gains g USING (rec)))""",
)
add_view(
    "v_held",
    ("v_cmd",),
    f"""SELECT *, CASE WHEN fresh THEN '' WHEN abstained AND NOT state_ok THEN 'both' WHEN abstained THEN 'abstain' ELSE 'state_gate' END AS hold_reason,
          CASE WHEN fresh THEN 0 ELSE e - coalesce(le, -1) END AS hold_run, coalesce(lc, 0e0) AS omega_cmd, coalesce(li, -1) AS last_valid_i,
          CASE WHEN fresh THEN coalesce(sat, false) ELSE lc IS NOT NULL AND abs(lc) >= omega_max - 1e-9 END AS saturated
        FROM (SELECT *, last_value(command IGNORE NULLS) OVER w AS lc, last_value(CASE WHEN fresh THEN i END IGNORE NULLS) OVER w AS li,
            last_value(CASE WHEN fresh THEN e END IGNORE NULLS) OVER w AS le,
            CASE WHEN t - lag(t) OVER w > 0 THEN t - lag(t) OVER w ELSE 1.0e0 / 14.77e0 END AS dt
          FROM v_cmd WINDOW w AS (PARTITION BY {SK} ORDER BY e))""",
)
add_view(
    "v_ramp",
    ("v_held",),
    f"""SELECT h.*, r.y AS omega_cmd_ramp FROM v_held h JOIN (
          WITH RECURSIVE walk AS (
            SELECT {SK}, e, CASE WHEN abs(omega_cmd) <= slew_rate * dt THEN omega_cmd ELSE sign(omega_cmd) * slew_rate * dt END AS y
            FROM v_held WHERE e = 0
            UNION ALL
            SELECT h.rec, h.arm, h.seed, h.pass_id, h.e, CASE WHEN abs(h.omega_cmd - y) <= h.slew_rate * h.dt THEN h.omega_cmd
              ELSE y + sign(h.omega_cmd - y) * h.slew_rate * h.dt END
            FROM walk JOIN v_held h ON h.rec = walk.rec AND h.arm = walk.arm AND h.seed = walk.seed AND h.pass_id = walk.pass_id
              AND h.e = walk.e + 1) SELECT * FROM walk) r USING ({SK}, e)""",
)
add_view(
    "v_delta",
    ("v_ramp",),
    f"""SELECT {SK}, i, t, gap, CASE WHEN fresh AND nf THEN 'exclusive' WHEN nf THEN 'hold_exit' WHEN fresh THEN 'hold_entry' ELSE 'hold_hold' END AS view,
          unnest(['omega_cmd', 'omega_cmd_ramp']) AS "column", unnest([d1, d2]) AS dw
        FROM (SELECT *, lead(t) OVER w - t AS gap, lead(fresh) OVER w AS nf, lead(omega_cmd) OVER w - omega_cmd AS d1,
            lead(omega_cmd_ramp) OVER w - omega_cmd_ramp AS d2 FROM v_ramp WINDOW w AS (PARTITION BY {SK} ORDER BY e)) WHERE gap > 0""",
)
add_view(
    "v_spans",
    ("v_ramp",),
    """SELECT rec, arm, seed, count(*) AS length, max(hold_run) AS longest_run FROM (SELECT *, s - row_number() OVER
           (PARTITION BY rec, arm, seed ORDER BY s) AS g FROM (SELECT *, row_number() OVER (PARTITION BY rec, arm, seed ORDER BY pass_id, i) AS s
           FROM v_ramp) WHERE NOT fresh) GROUP BY rec, arm, seed, g""",
)
add_view(
    "v_smooth",
    ("v_delta", "v_ramp"),
    """SELECT *, CASE WHEN view = 'exclusive' THEN sf ELSE sa END AS saturation_pct FROM (
         SELECT rec, arm, seed, "column", view, count(*) AS n_pairs, sqrt(avg(dw * dw)) AS rms_dw, stddev_pop(dw) AS jitter_sd,
           sqrt(avg(dw / gap * (dw / gap))) AS rms_dw_s
         FROM (SELECT * REPLACE ('inclusive' AS view) FROM v_delta UNION ALL SELECT * FROM v_delta WHERE view IN ('exclusive', 'hold_exit'))
         GROUP BY ALL) JOIN (SELECT rec, arm, seed, 100.0e0 * avg(CAST(saturated AS INT)) AS sa,
           100.0e0 * avg(CAST(saturated AS INT)) FILTER (fresh) AS sf FROM v_ramp GROUP BY rec, arm, seed) USING (rec, arm, seed)""",
)


def _frames(spark, sf):
    f = V.frames(spark, sf)
    return f, SEGMENT_ROWS


def _streams(spark, sf):
    f, size = _frames(spark, sf)
    ok = f.where("eligible").select("rec", "i", "pass_id", "t", "vx", "yaw_odom", "yaw_imu")
    return commands.to_streams(V.scores(spark, sf), ok), commands.derive_gains(f, size), size


def _stream(spark, sf):
    f, size = _frames(spark, sf)
    return commands.command_stream(V.scores(spark, sf), f, size), size


def _stream_table(spark, sf):
    """The command table as a written stage, for queries that read it more than once."""
    c, size = _stream(spark, sf)
    return stored(c), size


@query("J1_to_streams", f"SELECT {SK}, i, CAST(abstained AS INT) AS abstained, round(\"offset\", 6) AS \"offset\" FROM v_streams", ("v_streams",))
def to_streams(spark, sf):
    s, _, _ = _streams(spark, sf)
    return s.select(*STREAM, "i", F.col("abstained").cast("int").alias("abstained"), *r6("offset"))


GN = ("v_inrow", "omega_max", "v_min", "omega_n", "kp", "kpsi", "slew_rate")


@query("J2_derive_gains", f"SELECT rec, {d9(*GN)} FROM v_gains", ("v_gains",))
def derive_gains(spark, sf):
    f, size = _frames(spark, sf)
    return commands.derive_gains(f, size).select("rec", *r9(*GN))


@query(
    "J3_command",
    f"SELECT {SK}, i, CAST(fresh AS INT) AS fresh, round(command, 9) AS command, CAST(coalesce(sat, false) AS INT) AS saturated FROM v_cmd",
    ("v_cmd",),
)
def command(spark, sf):
    s, g, size = _streams(spark, sf)
    got = commands.command(s, g, size=size)
    sat = F.coalesce(F.col("_sat"), F.lit(False)).cast("int").alias("saturated")
    return got.select(*STREAM, "i", F.col("fresh").cast("int").alias("fresh"), *r9("command"), sat)


@query(
    "J3_command_with_rate",
    f"""SELECT {SK}, i, round(greatest(least(raw + 0.02e0 * CASE WHEN t > lt THEN ("offset" - lo) / (t - lt) ELSE 0e0 END, omega_max), -omega_max), 9) AS command
        FROM (SELECT *, lag("offset") OVER w AS lo, lag(t) OVER w AS lt FROM v_cmd WHERE fresh WINDOW w AS (PARTITION BY {SK} ORDER BY i))""",
    ("v_cmd",),
)
def command_with_rate(spark, sf):
    s, g, size = _streams(spark, sf)
    return commands.command(s, g, kd=0.02, size=size).where("fresh").select(*STREAM, "i", *r9("command"))


@query(
    "J4_hold_last",
    f"""SELECT {SK}, i, hold_reason, hold_run, last_valid_i, round(omega_cmd, 9) AS omega_cmd, CAST(saturated AS INT) AS saturated FROM v_held""",
    ("v_held",),
)
def hold_last(spark, sf):
    s, g, size = _streams(spark, sf)
    got = commands.hold_last(commands.command(s, g, size=size), size)
    return got.select(
        *STREAM, "i", "hold_reason", "hold_run", "last_valid_i", *r9("omega_cmd"), F.col("saturated").cast("int").alias("saturated")
    )


@query("J5_slew_limit", f"SELECT {SK}, i, round(omega_cmd_ramp, 9) AS omega_cmd_ramp FROM v_ramp", ("v_ramp",))
def slew_limit(spark, sf):
    return _stream(spark, sf)[0].select(*STREAM, "i", *r9("omega_cmd_ramp"))


@query(
    "J6_stream_summary",
    """SELECT *, coalesce(a, 0) AS hold_spans, CAST(coalesce(b, 0) AS BIGINT) AS max_hold_run, round(coalesce(c, 0e0), 6) AS mean_hold_run FROM (
         SELECT rec, arm, seed, count(*) AS n, count(*) FILTER (fresh) AS fresh, count(*) FILTER (NOT fresh) AS held,
           count(*) FILTER (hold_reason IN ('abstain', 'both')) AS held_abstain, count(*) FILTER (hold_reason IN ('state_gate', 'both')) AS held_state_gate,
           count(*) FILTER (hold_reason = 'both') AS held_both, count(*) FILTER (saturated) AS saturated,
           count(*) FILTER (abs(omega_cmd - omega_cmd_ramp) > 1e-6) AS ramp_changed FROM v_ramp GROUP BY rec, arm, seed)
       LEFT JOIN (SELECT rec, arm, seed, count(*) AS a, max(longest_run) AS b, avg(longest_run) AS c FROM v_spans GROUP BY ALL) USING (rec, arm, seed)""".replace(
        "SELECT *, coalesce", "SELECT * EXCLUDE (a, b, c), coalesce", 1
    ),
    ("v_ramp", "v_spans"),
)
def stream_summary(spark, sf):
    c, size = _stream_table(spark, sf)
    return smoothness.stream_summary(c, size).withColumn("mean_hold_run", F.round("mean_hold_run", 6))


SS = ("p50", "p90", "p95", "p99", "max", "clipped_pct")


@query(
    "J7_slew_stats",
    f"""SELECT rec, n, {d6(*SS)} FROM (SELECT rec, count(*) AS n, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.9) AS p90,
          quantile_cont(s, 0.95) AS p95, quantile_cont(s, 0.99) AS p99, max(s) AS "max", 100.0e0 * avg(CAST(s > slew_rate AS INT)) AS clipped_pct
        FROM (SELECT rec, slew_rate, CASE WHEN t > lag(t) OVER w THEN abs(omega_cmd - lag(omega_cmd) OVER w) / (t - lag(t) OVER w) END AS s
          FROM v_held WINDOW w AS (PARTITION BY {SK} ORDER BY e)) WHERE s IS NOT NULL GROUP BY rec)""",
    ("v_held",),
)
def slew_stats(spark, sf):
    s, g, size = _streams(spark, sf)
    held = commands.hold_last(commands.command(s, g, size=size), size)
    scored = V.table(spark, sf, "lineitem").select((F.col("l_partkey") % 3).alias("rec"))
    return commands.slew_stats(held, size).select("rec", "n", *r6(*SS))


@query(
    "J8_delta_views",
    f'SELECT {SK}, i, view, "column", round(gap, 6) AS gap, round(dw, 9) AS dw FROM v_delta',
    ("v_delta",),
)
def delta_views(spark, sf):
    c, size = _stream(spark, sf)
    return smoothness.delta_views(c, size).select(*STREAM, "i", "view", "column", *r6("gap"), *r9("dw"))


SM = ("rms_dw", "jitter_sd", "rms_dw_s", "saturation_pct")


def _smooth(spark, sf):
    c, size = _stream_table(spark, sf)
    return smoothness.smoothness(smoothness.delta_views(c, size), c)


@query("J9_smoothness", f'SELECT rec, arm, seed, "column", view, n_pairs, {d6(*SM)} FROM v_smooth', ("v_smooth",))
def smooth(spark, sf):
    return _smooth(spark, sf).select(*MODEL, "column", "view", "n_pairs", *r6(*SM))


@query(
    "J9_pair_composition",
    """SELECT rec, arm, seed, count(*) AS n_pairs, count(*) FILTER (view = 'exclusive') AS n_exclusive,
         count(*) FILTER (view = 'hold_exit') AS n_hold_exit, count(*) FILTER (view IN ('hold_entry', 'hold_hold')) AS n_zero,
         round(100.0e0 * count(*) FILTER (view IN ('hold_entry', 'hold_hold')) / count(*), 6) AS zero_pct
       FROM v_delta WHERE "column" = 'omega_cmd' GROUP BY rec, arm, seed""",
    ("v_delta",),
)
def pair_composition(spark, sf):
    c, size = _stream(spark, sf)
    return smoothness.pair_composition(smoothness.delta_views(c, size)).withColumn("zero_pct", F.round("zero_pct", 6))


HS = ("mean_len", "max_len_s", "over_1s_pct", "over_5s_pct")


@query(
    "J10_hold_spans",
    f"""SELECT rec, arm, seed, n_spans, n_held, median_len, p95_len, max_len, {d6(*HS)} FROM (
          SELECT s.*, max_len / 14.77e0 AS max_len_s, 100.0e0 * sh / rows AS over_1s_pct, 100.0e0 * lg / rows AS over_5s_pct FROM (
            SELECT rec, arm, seed, count(*) AS n_spans, CAST(sum(length) AS BIGINT) AS n_held, avg(length) AS mean_len,
              CAST(floor(quantile_cont(length, 0.5)) AS BIGINT) AS median_len, CAST(floor(quantile_cont(length, 0.95)) AS BIGINT) AS p95_len,
              max(length) AS max_len, coalesce(sum(length) FILTER (length > 15), 0) AS sh, coalesce(sum(length) FILTER (length > 74), 0) AS lg
            FROM v_spans GROUP BY rec, arm, seed) s
          JOIN (SELECT rec, arm, seed, count(*) AS rows FROM v_ramp GROUP BY rec, arm, seed) USING (rec, arm, seed))""",
    ("v_spans", "v_ramp"),
)
def hold_spans(spark, sf):
    c, size = _stream_table(spark, sf)
    got = smoothness.hold_spans(c, size)
    return got.select(*MODEL, "n_spans", "n_held", "median_len", "p95_len", "max_len", *r6(*HS))


add_view(
    "v_dacross",
    ("v_delta",),
    """SELECT rec, arm, i, avg(dw) AS dw FROM v_delta WHERE "column" = 'omega_cmd' GROUP BY rec, arm, i HAVING count(DISTINCT seed) = 3""",
)


@query(
    "J11_smoothness_compare",
    """SELECT a.rec, xa || '-' || xb AS pair, count(*) AS n, round(sqrt(avg(a.dw * a.dw)) - sqrt(avg(b.dw * b.dw)), 9) AS delta_rms
       FROM (VALUES ('A', 'B'), ('A', 'C'), ('B', 'C')) p(xa, xb) JOIN v_dacross a ON a.arm = xa
       JOIN v_dacross b ON b.arm = xb AND a.rec = b.rec AND a.i = b.i GROUP BY a.rec, xa, xb""",
    ("v_dacross",),
)
def smoothness_compare(spark, sf):
    c, size = _stream(spark, sf)
    across = smoothness.across_seed_deltas(smoothness.delta_views(c, size), "inclusive", "omega_cmd")
    rows = smoothness.smoothness_compare(across)
    sq = lambda x: F.sqrt(F.avg(F.col(x) * F.col(x)))
    return rows.groupBy("rec", "pair").agg(F.count(F.lit(1)).alias("n"), F.round(sq("a") - sq("b"), 9).alias("delta_rms"))


add_view(
    "v_dpairs",
    ("v_dacross", "v_pos", "v_longest"),
    """SELECT a.rec, xa || '-' || xb AS pair, a.i, a.dw AS a, b.dw AS b, p.run, p.pos, l.L
       FROM (VALUES ('A', 'B'), ('A', 'C'), ('B', 'C')) q(xa, xb) JOIN v_dacross a ON a.arm = xa
       JOIN v_dacross b ON b.arm = xb AND a.rec = b.rec AND a.i = b.i JOIN v_pos p ON p.rec = a.rec AND p.i = a.i
       JOIN (SELECT rec, max(L) AS L FROM v_longest GROUP BY rec) l ON l.rec = a.rec""",
)


@query(
    "J11_smoothness_compare_ci",
    f"""SELECT rec, pair, n, L, round(delta_rms, 9) AS delta_rms, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high
        FROM (SELECT rec, pair, count(*) AS n, any_value(L) AS L, sqrt(avg(a * a)) - sqrt(avg(b * b)) AS delta_rms FROM v_dpairs GROUP BY ALL)
        LEFT JOIN ({block_ci_sql('v_dpairs', 'rec, pair', {'a': 'a * a', 'b': 'b * b'}, DELTA)}) USING (rec, pair)""",
    ("v_dpairs",),
)
def smoothness_compare_ci(spark, sf):
    """With the longer of the two metrics' block lengths."""
    c, size = _stream_table(spark, sf)
    across = smoothness.across_seed_deltas(smoothness.delta_views(c, size), "inclusive", "omega_cmd")
    pos, psize = positions(spark, sf)
    block = longest(stored(paired_series(spark, sf)[0])).groupBy("rec").agg(F.max("L").alias("L"))
    rows = smoothness.smoothness_compare(across).join(pos, ["rec", "i"]).join(block, "rec")
    got = resampling.paired_block_ci(rows, ["rec", "pair"], size=psize)
    return got.select("rec", "pair", "n", "L", *r9("delta_rms", "ci_low", "ci_high"))


@query(
    "J11_arm_smoothness",
    """SELECT rec, arm, "column", view, round(avg(rms_dw), 9) AS rms_mean, round(stddev_pop(rms_dw), 9) AS rms_sd,
         round(avg(jitter_sd), 9) AS jitter_mean, round(stddev_pop(jitter_sd), 9) AS jitter_spread FROM v_smooth GROUP BY ALL""",
    ("v_smooth",),
)
def arm_smoothness(spark, sf):
    return _smooth(spark, sf).groupBy("rec", "arm", "column", "view").agg(
        F.round(F.avg("rms_dw"), 9).alias("rms_mean"),
        F.round(F.stddev_pop("rms_dw"), 9).alias("rms_sd"),
        F.round(F.avg("jitter_sd"), 9).alias("jitter_mean"),
        F.round(F.stddev_pop("jitter_sd"), 9).alias("jitter_spread"),
    )


@query(
    "J12_seed_group_contrast",
    """SELECT rec, arm, CAST(m IS NOT NULL AND c IS NOT NULL AS INT) AS comparable, round(CASE WHEN c IS NOT NULL THEN m END, 9) AS marked,
         round(CASE WHEN m IS NOT NULL THEN c END, 9) AS clean, round(m - c, 9) AS delta FROM (
         SELECT rec, arm, avg(rms_dw) FILTER (k) AS m, avg(rms_dw) FILTER (NOT k) AS c FROM (SELECT *,
           (arm = 'B' AND seed IN (42, 43)) OR (arm = 'C' AND seed IN (43, 44)) AS k FROM v_smooth
           WHERE view = 'exclusive' AND "column" = 'omega_cmd') GROUP BY rec, arm)""",
    ("v_smooth",),
)
def seed_group_contrast(spark, sf):
    m = _smooth(spark, sf).where((F.col("view") == "exclusive") & (F.col("column") == "omega_cmd"))
    got = smoothness.seed_group_contrast(m, "rms_dw")
    return got.select("rec", "arm", F.col("comparable").cast("int"), *r9("marked", "clean", "delta"))


# --- gain search ------------------------------------------------------------------------------
GRID = ", ".join(
    f"({n}, {kp}e0, {kpsi:f}::DOUBLE, {kd}e0)" for n, (kp, kpsi, kd, ki) in enumerate(commands.gain_grid()) if ki == 0.0
)
add_view(
    "v_foldin",
    ("v_cmd",),
    f"""SELECT {SK}, "offset", heading, omega_max, -yaw_imu AS ref_imu,
          CASE WHEN t > lag(t) OVER w THEN ("offset" - lag("offset") OVER w) / (t - lag(t) OVER w) ELSE 0e0 END AS rate
        FROM v_cmd WHERE fresh WINDOW w AS (PARTITION BY {SK} ORDER BY i)""",
)
add_view(
    "v_folds",
    ("v_foldin",),
    f"""SELECT rec, pass_id, arg_min(gain, (round(train, 12), gain)) AS best_gain, arg_min(train, (round(train, 12), gain)) AS train_rms,
          arg_min(sse, (round(train, 12), gain)) AS oof_sse, any_value(train) FILTER (gain = 0) AS train_zero,
          any_value(sse) FILTER (gain = 0) AS sse_zero, any_value(n) AS n
        FROM (SELECT *, sqrt(greatest(sum(sse) OVER w - sse, 0) / (sum(n) OVER w - n)) AS train FROM (
            SELECT rec, pass_id, gain, sum(power(greatest(least(kp * "offset" + kpsi * heading + kd * rate, omega_max), -omega_max) - ref_imu, 2)) AS sse,
              count(*) AS n FROM v_foldin, (VALUES {GRID}) g(gain, kp, kpsi, kd) GROUP BY rec, pass_id, gain)
          WINDOW w AS (PARTITION BY rec, gain)) GROUP BY rec, pass_id""",
)


def _fold_inputs(spark, sf):
    s, g, size = _streams(spark, sf)
    return commands.fold_inputs(s, g, size)


@query(
    "H6_kfold_without_integral",
    f"""SELECT rec, pass_id, CAST(best_gain AS BIGINT) AS best_gain, n, {d6('train_rms', 'train_zero', 'oof_rms')} FROM
        (SELECT *, sqrt(oof_sse / n) AS oof_rms FROM v_folds)""",
    ("v_folds",),
)
def kfold_without_integral(spark, sf):
    got = commands.kfold(commands.proportional_errors(_fold_inputs(spark, sf)), "imu")
    return got.select("rec", "pass_id", "best_gain", "n", *r6("train_rms", "train_zero", "oof_rms"))


@query(
    "H6_kfold_pooled_without_integral",
    """SELECT rec, round(p, 6) AS pooled, round(z, 6) AS pooled_zero, k AS n_distinct_gains, f AS folds,
         round(100.0e0 * (z - p) / z, 6) AS improvement_pct FROM (SELECT rec, sqrt(sum(oof_sse) / sum(n)) AS p,
         sqrt(sum(sse_zero) / sum(n)) AS z, count(DISTINCT best_gain) AS k, count(*) AS f FROM v_folds GROUP BY rec)""",
    ("v_folds",),
)
def kfold_pooled(spark, sf):
    got = commands.kfold_pooled(commands.kfold(commands.proportional_errors(_fold_inputs(spark, sf)), "imu"))
    return got.withColumns({c: F.round(c, 6) for c in ("pooled", "pooled_zero", "improvement_pct")})


@query("H6_kfold_grid")
def kfold_grid(spark, sf):
    errors = commands.simulate_grid(_fold_inputs(spark, sf))
    return commands.kfold(errors, "imu").select("rec", "pass_id", "best_gain", "n", *r6("train_rms", "train_zero", "oof_rms"))


R2 = ("corr_offset", "corr_heading", "r2", "resid_rms", "reference_std")


@query(
    "H7_linear_r2",
    f"""SELECT rec, arm, n, {d6(*R2)} FROM (SELECT *, sqrt(yy) AS reference_std, top / det / yy AS r2, sqrt(greatest(yy - top / det, 0)) AS resid_rms
        FROM (SELECT *, ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa AS top, aa * bb - ab * ab AS det FROM (
          SELECT rec, arm, count(*) AS n, corr(ref_imu, "offset") AS corr_offset, corr(ref_imu, heading) AS corr_heading, var_pop("offset") AS aa,
            var_pop(heading) AS bb, covar_pop("offset", heading) AS ab, covar_pop(ref_imu, "offset") AS ya, covar_pop(ref_imu, heading) AS yb,
            var_pop(ref_imu) AS yy FROM v_foldin GROUP BY rec, arm)))""",
    ("v_foldin",),
)
def linear_r2(spark, sf):
    got = sweeps.linear_r2(_fold_inputs(spark, sf), ["rec", "arm"], "ref_imu", "offset", "heading")
    return got.select("rec", "arm", "n", *r6(*R2))


DP = ("kp", "kpsi", "saturating_offset_m", "cmd_at_rms_deg_s", "x_yaw_p99", "x_yaw_std")


@query(
    "H11_design_points",
    f"""SELECT rec, settle_m, {d6(*DP)} FROM (SELECT *, omega_max / kp AS saturating_offset_m, degrees(kp * o) AS cmd_at_rms_deg_s,
          kp * o / omega_max AS x_yaw_p99, kp * o / yaw_std AS x_yaw_std FROM (
          SELECT rec, settle_m, omega_max, yaw_std, o, power(5.8e0 * v_inrow / settle_m, 2) / v_inrow AS kp,
            2.0e0 * (5.8e0 * v_inrow / settle_m) * (pi() / 180.0e0) AS kpsi
          FROM v_gains JOIN (SELECT rec, sqrt(avg("offset" * "offset")) AS o FROM v_streams WHERE arm = 'A' AND seed = 42 GROUP BY rec) USING (rec),
            (SELECT unnest([5.0::DOUBLE, 10.0, 20.0, 30.0]) AS settle_m)))""",
    ("v_gains", "v_streams"),
)
def design_points(spark, sf):
    f, size = _frames(spark, sf)
    s, _, _ = _streams(spark, sf)
    return commands.design_points(f, s, "A", 42, size).select("rec", "settle_m", *r6(*DP))


SA = ("corr_moving", "abs_corr_moving", "mean_abs_diff", "max_abs_diff", "odom_max", "imu_max", "odom_p99", "imu_p99")


@query(
    "F21_sensor_agreement",
    f"""SELECT rec, {d6(*SA)} FROM (SELECT rec, corr(yaw_odom, yaw_imu) FILTER (moving) AS corr_moving,
          corr(abs(yaw_odom), abs(yaw_imu)) FILTER (moving) AS abs_corr_moving, avg(degrees(abs(yaw_odom - yaw_imu))) FILTER (moving) AS mean_abs_diff,
          max(degrees(abs(yaw_odom - yaw_imu))) FILTER (moving) AS max_abs_diff, degrees(max(abs(yaw_odom)) FILTER (eligible)) AS odom_max,
          degrees(max(abs(yaw_imu)) FILTER (eligible)) AS imu_max,
          quantile_cont(degrees(abs(yaw_odom)), 0.99) FILTER (eligible) AS odom_p99, quantile_cont(degrees(abs(yaw_imu)), 0.99) FILTER (eligible) AS imu_p99
        FROM (SELECT *, sqrt(power(CASE WHEN lag(t) OVER w IS NULL THEN (lead(x) OVER w - x) / (lead(t) OVER w - t)
              WHEN lead(t) OVER w IS NULL THEN (x - lag(x) OVER w) / (t - lag(t) OVER w)
              ELSE (power(t - lag(t) OVER w, 2) * lead(x) OVER w + (power(lead(t) OVER w - t, 2) - power(t - lag(t) OVER w, 2)) * x
                - power(lead(t) OVER w - t, 2) * lag(x) OVER w) / ((t - lag(t) OVER w) * (lead(t) OVER w - t) * (lead(t) OVER w - lag(t) OVER w)) END, 2)
            + power(CASE WHEN lag(t) OVER w IS NULL THEN (lead(y) OVER w - y) / (lead(t) OVER w - t)
              WHEN lead(t) OVER w IS NULL THEN (y - lag(y) OVER w) / (t - lag(t) OVER w)
              ELSE (power(t - lag(t) OVER w, 2) * lead(y) OVER w + (power(lead(t) OVER w - t, 2) - power(t - lag(t) OVER w, 2)) * y
                - power(lead(t) OVER w - t, 2) * lag(y) OVER w) / ((t - lag(t) OVER w) * (lead(t) OVER w - t) * (lead(t) OVER w - lag(t) OVER w)) END, 2)) > 0.1 AS moving
          FROM v_frames WINDOW w AS (PARTITION BY rec, pass_id ORDER BY idx)) GROUP BY rec)""",
    ("v_frames",),
)
def sensor_agreement(spark, sf):
    f, size = _frames(spark, sf)
    grad = lambda w: {"_gx": kinematics.gradient("x", "t", w), "_gy": kinematics.gradient("y", "t", w)}
    m = bounded(f, ["rec", "pass_id"], 1, [grad], idx="idx", size=size)
    m = m.withColumn("moving", F.hypot("_gx", "_gy") > P.STATIONARY_BELOW_MS)
    return smoothness.sensor_agreement(m, size).select("rec", *r6(*SA))
