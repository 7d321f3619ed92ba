"""Model metrics, paired comparison, gating statistics and bootstrap queries."""

from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.catalog.draws import block_ci_sql, interval_sql, replicates_sql
from tracklab.operators import kinematics, metrics, paired, resampling, runs, subsample
from tracklab.plans import views as V
from tracklab.plans.registry import d6, r6, query
from tracklab.plans.segments import SEGMENT_ROWS
from tracklab.plans.views import add_view
from tracklab.session import stored

MODEL = ["rec", "arm", "seed"]


FIT = "cls = 'two_row' AND \"offset\" IS NOT NULL AND heading IS NOT NULL"
MIX = ", ".join(
    f"100.0e0 * avg(CASE WHEN cls = '{c}' THEN 1.0e0 ELSE 0.0e0 END) AS {c}_pct" for c in metrics.CLASSES
)
MIX_COLS = [f"{c}_pct" for c in metrics.CLASSES]

add_view("v_fit", ("v_scores",), f"SELECT * FROM v_scores WHERE {FIT}")
add_view(
    "v_across",
    ("v_fit",),
    """SELECT rec, arm, i, avg("offset") AS o, avg(heading) AS h FROM v_fit GROUP BY rec, arm, i HAVING count(DISTINCT seed) = 3""",
)
PAIR_CASES = "(VALUES ('A', 'B', 0), ('A', 'C', 1), ('B', 'C', 2)) p(xa, xb, pair_no)"
add_view(
    "v_pairs",
    ("v_across",),
    f"""SELECT a.rec, a.i, xa || '-' || xb AS pair, pair_no, a.o - b.o AS d_offset, a.h - b.h AS d_heading
        FROM {PAIR_CASES} JOIN v_across a ON a.arm = xa JOIN v_across b ON b.arm = xb AND a.rec = b.rec AND a.i = b.i""",
)
add_view(
    "v_pairs_seed",
    ("v_fit",),
    f"""SELECT a.rec, a.seed, a.i, xa || '-' || xb AS pair, pair_no, a."offset" - b."offset" AS d_offset,
          a.heading - b.heading AS d_heading
        FROM {PAIR_CASES} JOIN v_fit a ON a.arm = xa JOIN v_fit b ON b.arm = xb AND a.rec = b.rec AND a.i = b.i
          AND a.seed = b.seed""",
)
add_view(
    "v_pos",
    ("v_frames",),
    """SELECT rec, i, pass_id AS run, sum(d) OVER (PARTITION BY rec, pass_id ORDER BY i) AS pos FROM (
         SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0e0) AS d
         FROM v_frames WHERE eligible WINDOW w AS (PARTITION BY rec, pass_id ORDER BY i))""",
)
LONG = """SELECT {k}, pair, pair_no, i, unnest(['offset', 'heading']) AS metric, unnest([d_offset, d_heading]) AS v FROM {t}"""
add_view("v_long", ("v_pairs", "v_pos"), f"SELECT l.*, run, pos FROM ({LONG.format(k='rec', t='v_pairs')}) l JOIN v_pos USING (rec, i)")
add_view(
    "v_long_seed",
    ("v_pairs_seed", "v_pos"),
    f"SELECT l.*, run, pos FROM ({LONG.format(k='rec, seed', t='v_pairs_seed')}) l JOIN v_pos USING (rec, i)",
)
FLOOR = "CASE WHEN metric = 'offset' THEN 0.038e0 " + " ".join(
    f"WHEN pair = '{a}-{b}' THEN ({P.HEADING_FLOOR_DEG[a]}e0 + {P.HEADING_FLOOR_DEG[b]}e0) / 2" for a, b in P.PAIRS
) + " END"
SIGN = "CASE WHEN round(avg(v), 12) > 0 THEN '+' WHEN round(avg(v), 12) < 0 THEN '-' ELSE '0' END"


def positions(spark, sf):
    f = V.frames(spark, sf).where("eligible").select("rec", "pass_id", "i", "x", "y")
    size = SEGMENT_ROWS
    got = kinematics.arc_length(f, ["rec", "pass_id"], size)
    return got.select("rec", "i", F.col("pass_id").alias("run"), "pos"), size


def paired_series(spark, sf):
    """Paired seed-mean differences with their place along the run."""
    pos, size = positions(spark, sf)
    long = paired.long_metrics(paired.paired_frames(V.scores(spark, sf), ["rec"]), ["rec"])
    return long.join(pos, ["rec", "i"]), size


@query(
    "F1_class_mix",
    f"SELECT rec, arm, seed, n, {d6(*MIX_COLS)} FROM (SELECT rec, arm, seed, count(*) AS n, {MIX} FROM v_scores GROUP BY ALL)",
    ("v_scores",),
)
def class_mix(spark, sf):
    return metrics.class_mix(V.scores(spark, sf), MODEL).select(*MODEL, "n", *r6(*MIX_COLS))


@query(
    "F1_class_mix_across_seeds",
    "SELECT rec, arm, "
    + ", ".join(f"round(avg({c}_pct), 6) AS {c}_mean, round(stddev_pop({c}_pct), 6) AS {c}_sd" for c in metrics.CLASSES)
    + f" FROM (SELECT rec, arm, seed, {MIX} FROM v_scores GROUP BY ALL) GROUP BY rec, arm",
    ("v_scores",),
)
def class_mix_across(spark, sf):
    got = metrics.class_mix_across_seeds(V.scores(spark, sf), ["rec", "arm"])
    return got.select("rec", "arm", *r6(*[f"{c}_{k}" for c in metrics.CLASSES for k in ("mean", "sd")]))


MM = ("offset_rms", "offset_mean", "heading_rms", "heading_mean", "mc_mean", "tilt_deg", "mean_base")


@query(
    "F2_model_metrics",
    f"""SELECT rec, arm, seed, frames, n_fit, {d6(*MM)} FROM (
          SELECT rec, arm, seed, count(*) AS frames, count(*) FILTER (f) AS n_fit,
            sqrt(avg("offset" * "offset") FILTER (f)) AS offset_rms, avg("offset") FILTER (f) AS offset_mean,
            sqrt(avg(heading * heading) FILTER (f)) AS heading_rms, avg(heading) FILTER (f) AS heading_mean,
            avg(mc) FILTER (f) AS mc_mean, degrees(atan(avg(mc) FILTER (f))) AS tilt_deg, avg(n_base) AS mean_base
          FROM (SELECT *, ({FIT}) AS f FROM v_scores) GROUP BY rec, arm, seed)""",
    ("v_scores",),
)
def model_metrics(spark, sf):
    return metrics.model_metrics(V.scores(spark, sf), MODEL).select(*MODEL, "frames", "n_fit", *r6(*MM))


@query(
    "F3_across_seed",
    """SELECT rec, arm, count(*) AS n, round(sqrt(avg(o * o)), 6) AS offset_rms, round(sqrt(avg(h * h)), 6) AS heading_rms
       FROM v_across GROUP BY rec, arm""",
    ("v_across",),
)
def across_seed(spark, sf):
    got = paired.across_seed(V.scores(spark, sf), ["rec"]).groupBy("rec", "arm")
    return got.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(metrics.rms("offset"), 6).alias("offset_rms"),
        F.round(metrics.rms("heading"), 6).alias("heading_rms"),
    )


@query(
    "F4_paired_diff",
    f"""SELECT rec, pair, metric, count(*) AS n, round(avg(v), 6) AS mean_diff, {SIGN} AS sign,
          round(100.0e0 * avg(v) / ({FLOOR}), 6) AS pct_floor FROM v_long GROUP BY rec, pair, metric""",
    ("v_long",),
)
def paired_diff(spark, sf):
    s, _ = paired_series(spark, sf)
    return paired.paired_diff(s, ["rec"]).select("rec", "pair", "metric", "n", "sign", *r6("mean_diff", "pct_floor"))


def _per_seed(spark, sf):
    pos, _ = positions(spark, sf)
    frames = paired.paired_frames_per_seed(V.scores(spark, sf), ["rec"])
    long = paired.long_metrics(frames, ["rec", "seed"]).join(pos, ["rec", "i"])
    return paired.paired_diff(long, ["rec", "seed"])


@query(
    "F4_paired_diff_per_seed",
    f"""SELECT rec, seed, pair, metric, count(*) AS n, round(avg(v), 6) AS mean_diff, {SIGN} AS sign
        FROM v_long_seed GROUP BY rec, seed, pair, metric""",
    ("v_long_seed",),
)
def paired_per_seed(spark, sf):
    return _per_seed(spark, sf).select("rec", "seed", "pair", "metric", "n", "sign", *r6("mean_diff"))


@query(
    "F5_sign_consistency",
    f"""SELECT rec, pair, metric, string_agg(sign, ' ' ORDER BY seed) AS signs, CAST(count(DISTINCT sign) = 1 AS INT) AS consistent
        FROM (SELECT rec, seed, pair, metric, {SIGN} AS sign FROM v_long_seed GROUP BY rec, seed, pair, metric)
        GROUP BY rec, pair, metric""",
    ("v_long_seed",),
)
def sign_consistency(spark, sf):
    got = paired.sign_consistency(_per_seed(spark, sf), ["rec"])
    return got.withColumn("consistent", F.col("consistent").cast("int"))


# --- out-of-row behaviour ---------------------------------------------------------------------
add_view(
    "v_fcat",
    ("v_frames",),
    """SELECT rec, i, CASE WHEN stationary THEN 'stationary' WHEN cb = ca THEN 'turn' ELSE 'transition' END AS category
       FROM (SELECT *,
         last_value(CASE WHEN eligible THEN corridor END IGNORE NULLS) OVER
           (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cb,
         first_value(CASE WHEN eligible THEN corridor END IGNORE NULLS) OVER
           (PARTITION BY rec ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ca FROM v_frames)
       WHERE headland AND NOT contaminated""",
)
add_view(
    "v_phase",
    ("v_fcat",),
    """SELECT rec, i, CASE WHEN cen < 0.34 THEN 'edge' WHEN cen > 0.66 THEN 'deep' ELSE 'mid' END AS phase
       FROM (SELECT rec, i, 1.0e0 - 2.0e0 * abs(CASE WHEN hi = lo THEN 0.5e0 ELSE (i - lo) / (hi - lo) END - 0.5e0) AS cen
         FROM (SELECT rec, i, min(i) OVER (PARTITION BY rec, g) AS lo, max(i) OVER (PARTITION BY rec, g) AS hi
           FROM (SELECT rec, i, i // 3 - row_number() OVER (PARTITION BY rec ORDER BY i) AS g FROM v_fcat
             WHERE category = 'turn')))""",
)
add_view(
    "v_floor",
    ("v_frames",),
    """SELECT rec, quantile_cont(vx, 0.01) AS v_min, quantile_cont(abs(yaw_odom), 0.99) AS lim_odom,
         quantile_cont(abs(yaw_imu), 0.99) AS lim_imu FROM v_frames WHERE eligible GROUP BY rec""",
)
RULE_SQL = """abs("offset") > 0.71 AS r_offset, abs(heading) > 6.7 AS r_heading, abs(mL - mR) > 0.22 AS r_parallel,
  n_base < 12 AS r_points"""
add_view(
    "v_judged",
    ("v_fit", "v_frames", "v_fcat", "v_floor"),
    f"""SELECT *, r_offset OR r_heading OR r_parallel OR r_points AS filter_reject FROM (
          SELECT s.*, f.eligible, f.headland AND NOT f.contaminated AS outside, c.category, NOT (f.vx > l.v_min) AS gate_reject,
            {RULE_SQL}
          FROM v_fit s JOIN v_frames f USING (rec, i) JOIN v_floor l USING (rec) LEFT JOIN v_fcat c USING (rec, i))""",
)


def frame_categories(spark, sf):
    f = V.frames(spark, sf)
    size = SEGMENT_ROWS
    return runs.flank_category(f, ["rec"], size).select("rec", "i", "category"), f, size


def judged(spark, sf):
    cats, f, size = frame_categories(spark, sf)
    floor = runs.fit_threshold(f, ["rec"], "vx", 0.01, "v_min")
    flags = f.join(floor, ["rec"]).select(
        "rec",
        "i",
        "eligible",
        (F.col("headland") & ~F.col("contaminated")).alias("outside"),
        (~(F.col("vx") > F.col("v_min"))).alias("gate_reject"),
    )
    rows = metrics.fitted(V.scores(spark, sf)).join(flags, ["rec", "i"]).join(cats, ["rec", "i"], "left")
    return metrics.geometry_rules(rows)


GD = (*MIX_COLS, "offset_rms", "heading_rms")


@query(
    "F6_gap_distribution",
    f"""SELECT rec, arm, category, n, two_row_n, {d6(*GD)} FROM (
          SELECT s.rec, arm, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n, {MIX},
            count(*) FILTER ({FIT}) AS two_row_n, sqrt(avg("offset" * "offset") FILTER ({FIT})) AS offset_rms,
            sqrt(avg(heading * heading) FILTER ({FIT})) AS heading_rms
          FROM v_scores s JOIN v_fcat c USING (rec, i)
          GROUP BY GROUPING SETS ((s.rec, arm, category), (s.rec, arm)))""",
    ("v_scores", "v_fcat"),
)
def gap_distribution(spark, sf):
    cats, _, _ = frame_categories(spark, sf)
    got = metrics.gap_distribution(V.scores(spark, sf).join(cats, ["rec", "i"]), ["rec", "arm"])
    return got.select("rec", "arm", "category", "n", "two_row_n", *r6(*GD))


RR = ("gate_pct", "filter_pct", "either_pct")
RR_SQL = """count(*) AS n, 100.0e0 * avg(CAST(gate_reject AS INT)) AS gate_pct, 100.0e0 * avg(CAST(filter_reject AS INT)) AS filter_pct,
  100.0e0 * avg(CAST(gate_reject OR filter_reject AS INT)) AS either_pct"""


@query(
    "F7_rejection_rates",
    f"""SELECT rec, arm, category, n, {d6(*RR)} FROM (
          SELECT rec, arm, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, {RR_SQL}
          FROM v_judged WHERE outside GROUP BY GROUPING SETS ((rec, arm, category), (rec, arm)))""",
    ("v_judged",),
)
def rejection_rates(spark, sf):
    got = metrics.rejection_rates(judged(spark, sf).where("outside"), ["rec", "arm"])
    return got.select("rec", "arm", "category", "n", *r6(*RR))


@query(
    "F7_false_positives",
    f"SELECT rec, arm, n, {d6(*RR)} FROM (SELECT rec, arm, {RR_SQL} FROM v_judged WHERE eligible GROUP BY rec, arm)",
    ("v_judged",),
)
def false_positives(spark, sf):
    got = metrics.rejection_rates(judged(spark, sf).where("eligible"), ["rec", "arm"])
    return got.where("category = 'ALL'").select("rec", "arm", "n", *r6(*RR))


PHASES = [f"{p}_pct" for p in ("edge", "mid", "deep")]
FIRES = [f"{r}_fire_pct" for r in metrics.RULES]


@query(
    "F8_rejection_mechanism",
    f"""SELECT rec, arm, n, edge_n, mid_n, deep_n, {d6('rejection_pct', *PHASES, *FIRES)} FROM (
          SELECT j.rec, arm, count(*) AS n, 100.0e0 * avg(CAST(filter_reject AS INT)) AS rejection_pct, """
    + ", ".join(
        f"""count(*) FILTER (phase = '{p}') AS {p}_n,
            100.0e0 * count(*) FILTER (phase = '{p}' AND filter_reject) / greatest(count(*) FILTER (phase = '{p}'), 1) AS {p}_pct"""
        for p in ("edge", "mid", "deep")
    )
    + ", "
    + ", ".join(
        f"100.0e0 * count(*) FILTER (filter_reject AND r_{r}) / greatest(count(*) FILTER (filter_reject), 1) AS {r}_fire_pct"
        for r in metrics.RULES
    )
    + " FROM v_judged j JOIN v_phase p USING (rec, i) WHERE outside AND category = 'turn' GROUP BY j.rec, arm)",
    ("v_judged", "v_phase"),
)
def rejection_mechanism(spark, sf):
    cats, f, size = frame_categories(spark, sf)
    place = f.select("rec", F.col("i").alias("frame"), F.expr("i div 3").alias("i"))
    marks = cats.select("rec", F.col("i").alias("frame"), "category")
    full = place.join(marks, ["rec", "frame"], "left")
    phase = runs.run_phase(full, ["rec"], F.col("category") == "turn", size)
    phase = phase.select("rec", F.col("frame").alias("i"), "phase")
    rows = judged(spark, sf).where("outside and category = 'turn'").join(phase, ["rec", "i"])
    got = metrics.rejection_mechanism(rows, ["rec", "arm"])
    return got.select("rec", "arm", "n", "edge_n", "mid_n", "deep_n", *r6("rejection_pct", *PHASES, *FIRES))


OV = [f"{r}_pct" for r in metrics.RULES] + ["union_pct", "sum_pct", "saved_pp"]


@query(
    "F9_rule_overlap",
    f"""SELECT rec, arm, n, {d6(*OV)} FROM (SELECT *, sum_pct - union_pct AS saved_pp FROM (
          SELECT *, offset_pct + heading_pct + parallel_pct + points_pct AS sum_pct FROM (SELECT rec, arm, count(*) AS n, """
    + ", ".join(f"100.0e0 * avg(CAST(r_{r} AS INT)) AS {r}_pct" for r in metrics.RULES)
    + """, 100.0e0 * avg(CAST(filter_reject AS INT)) AS union_pct FROM v_judged WHERE eligible GROUP BY rec, arm)))""",
    ("v_judged",),
)
def rule_overlap(spark, sf):
    got = metrics.rule_overlap(judged(spark, sf).where("eligible"), ["rec", "arm"])
    return got.select("rec", "arm", "n", *r6(*OV))


@query(
    "H8_predicate_addendum",
    """SELECT f.rec, source, round(max(CASE source WHEN 'odom' THEN lim_odom ELSE lim_imu END), 6) AS turn_limit,
         count(*) FILTER (hit AND headland AND NOT contaminated) AS added_rejections,
         count(*) FILTER (hit AND eligible) AS added_false_positives
       FROM (SELECT f.*, source, lim_odom, lim_imu, vx > v_min AND CASE source WHEN 'odom' THEN abs(yaw_odom) >= lim_odom
           ELSE abs(yaw_imu) >= lim_imu END AS hit
         FROM v_frames f JOIN v_floor USING (rec), (SELECT unnest(['odom', 'imu']) AS source)) f
       GROUP BY f.rec, source""",
    ("v_frames", "v_floor"),
)
def predicate_addendum(spark, sf):
    f = V.frames(spark, sf)
    size = SEGMENT_ROWS
    lim = runs.fit_threshold(f, ["rec"], "vx", 0.01, "v_min")
    parts = []
    for src in ("odom", "imu"):
        a = f.withColumn("_a", F.abs(f"yaw_{src}"))
        t = a.join(lim, "rec").join(runs.fit_threshold(a, ["rec"], "_a", 0.99, "limit"), "rec")
        got = metrics.predicate_addendum(t, f"yaw_{src}", "v_min", "limit")
        parts.append(got.withColumn("source", F.lit(src)))
    return parts[0].unionByName(parts[1]).withColumn("turn_limit", F.round("turn_limit", 6))


# --- autocorrelation and block lengths --------------------------------------------------------
KEY = ["rec", "pair", "metric"]
CENTRES = ", ".join(f"{c}e0" for c in resampling.bin_centres())
add_view(
    "v_ac",
    ("v_long",),
    """SELECT rec, pair, metric, CAST(floor((pb - pa) / 0.15e0) AS BIGINT) AS bin, count(*) AS pairs, sum(va * vb) / count(*) / any_value(var) AS ac
       FROM (SELECT a.rec, a.pair, a.metric, a.pos AS pa, b.pos AS pb, a.v - mu AS va, b.v - mu AS vb, var
         FROM v_long a JOIN v_long b ON a.rec = b.rec AND a.pair = b.pair AND a.metric = b.metric AND a.run = b.run
           AND (b.pos, b.i) > (a.pos, a.i) AND b.pos - a.pos < 3.0
         JOIN (SELECT rec, pair, metric, avg(v) AS mu, var_pop(v) AS var FROM v_long GROUP BY ALL) m
           ON m.rec = a.rec AND m.pair = a.pair AND m.metric = a.metric)
       WHERE floor((pb - pa) / 0.15e0) < 20 GROUP BY ALL""",
)
@query(
    "G5_lag_autocorr",
    "SELECT rec, pair, metric, bin, pairs, round(ac, 6) AS ac FROM v_ac",
    ("v_ac",),
)
def lag_autocorr(spark, sf):
    s, _ = paired_series(spark, sf)
    return resampling.lag_autocorr(s, KEY).select(*KEY, "bin", "pairs", *r6("ac"))


def lengths(series, threshold: float = P.DECORR_THRESHOLD):
    got = resampling.block_length(series, KEY, threshold)
    return got.withColumn("pair_no", F.when(F.col("pair") == "A-B", 0).when(F.col("pair") == "A-C", 1).otherwise(2))


def lengths_view(threshold: float) -> str:
    return f"""SELECT *, 2 * coalesce(decorr_m, 1.5e0) AS block_m, decorr_m / spacing_m AS samples_per_decorr,
          CAST(greatest(2, round_even(2 * coalesce(decorr_m, 1.5e0) / spacing_m, 0)) AS BIGINT) AS L
        FROM (SELECT rec, pair, metric, any_value(pair_no) AS pair_no, CAST(sum(c) AS BIGINT) AS n,
            coalesce(avg(CASE WHEN c > 1 THEN span / (c - 1) END), 0.05e0) AS spacing_m
          FROM (SELECT rec, pair, metric, any_value(pair_no) AS pair_no, run, count(*) AS c, max(pos) - min(pos) AS span
            FROM v_long GROUP BY rec, pair, metric, run) GROUP BY rec, pair, metric)
        LEFT JOIN (SELECT rec, pair, metric, ([{CENTRES}])[CAST(min(bin) + 1 AS INT)] AS decorr_m FROM v_ac WHERE ac < {threshold}
          GROUP BY ALL) USING (rec, pair, metric)"""


def longest_view(lengths: str) -> str:
    """The longest block over the pairs of every metric, first pair on ties."""
    return f"""SELECT rec, metric, L, CAST(samples_per_decorr IS NULL OR samples_per_decorr >= 3.0 AS INT) AS reliable FROM (SELECT *,
          row_number() OVER (PARTITION BY rec, metric ORDER BY L DESC, pair_no) AS r FROM {lengths}) WHERE r = 1"""


add_view("v_lengths", ("v_ac", "v_long"), lengths_view(P.DECORR_THRESHOLD))
add_view("v_lengths_strict", ("v_ac", "v_long"), lengths_view(P.DECORR_THRESHOLD_STRICT))
add_view("v_longest", ("v_lengths",), longest_view("v_lengths"))
add_view("v_longest_strict", ("v_lengths_strict",), longest_view("v_lengths_strict"))


BL = ("spacing_m", "decorr_m", "block_m", "samples_per_decorr")


@query(
    "G6_block_length",
    f"SELECT rec, pair, metric, n, L, {d6(*BL)} FROM v_lengths",
    ("v_lengths",),
)
def block_length(spark, sf):
    s, _ = paired_series(spark, sf)
    return lengths(s).select(*KEY, "n", "L", *r6(*BL))


@query(
    "G7_ci_reliability",
    """SELECT rec, metric, L, pair, round(spd, 6) AS samples_per_decorr, CAST(spd IS NULL OR spd >= 3.0 AS INT) AS reliable
       FROM (SELECT rec, metric, L, pair, samples_per_decorr AS spd,
         row_number() OVER (PARTITION BY rec, metric ORDER BY L DESC, pair_no) AS r FROM v_lengths) WHERE r = 1""",
    ("v_lengths",),
)
def ci_reliability(spark, sf):
    s, _ = paired_series(spark, sf)
    got = resampling.ci_reliability(lengths(s), ["rec", "metric"])
    return got.select("rec", "metric", "L", "pair", *r6("samples_per_decorr"), F.col("reliable").cast("int").alias("reliable"))


def longest(series, threshold: float = P.DECORR_THRESHOLD):
    """(rec, metric, L, reliable): the longest block over the pairs."""
    return stored(resampling.ci_reliability(lengths(series, threshold), ["rec", "metric"]).select("rec", "metric", "L", "reliable"))


def paired_block(spark, sf, threshold: float = P.DECORR_THRESHOLD):
    """Paired differences with the interval of the longest block length over the pairs."""
    s, size = paired_series(spark, sf)
    s = stored(s)
    best = longest(s, threshold)
    ci = resampling.block_ci(s.join(best.select("rec", "metric", "L"), ["rec", "metric"]), KEY, "mean", size=size)
    return resampling.ci_excludes_zero(ci).join(best.select("rec", "metric", "reliable"), ["rec", "metric"])


def paired_block_sql(longest: str) -> str:
    src = f"(SELECT l.*, b.L FROM v_long l JOIN {longest} b USING (rec, metric))"
    return f"""SELECT rec, pair, metric, n, L, round(point, 6) AS point, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
          CAST(coalesce(ci_low > 0 OR ci_high < 0, false) AS INT) AS excludes_zero, reliable
        FROM (SELECT rec, pair, metric, count(*) AS n, avg(v) AS point FROM v_long GROUP BY ALL)
        JOIN {longest} USING (rec, metric)
        LEFT JOIN ({block_ci_sql(src, 'rec, pair, metric', {'v': 'v'}, 's_v / s__l')}) USING (rec, pair, metric)"""


def _paired_block_rows(spark, sf, threshold):
    return paired_block(spark, sf, threshold).select(
        *KEY, "n", "L", *r6("point", "ci_low", "ci_high"), F.col("excludes_zero").cast("int").alias("excludes_zero"),
        F.col("reliable").cast("int").alias("reliable"),
    )


@query("G3_paired_diff_block_ci", paired_block_sql("v_longest"), ("v_long", "v_longest"))
def paired_diff_block_ci(spark, sf):
    return _paired_block_rows(spark, sf, P.DECORR_THRESHOLD)


@query("G3_paired_diff_block_ci_strict", paired_block_sql("v_longest_strict"), ("v_long", "v_longest_strict"))
def paired_diff_block_ci_strict(spark, sf):
    """The same with the stricter decorrelation threshold, which gives longer blocks."""
    return _paired_block_rows(spark, sf, P.DECORR_THRESHOLD_STRICT)


add_view(
    "v_armlong",
    ("v_across", "v_pos", "v_longest"),
    """SELECT a.*, p.run, p.pos, b.L FROM (SELECT rec, arm, i, unnest(['offset', 'heading']) AS metric, unnest([o, h]) AS v FROM v_across) a
       JOIN v_pos p USING (rec, i) JOIN v_longest b USING (rec, metric)""",
)


@query(
    "G3_arm_rms_block_ci",
    f"""SELECT rec, arm, metric, n, L, round(point, 6) AS point, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high
        FROM (SELECT rec, arm, metric, count(*) AS n, any_value(L) AS L, sqrt(avg(v * v)) AS point FROM v_armlong GROUP BY ALL)
        LEFT JOIN ({block_ci_sql('v_armlong', 'rec, arm, metric', {'v': 'v * v'}, 'sqrt(greatest(s_v, 0) / s__l)')}) USING (rec, arm, metric)""",
    ("v_armlong",),
)
def arm_rms_block_ci(spark, sf):
    s, size = paired_series(spark, sf)
    pos, _ = positions(spark, sf)
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("offset", "heading")])).alias("_m")
    long = paired.across_seed(V.scores(spark, sf), ["rec"]).select("rec", "arm", "i", stacked).select("rec", "arm", "i", "_m.*")
    long = long.join(pos, ["rec", "i"]).join(longest(stored(s)).select("rec", "metric", "L"), ["rec", "metric"])
    got = resampling.block_ci(long, ["rec", "arm", "metric"], "rms", size=size)
    return got.select("rec", "arm", "metric", "n", "L", *r6("point", "ci_low", "ci_high"))


add_view(
    "v_thin",
    ("v_frames",),
    """SELECT rec, i FROM (WITH RECURSIVE m AS (SELECT rec, i, x, y FROM v_frames WHERE eligible),
         nx AS (SELECT a.rec, a.i, min(b.i) AS j FROM m a JOIN m b ON a.rec = b.rec AND b.i > a.i
           AND sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) >= 1.5 GROUP BY a.rec, a.i),
         kept AS (SELECT rec, min(i) AS i FROM m GROUP BY rec UNION ALL SELECT k.rec, nx.j FROM kept k JOIN nx ON nx.rec = k.rec AND nx.i = k.i)
       SELECT rec, i FROM kept)""",
)
add_view("v_fitthin", ("v_fit", "v_thin"), "SELECT * FROM v_fit JOIN v_thin USING (rec, i)")


@query(
    "G1_boot_ci",
    f"""SELECT rec, arm, seed, n, round(point, 6) AS point, CASE WHEN n >= 8 THEN round(ci_low, 6) END AS ci_low, CASE WHEN n >= 8 THEN round(ci_high, 6) END AS ci_high
        FROM (SELECT rec, arm, seed, count(*) AS n, sqrt(avg("offset" * "offset")) AS point FROM v_fitthin GROUP BY ALL)
        JOIN ({interval_sql(replicates_sql('v_fitthin', 'rec, arm, seed', 'arm, seed, i', {'v': '"offset" * "offset"'}), 'rec, arm, seed', 'sqrt(s_v / w)')}) USING (rec, arm, seed)""",
    ("v_fitthin",),
)
def boot_ci(spark, sf):
    """On frames thinned to the distance at which they count as independent."""
    frames = V.frames(spark, sf).where("eligible").select("rec", "i", "x", "y")
    rows = metrics.fitted(V.scores(spark, sf)).join(subsample.greedy_subsample(frames, ["rec"]), ["rec", "i"])
    got = resampling.boot_ci(rows, MODEL, ["arm", "seed", "i"], "offset", "rms")
    return got.select(*MODEL, "n", *r6("point", "ci_low", "ci_high"))


add_view(
    "v_parts",
    ("v_fit", "v_frames"),
    """SELECT s.rec, s.arm, s.seed, s.i, s."offset", unnest(['all', CASE WHEN f.eligible THEN 'in' ELSE 'out' END]) AS part
       FROM v_fit s JOIN v_frames f USING (rec, i)""",
)
_PART_REPS = replicates_sql("v_parts", "rec, arm, part", "part, arm, seed, i", {"v": '"offset"'})
_ONE = interval_sql(_PART_REPS, "rec, arm, part", "s_v / w")
_DIFF = interval_sql(
    f"SELECT a.rec, a.arm, a.s_v / a.w - b.s_v / b.w AS d FROM ({_PART_REPS}) a JOIN ({_PART_REPS}) b ON a.rec = b.rec AND a.arm = b.arm AND a.rep = b.rep AND a.part = 'in' AND b.part = 'out'",
    "rec, arm", "d",
)


@query(
    "G2_boot_diff_ci",
    f"""SELECT rec, arm, part, n, round(point, 6) AS point, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM (
          SELECT rec, arm, part, count(*) AS n, avg("offset") AS point FROM v_parts GROUP BY ALL) JOIN ({_ONE}) USING (rec, arm, part)
        UNION ALL SELECT rec, arm, 'in-out', n, round(point, 6), round(ci_low, 6), round(ci_high, 6) FROM (
          SELECT rec, arm, count(*) FILTER (part <> 'all') AS n, avg("offset") FILTER (part = 'in') - avg("offset") FILTER (part = 'out') AS point
          FROM v_parts GROUP BY ALL) LEFT JOIN ({_DIFF}) USING (rec, arm)""",
    ("v_parts",),
)
def boot_diff_ci(spark, sf):
    """Overall, by stratum, and the difference of the strata."""
    f = V.frames(spark, sf).select("rec", "i", F.when(F.col("eligible"), "in").otherwise("out").alias("own"))
    rows = metrics.fitted(V.scores(spark, sf)).join(f, ["rec", "i"]).withColumn("part", F.explode(F.array(F.lit("all"), F.col("own"))))
    got = resampling.boot_table(stored(rows.select("rec", "arm", "seed", "i", "offset", "part")), ["rec", "arm"], ["arm", "seed", "i"], "offset", "part", ("in", "out"))
    return got.select("rec", "arm", "part", "n", *r6("point", "ci_low", "ci_high"))


add_view(
    "v_armpairs",
    ("v_across", "v_pos", "v_longest"),
    f"""SELECT a.rec, xa || '-' || xb AS pair, a.i, a.o AS a, b.o AS b, p.run, p.pos, l.L FROM {PAIR_CASES} JOIN v_across a ON a.arm = xa
        JOIN v_across b ON b.arm = xb AND a.rec = b.rec AND a.i = b.i JOIN v_pos p ON p.rec = a.rec AND p.i = a.i JOIN v_longest l ON l.rec = a.rec AND l.metric = 'offset'""",
)
DELTA = "sqrt(greatest(s_a, 0) / s__l) - sqrt(greatest(s_b, 0) / s__l)"


@query(
    "G4_paired_rms_block_ci",
    f"""SELECT rec, pair, n, L, round(delta_rms, 6) AS delta_rms, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high
        FROM (SELECT rec, pair, count(*) AS n, any_value(L) AS L, sqrt(avg(a * a)) - sqrt(avg(b * b)) AS delta_rms FROM v_armpairs GROUP BY ALL)
        LEFT JOIN ({block_ci_sql('v_armpairs', 'rec, pair', {'a': 'a * a', 'b': 'b * b'}, DELTA)}) USING (rec, pair)""",
    ("v_armpairs",),
)
def paired_rms_block_ci(spark, sf):
    s, size = paired_series(spark, sf)
    pos, _ = positions(spark, sf)
    across = paired.across_seed(V.scores(spark, sf), ["rec"]).select("rec", "i", "arm", "offset")
    sides = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in P.PAIRS])).alias("_p")
    wide = across.select("rec", "i", "arm", "offset", sides).groupBy("rec", "i", "_p.pair").agg(
        F.max(F.when(F.col("arm") == F.col("_p.x"), F.col("offset"))).alias("a"),
        F.max(F.when(F.col("arm") == F.col("_p.y"), F.col("offset"))).alias("b"),
    )
    block = longest(stored(s)).where("metric = 'offset'").select("rec", "L")
    src = wide.where("a is not null and b is not null").join(pos, ["rec", "i"]).join(block, "rec")
    got = resampling.paired_block_ci(src, ["rec", "pair"], size=size)
    return got.select("rec", "pair", "n", "L", *r6("delta_rms", "ci_low", "ci_high"))


CELL = """SELECT rec, arm, seed, avg("offset") - stddev_pop("offset") / sqrt(count(*)) AS ci_low,
  avg("offset") + stddev_pop("offset") / sqrt(count(*)) AS ci_high FROM v_fit GROUP BY rec, arm, seed"""


@query(
    "G8_ci_overlap",
    f"""WITH c AS ({CELL}) SELECT a.rec, CAST(bool_and(a.ci_low <= b.ci_high AND b.ci_low <= a.ci_high) AS INT) AS all_overlap,
          CAST(sum(CAST(a.arm = b.arm AND a.seed = b.seed AND (a.ci_low > 0 OR a.ci_high < 0) AS INT)) AS BIGINT) AS n_exclude_zero
        FROM c a JOIN c b ON a.rec = b.rec GROUP BY a.rec""".replace("WITH c AS", ", c AS", 1),
    ("v_fit",),
)
def ci_overlap(spark, sf):
    half = F.stddev_pop("offset") / F.sqrt(F.count(F.lit(1)))
    cells = metrics.fitted(V.scores(spark, sf)).groupBy(*MODEL).agg(
        (F.avg("offset") - half).alias("ci_low"), (F.avg("offset") + half).alias("ci_high")
    )
    flagged = resampling.ci_excludes_zero(cells).groupBy("rec").agg(F.count_if("excludes_zero").alias("n_exclude_zero"))
    both = resampling.all_overlap(cells, ["rec"]).join(flagged, "rec")
    return both.select("rec", F.col("all_overlap").cast("int"), "n_exclude_zero")
