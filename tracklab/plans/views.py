"""Views of the driver tables shaped like the engine's inputs.

Each view exists twice: as a DataFrame builder and as SQL text used by the query twins.  Values that
decide a branch are kept as integers (cents), so both engines take the same branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklab.plans.segments import SEGMENT_ROWS, dense_index



def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("rec"),
        "event_id",
        "event_type",
        "value",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("us"),
    )


def series(spark, sf) -> DataFrame:
    """Pose-like series per recording: dense ``i``, time, planar position, contamination mark.

    The robot goes up and down the rows in stretches of 12 frames and rests every fourth stretch.
    """
    e = dense_index(events(spark, sf), ["rec"], ["us", "event_id"])
    u = F.col("i") % 48
    climb = F.when(u < 12, u).when(u < 24, 24 - u).when(u < 36, u - 24).otherwise(12)
    level = F.when(F.expr("(i div 48) % 2") == 0, climb).otherwise(12 - climb)
    t_ns = F.col("i") * 67_700_000 + (F.col("event_id") % 5) * 1_000_000
    return e.select(
        "rec",
        "i",
        t_ns.alias("t_ns"),
        (t_ns / 1e9).alias("t"),
        (2.45 * F.expr("(i div 24) % 5") + (F.col("event_id") % 7 - 3) * 0.02).alias("x"),
        (level * 0.09 + F.least(F.col("value"), F.lit(50.0)) * 0.0005).alias("y"),
        (F.col("event_id") % 29 == 0).alias("contaminated"),
        "event_id",
        "event_type",
        "value",
    )


def frames(spark, sf) -> DataFrame:
    """Frame manifest: one row per camera frame with pose, twist and scope flags."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), "p_size", "p_brand")
    idx = F.expr("i div 21")
    pas = F.expr("(i div 3) % 7")
    p = p.select(
        (F.col("i") % 3).alias("rec"),
        "i",
        idx.alias("idx"),
        pas.alias("pass_id"),
        (pas % 5).alias("corridor"),
        (idx * 67_700_000).alias("t_ns"),
        (idx * 0.0677).alias("t"),
        (pas * 2.45 + (F.col("p_size") - 25) * 0.002).alias("x"),
        (idx * 0.09).alias("y"),
        (0.2 + F.col("p_size") / 50.0).alias("vx"),
        ((F.col("p_size") - 25) * 0.002).alias("vy"),
        ((F.col("i") * 37 % 101 - 50) * 0.001).alias("yaw_odom"),
        (-(F.col("i") * 37 % 101 - 50) * 0.001 + (F.col("p_size") - 25) * 0.0004).alias("yaw_imu"),
        (F.col("p_brand") == "Brand#7").alias("contaminated"),
        (F.col("p_size") <= 4).alias("stationary"),
        (F.col("p_size") > 40).alias("headland"),
    )
    return p.withColumn("eligible", ~(F.col("contaminated") | F.col("stationary") | F.col("headland")))


def _arm():
    return F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")


def _seed():
    return (42 + F.col("l_linenumber") % 3).cast("bigint")


def _cents(name: str):
    return F.round(F.col(name) * 100).cast("bigint")


def scores(spark, sf) -> DataFrame:
    """Per-frame model scores, unique on (rec, arm, seed, i)."""
    li = table(spark, sf, "lineitem").select(
        _arm().alias("arm"), _seed().alias("seed"), F.col("l_partkey").alias("i"), _cents("l_discount").alias("d"), _cents("l_tax").alias("x")
    )
    g = li.groupBy("arm", "seed", "i").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("d").alias("sd"),
        F.sum("x").alias("sx"),
        F.max("d").alias("hd"),
        F.min("d").alias("ld"),
    )
    cls = (
        F.when(F.col("sx") > 7 * F.col("n"), "none").when(F.col("n") == 1, "single_row").otherwise("two_row")
    )
    g = g.withColumn("cls", cls)
    fit = F.col("cls") == "two_row"
    m_l, m_r = (F.col("hd") - 5) * 0.04, (F.col("ld") - 5) * 0.04
    flags = F.array_compact(
        F.array(
            F.when((F.col("hd") >= 9) | (F.col("ld") <= 1), "steep_slope"),
            F.when(F.col("hd") - F.col("ld") >= 6, "slope_mismatch"),
        )
    )
    return g.select(
        (F.col("i") % 3).alias("rec"),
        "arm",
        "seed",
        "i",
        "cls",
        F.when(fit, (F.col("sd") / F.col("n") - 5) * 0.04).alias("offset"),
        F.when(fit, F.col("sx") / F.col("n") - 4.0).alias("heading"),
        F.when(fit, m_l).alias("mL"),
        F.when(fit, m_r).alias("mR"),
        F.when(fit, (m_l + m_r) / 2).alias("mc"),
        F.col("n").alias("n_base"),
        (F.col("sd") % 3).alias("adj"),
        F.when(fit, flags).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


def points(spark, sf) -> DataFrame:
    """Ground points of detections per (rec, arm, seed, i, side); ``ord`` is the detection ordinal."""
    li = table(spark, sf, "lineitem").select(
        _arm().alias("arm"),
        _seed().alias("seed"),
        F.expr("l_partkey div 6").alias("i"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"),
        (F.col("l_orderkey") % 2).alias("kind"),
        (F.col("l_suppkey") % 2 == 0).alias("even"),
        _cents("l_discount").alias("d"),
        _cents("l_tax").alias("x"),
        F.col("l_quantity").alias("q"),
        F.col("l_suppkey").alias("s"),
    )
    left = F.col("even") | (F.col("i") % 11 == 0)
    near = F.col("q") / 5 + (F.col("s") % 10) * 0.013
    lateral = (
        1.2 + (F.col("d") - 5) * 0.08 + F.when(F.col("x") > 7, 1.5).otherwise(0.0) + (F.col("s") % 97 - 48) * 0.00137
    )
    return li.select(
        (F.col("i") % 3).alias("rec"),
        "arm",
        "seed",
        "i",
        F.when(left, "L").otherwise("R").alias("side"),
        "kind",
        "o",
        F.when(F.col("i") % 13 == 0, 5 + near / 2).otherwise(near).alias("X"),
        (lateral * F.when(left, 1).otherwise(-1)).alias("Y"),
        (F.col("x") * 0.17).alias("Z"),
    )


def spine(spark, sf) -> DataFrame:
    """Every frame offered to every model, including frames in which nothing was detected."""
    seen = table(spark, sf, "part").select(F.expr("p_partkey div 6").alias("i")).distinct()
    blank = table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("i"))
    models = F.explode(
        F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).cast("bigint").alias("seed")) for a in "ABC" for s in (42, 43, 44)])
    )
    f = seen.unionByName(blank).select("i", models.alias("m"))
    return f.select((F.pmod(F.col("i"), F.lit(3))).alias("rec"), "m.arm", "m.seed", "i")


def boxes(spark, sf) -> DataFrame:
    """Detector boxes on the 640-pixel frame."""
    li = table(spark, sf, "lineitem")
    x1 = F.col("l_extendedprice") % 400
    return li.select(
        (F.col("l_partkey") % 3).alias("rec"),
        _seed().alias("seed"),
        F.col("l_partkey").alias("i"),
        (F.col("l_suppkey") % 2).alias("cls"),
        (_cents("l_discount") / 10.0).alias("conf"),
        x1.alias("x1"),
        F.lit(100.0).alias("y1"),
        (x1 + 5 * F.col("l_quantity")).alias("x2"),
        (100.0 + 40.0 * _cents("l_tax")).alias("y2"),
        "l_orderkey",
        "l_linenumber",
    )


def lines(spark, sf) -> DataFrame:
    """Surveyed straight lines."""
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        n.cast("bigint").alias("line_id"),
        (2.45 * n).alias("ax"),
        F.lit(0.0).alias("ay"),
        (2.45 * n + (n % 3 - 1) / 2.0).alias("bx"),
        F.lit(50.0).alias("by"),
    )


def track(spark, sf) -> DataFrame:
    """Robot track points with their travel vector."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("i"),
        (F.col("c_acctbal") / 160).alias("px"),
        ((k % 55) * 1.0).alias("py"),
        ((k % 5 - 2) * 0.1).alias("hx"),
        ((k % 7 - 3) * 0.2).alias("hy"),
    )


def groups(spark, sf) -> DataFrame:
    """Documents with a content id shared by copies, used as samples with a stratum."""
    d = table(spark, sf, "documents")
    folded = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return d.select(
        "doc_id", F.md5(folded.cast("binary")).alias("gid"), F.col("lang").alias("stratum"), "source", "n_chars"
    )


VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "v_events": (
        (),
        """SELECT user_id AS rec, event_id, event_type, value, epoch_us(ts) AS us FROM events""",
    ),
    "v_series": (
        ("v_events",),
        """SELECT rec, i, i * 67700000 + (event_id % 5) * 1000000 AS t_ns,
             (i * 67700000 + (event_id % 5) * 1000000) / 1e9 AS t,
             2.45e0 * ((i // 24) % 5) + (event_id % 7 - 3) * 0.02e0 AS x,
             (CASE WHEN (i // 48) % 2 = 0 THEN climb ELSE 12 - climb END) * 0.09e0 + least(value, 50.0e0) * 0.0005e0 AS y,
             event_id % 29 = 0 AS contaminated, event_id, event_type, value
           FROM (SELECT *, CASE WHEN i % 48 < 12 THEN i % 48 WHEN i % 48 < 24 THEN 24 - i % 48
               WHEN i % 48 < 36 THEN i % 48 - 24 ELSE 12 END AS climb
             FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY us, event_id) - 1 AS i FROM v_events))""",
    ),
    "v_frames": (
        (),
        """SELECT *, NOT (contaminated OR stationary OR headland) AS eligible FROM (
             SELECT p_partkey % 3 AS rec, p_partkey AS i, p_partkey // 21 AS idx, (p_partkey // 3) % 7 AS pass_id,
               ((p_partkey // 3) % 7) % 5 AS corridor, (p_partkey // 21) * 67700000 AS t_ns,
               (p_partkey // 21) * 0.0677e0 AS t,
               ((p_partkey // 3) % 7) * 2.45e0 + (p_size - 25) * 0.002e0 AS x, (p_partkey // 21) * 0.09e0 AS y,
               0.2e0 + p_size / 50.0e0 AS vx, (p_size - 25) * 0.002e0 AS vy,
               (p_partkey * 37 % 101 - 50) * 0.001e0 AS yaw_odom,
               -(p_partkey * 37 % 101 - 50) * 0.001e0 + (p_size - 25) * 0.0004e0 AS yaw_imu,
               p_brand = 'Brand#7' AS contaminated, p_size <= 4 AS stationary, p_size > 40 AS headland FROM part)""",
    ),
    "v_scores": (
        (),
        """SELECT i % 3 AS rec, arm, seed, i, cls,
             CASE WHEN cls = 'two_row' THEN (sd / n - 5) * 0.04e0 END AS "offset",
             CASE WHEN cls = 'two_row' THEN sx / n - 4.0e0 END AS heading,
             CASE WHEN cls = 'two_row' THEN (hd - 5) * 0.04e0 END AS mL,
             CASE WHEN cls = 'two_row' THEN (ld - 5) * 0.04e0 END AS mR,
             CASE WHEN cls = 'two_row' THEN ((hd - 5) * 0.04e0 + (ld - 5) * 0.04e0) / 2 END AS mc,
             n AS n_base, sd % 3 AS adj,
             CASE WHEN cls = 'two_row' THEN list_filter([CASE WHEN hd >= 9 OR ld <= 1 THEN 'steep_slope' END,
               CASE WHEN hd - ld >= 6 THEN 'slope_mismatch' END], lambda f: f IS NOT NULL)
               ELSE CAST([] AS VARCHAR[]) END AS flags
           FROM (SELECT *, CASE WHEN sx > 7 * n THEN 'none' WHEN n = 1 THEN 'single_row' ELSE 'two_row' END AS cls
             FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS arm,
                 CAST(42 + l_linenumber % 3 AS BIGINT) AS seed, l_partkey AS i, count(*) AS n,
                 CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS sd,
                 CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS sx,
                 max(CAST(round(l_discount * 100) AS BIGINT)) AS hd, min(CAST(round(l_discount * 100) AS BIGINT)) AS ld
               FROM lineitem GROUP BY ALL))""",
    ),
    "v_points": (
        (),
        """SELECT i % 3 AS rec, arm, seed, i, CASE WHEN lf THEN 'L' ELSE 'R' END AS side, kind, o,
             CASE WHEN i % 13 = 0 THEN 5 + nr / 2 ELSE nr END AS X, lat * (CASE WHEN lf THEN 1 ELSE -1 END) AS Y,
             tx * 0.17e0 AS Z
           FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS arm,
               CAST(42 + l_linenumber % 3 AS BIGINT) AS seed, l_partkey // 6 AS i, l_orderkey % 2 AS kind,
               row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o,
               (l_suppkey % 2 = 0 OR (l_partkey // 6) % 11 = 0) AS lf,
               l_quantity / 5 + (l_suppkey % 10) * 0.013e0 AS nr, CAST(round(l_tax * 100) AS BIGINT) AS tx,
               1.2e0 + (CAST(round(l_discount * 100) AS BIGINT) - 5) * 0.08e0
                 + (CASE WHEN CAST(round(l_tax * 100) AS BIGINT) > 7 THEN 1.5e0 ELSE 0e0 END)
                 + (l_suppkey % 97 - 48) * 0.00137e0 AS lat
             FROM lineitem)""",
    ),
    "v_spine": (
        (),
        """SELECT ((i % 3) + 3) % 3 AS rec, arm, seed, i
           FROM (SELECT DISTINCT p_partkey // 6 AS i FROM part UNION ALL SELECT -1 - s_suppkey FROM supplier) f,
             (SELECT unnest(['A', 'B', 'C']) AS arm) a, (SELECT unnest([42::BIGINT, 43, 44]) AS seed) s""",
    ),
    "v_boxes": (
        (),
        """SELECT l_partkey % 3 AS rec, CAST(42 + l_linenumber % 3 AS BIGINT) AS seed, l_partkey AS i, l_suppkey % 2 AS cls,
             CAST(round(l_discount * 100) AS BIGINT) / 10.0e0 AS conf, l_extendedprice % 400 AS x1, 100.0e0 AS y1,
             l_extendedprice % 400 + 5 * l_quantity AS x2, 100.0e0 + 40.0e0 * CAST(round(l_tax * 100) AS BIGINT) AS y2,
             l_orderkey, l_linenumber FROM lineitem""",
    ),
    "v_lines": (
        (),
        """SELECT CAST(n_nationkey AS BIGINT) AS line_id, 2.45e0 * n_nationkey AS ax, 0.0e0 AS ay,
             2.45e0 * n_nationkey + (n_nationkey % 3 - 1) / 2.0e0 AS bx, 50.0e0 AS yb FROM nation""",
    ),
    "v_track": (
        (),
        """SELECT c_custkey AS i, c_acctbal / 160 AS px, (c_custkey % 55) * 1.0e0 AS py,
             (c_custkey % 5 - 2) * 0.1e0 AS hx, (c_custkey % 7 - 3) * 0.2e0 AS hy FROM customer""",
    ),
    "v_groups": (
        (),
        r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')) AS gid, lang AS stratum, source, n_chars
           FROM documents""",
    ),
}


def add_view(name: str, deps: tuple[str, ...], sql: str) -> None:
    """Register a derived SQL view shared by several twins."""
    VIEW_SQL[name] = (deps, sql)


def with_views(names: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the CTEs it needs, dependencies first."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in VIEW_SQL[n][0]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n][1]})" for n in ordered) + "\n" + body
