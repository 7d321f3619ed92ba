"""Segmented plans must equal the plain ones, whatever the segment size."""

import numpy as np
import pytest
from conftest import close, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklab.operators import asof, commands, intervals, kinematics, runs, smoothness
from tracklab.plans import segments as S
from tracklab.plans import views as V
from tracklab.plans.quantiles import exact_quantiles, quantile_columns


@pytest.fixture(scope="module")
def series(spark, sf):
    s = V.series(spark, sf)
    return s.withColumn("rec", F.lit(1).cast("bigint")).drop("i").transform(
        lambda d: S.dense_index(d, ["rec"], ["event_id"])
    ).withColumn("t", F.col("i") * 0.0677 + (F.col("event_id") % 5) * 0.001).cache()


#: One segment holds every key of the small tables: the plain window.
WHOLE = 10**9


def test_dense_index(spark, series):
    rank = F.row_number().over(Window.partitionBy("rec").orderBy("event_id")) - 1
    want = series.drop("i").withColumn("i", rank).select("event_id", "i")
    assert rows(S.dense_index(series.drop("i"), ["rec"], ["event_id"]).select("event_id", "i")) == rows(want)
    odd = spark.createDataFrame([(None, 3), (None, 1), (2, None), (2, 5), (2, 1)], "k INT, v INT")
    assert rows(S.dense_index(odd, ["k"], ["v"]), "k", "v") == [(None, 1, 0), (None, 3, 1), (2, None, 0), (2, 1, 1), (2, 5, 2)]


def test_one_key_of_many_rows_is_cut(spark):
    """10^6 rows of one key: ranks, prefix sums and percentiles are right and no segment holds the key."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % n).alias("v"))
    cut = S.by_range(df, ["k"], ["v"])
    assert cut.groupBy(S.SEG).count().agg(F.max("count")).first()[0] < n / 2
    got = S.dense_index(df, ["k"], ["v"])
    assert got.where("i <> v").count() == 0
    total = S.fills(got, ["k"], ["i"], sums={"s": F.col("v")})
    assert total.where("s <> i * (i + 1) / 2").count() == 0
    q = exact_quantiles(df, ["k"], "v", [0.25, 0.999]).collect()
    assert {r.p: r.q for r in q} == pytest.approx({0.25: 0.25 * (n - 1), 0.999: 0.999 * (n - 1)})


def test_quantiles_with_a_far_outlier(spark):
    df = spark.range(100_001).select(F.lit(1).alias("k"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id").cast("double")).alias("v"))
    got = {r.p: r.q for r in exact_quantiles(df, ["k"], "v", [0.0, 0.5, 1.0], 200).collect()}
    assert got == {0.0: 1.0, 0.5: 50_001.0, 1.0: 1e12}


def test_halo_needs_room(spark):
    with pytest.raises(ValueError):
        S.halo(spark.range(5).withColumnRenamed("id", "i"), 3, 3, size=5)


@pytest.mark.parametrize("size", [40, 333])
def test_kinematics_and_heading_rate(series, size):
    for fn in (kinematics.kinematics, kinematics.heading_rate):
        cols = ["i", "speed", "vy"] if fn is kinematics.kinematics else ["i", "heading_rate"]
        close(rows(fn(series, ["rec"], size).select(*cols)), rows(fn(series, ["rec"], WHOLE).select(*cols)))


def test_gradient_and_smoothing_against_numpy(series):
    pdf = series.orderBy("i").toPandas()
    t, y = pdf["t"].to_numpy(), pdf["y"].to_numpy()
    want = np.convolve(np.gradient(y, t), np.ones(15) / 15, mode="same")
    got = kinematics.kinematics(series, ["rec"], 50).orderBy("i").toPandas()["vy"].to_numpy()
    assert np.abs(want - got).max() < 1e-9


@pytest.mark.parametrize("size", [60, 211])
def test_manifest(series, size):
    cols = ["i", "pass_id", "corridor", "stationary", "headland", "eligible"]
    want = runs.build_manifest(series, 0.3, WHOLE).select(*cols)
    got = runs.build_manifest(series, 0.3, size).select(*cols)
    assert rows(got) == rows(want)
    assert want.where("pass_id >= 0").count() > 0


def test_flank_phase_arc_and_paths(series):
    m = runs.build_manifest(series, 0.3, WHOLE).cache()
    for fn, cols in (
        (lambda s: runs.flank_category(m, ["rec"], s), ["i", "category"]),
        (lambda s: runs.run_phase(m, ["rec"], F.col("headland"), s), ["i", "centrality", "phase"]),
        (lambda s: kinematics.arc_length(m, ["rec"], s), ["i", "pos"]),
        (lambda s: kinematics.heading_from_track(m, ["rec"], size=s), ["i", "bearing"]),
        (lambda s: kinematics.forward_path(m.withColumn("heading", F.col("i") * 0.01), ["rec"], ahead=9, size=s).withColumn("n", F.size("path")), ["i", "n"]),
    ):
        close(rows(fn(45).select(*cols)), rows(fn(WHOLE).select(*cols)))


def test_asof_matches_brute_force(series):
    left = series.select("rec", F.col("i").alias("id"), (F.col("event_id") * 7).alias("at")).where("id % 2 = 0")
    right = series.select("rec", F.col("i").alias("rid"), (F.col("event_id") * 11).alias("at")).where("rid % 3 = 0")
    lp, rp = left.toPandas(), right.toPandas().sort_values("at")
    want = {}
    for r in lp.itertuples():
        d = (rp["at"] - r.at).abs()
        want[r.id] = int(d.min())
    got = asof.asof_nearest(left, right, ["rec"], "at", ["rid"])
    assert {r.id: r.gap for r in got.select("id", "gap").collect()} == want


def test_asof_tie_takes_earlier(spark):
    left = spark.createDataFrame([(1, 10, 0)], "rec INT, at INT, id INT")
    right = spark.createDataFrame([(1, 8, 80), (1, 12, 120)], "rec INT, at INT, v INT")
    assert asof.asof_nearest(left, right, ["rec"], "at", ["v"]).first()["v"] == 80


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(1)
    data = [(k, float(v)) for k in ("a", "b") for v in np.r_[rng.normal(size=301), np.zeros(200)]] + [("c", 5.0)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE")
    got = {(r.k, r.p): r.q for r in exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.99, 1.0], accuracy).collect()}
    for k in ("a", "b", "c"):
        vals = [v for kk, v in data if kk == k]
        for p in (0.0, 0.5, 0.99, 1.0):
            assert abs(got[(k, p)] - np.percentile(vals, 100 * p)) < 1e-12
    wide = {r.k: r.m for r in quantile_columns(df, ["k"], "v", {"m": 0.5}).collect()}
    assert abs(wide["a"] - got[("a", 0.5)]) < 1e-12


def test_slew_limit_in_segments(spark):
    rng = np.random.default_rng(3)
    data = [(1, "A", 42, p, i, i, float(i) * 0.07, float(np.clip(rng.normal(), -1, 1)), 0.9) for p in (0, 1) for i in range(400)]
    held = spark.createDataFrame(data, "rec BIGINT, arm STRING, seed BIGINT, pass_id BIGINT, i BIGINT, e BIGINT, t DOUBLE, omega_cmd DOUBLE, slew_rate DOUBLE")
    cols = ["pass_id", "i", "omega_cmd_ramp"]
    want = commands.slew_limit(held, WHOLE).select(*cols)
    close(rows(commands.slew_limit(held, 37).select(*cols)), rows(want))
    y, prev, worst = {}, 0.0, 0.0
    for r in rows(want):
        prev = 0.0 if r[1] == 0 else prev
        worst = max(worst, abs(r[2] - prev) - 0.9 * (0.07 if r[1] else 1 / 14.77))
        prev = r[2]
    assert worst < 1e-9


def test_response_map_is_exact():
    rng = np.random.default_rng(7)
    x, d = rng.normal(size=60), np.abs(rng.normal(size=60)) * 0.3
    xs, ys = commands._response(x, d)
    for y0 in np.linspace(-6, 6, 97):
        assert abs(commands._respond(y0, xs, ys) - commands._follow(y0, x, d)[-1]) < 1e-9


def test_command_stream_in_segments(spark, sf):
    f, sc = V.frames(spark, sf), V.scores(spark, sf)
    cols = ["rec", "arm", "seed", "pass_id", "i", "hold_reason", "hold_run", "last_valid_i", "omega_cmd", "omega_cmd_ramp", "saturated"]
    plain, cut = commands.command_stream(sc, f, WHOLE), commands.command_stream(sc, f, 20)
    close(rows(cut.select(*cols)), rows(plain.select(*cols)))
    a = smoothness.stream_summary(plain, WHOLE)
    b = smoothness.stream_summary(plain, 30)
    close(rows(a.select(*sorted(a.columns)), "rec", "arm", "seed"), rows(b.select(*sorted(b.columns)), "rec", "arm", "seed"))


def test_intervals(spark):
    pts = spark.createDataFrame([(1, 2), (1, 9), (1, 17), (1, 99)], "rec INT, i BIGINT")
    n = spark.createDataFrame([(1, 101)], "rec INT, n BIGINT")
    for size in (WHOLE, 10):
        got = intervals.merge_intervals(pts, n, ["rec"], 3, size)
        assert rows(got.select("a", "b")) == [(0, 12), (14, 20), (96, 100)]
        full = spark.range(101).select(F.lit(1).alias("rec"), F.col("id").alias("i"))
        flagged = intervals.flag_in_intervals(full, got, ["rec"], size=size).where("inside").count()
        assert flagged == 13 + 7 + 5
