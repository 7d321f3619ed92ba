import json

import numpy as np
import pandas as pd
import pytest
from conftest import SF, close, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracklab.functions import geometry as G
from tracklab.functions import names
from tracklab.operators import (
    asof,
    commands,
    evaluation,
    integrity,
    intervals,
    lookups,
    matching,
    paired,
    reference,
    resampling,
    rowfit,
    runs,
    samples,
    sweeps,
)
from tracklab.plans import views as V
from tracklab.sources import readers, reports
from tracklab.streaming.commands import stream_commands, with_gains


def test_confusion_constants(spark):
    px = spark.createDataFrame([(1, True, True), (1, True, False), (1, False, True), (1, False, False)], "k INT, truth BOOLEAN, pred BOOLEAN")
    r = evaluation.confusion_metrics(evaluation.confusion(px, ["k"])).first()
    assert r["iou_fg"] == r["iou_bg"] == r["miou"] == pytest.approx(1 / 3)
    assert r["precision"] == r["recall"] == r["f1"] == 0.5
    empty = spark.createDataFrame([(1, False, False)], "k INT, truth BOOLEAN, pred BOOLEAN")
    e = evaluation.confusion_metrics(evaluation.confusion(empty, ["k"])).first()
    assert e["iou_fg"] is None and e["miou"] == 1.0


def test_band_edges(spark):
    df = spark.createDataFrame([(40,), (41,), (199,), (200,)], "s INT").select(G.band(F.col("s")).alias("v"))
    assert [r.v for r in df.collect()] == ["absent", "needs_review", "needs_review", "present"]


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(float(u), float(v)) for u in (120, 320, 520) for v in (400, 500, 620)], "u DOUBLE, v DOUBLE")
    for cal in G.SITES.values():
        g = df.withColumn("g", G.project_px(F.col("u"), F.col("v"), cal, 50.0)).where("g is not null")
        back = g.withColumn("b", G.project_ground(F.col("g.X"), F.col("g.Y"), cal)).select("u", "v", "b.u", "b.v")
        for r in back.collect():
            assert r[0] == pytest.approx(r[2], abs=1e-6) and r[1] == pytest.approx(r[3], abs=1e-6)
    assert df.limit(1).select(G.project_px(F.lit(320.0), F.lit(10.0), G.FIRST_SITE)).first()[0] is None


def test_failures_are_loud(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "rec INT, i INT")
    b = spark.createDataFrame([(1, 1, 5)], "rec INT, i INT, v INT")
    with pytest.raises(PySparkException):
        asof.join_exact(a, [b], ["rec", "i"]).collect()
    with pytest.raises(PySparkException):
        intervals.exclude_flagged(a, b, b.where("rec = 9"), ["rec", "i"]).collect()
    with pytest.raises(PySparkException):
        runs.expect_runs(a, spark.createDataFrame([(1, 5)], "rec INT, expected INT")).collect()
    with pytest.raises(PySparkException):
        spark.range(1).select(names.stratum(F.lit("odd_1"), (("src", "x"),))).collect()
    with pytest.raises(PySparkException):
        intervals.require_clear(spark.createDataFrame([("needs_review",)], "status STRING")).collect()
    img = spark.createDataFrame([(1, "a"), (2, "a")], "id INT, file_name STRING")
    with pytest.raises(PySparkException):
        readers.join_annotations(img, spark.createDataFrame([(1,)], "id INT"), ["id"]).collect()
    two = [spark.createDataFrame([(1, 1, d)], "rec INT, t INT, day STRING") for d in ("mon", "tue")]
    with pytest.raises(PySparkException):
        readers.merge_sources(two, ["rec"], ["t"], "day").collect()


def test_unset_run_count_passes(spark):
    a = spark.createDataFrame([(1, 1)], "rec INT, i INT")
    known = spark.createDataFrame([(1, None), (2, 0)], "rec INT, expected INT")
    assert runs.expect_runs(a, known).count() == 2


def _table(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k INT, i INT, v DOUBLE")


def test_bootstrap_properties(spark):
    c = resampling.boot_ci(_table(spark, [0.5] * 20), ["k"], ["i"], "v").first()
    assert c["point"] == c["ci_low"] == c["ci_high"] == 0.5
    some = resampling.boot_ci(_table(spark, [0.2, 0.4, None, 0.6, 0.8]), ["k"], ["i"], "v", min_n=1).first()
    assert some["n"] == 4 and some["ci_low"] <= some["point"] <= some["ci_high"]
    few = resampling.boot_ci(_table(spark, [0.1] * 7), ["k"], ["i"], "v").first()
    assert few["ci_low"] is None and few["point"] == pytest.approx(0.1)
    rng = np.random.default_rng(0)
    t = _table(spark, [float(v) for v in rng.normal(1, 1, 300)])
    one = resampling.boot_ci(t.repartition(1), ["k"], ["i"], "v").first()
    many = resampling.boot_ci(t.repartition(8), ["k"], ["i"], "v").first()
    assert one["ci_low"] == pytest.approx(many["ci_low"], abs=1e-12)
    se = 1.0 / np.sqrt(300)
    assert abs((many["ci_high"] - many["ci_low"]) / (2 * 1.96 * se) - 1) < 0.15


def test_block_ci_close_to_exact_moving_blocks(spark):
    rng = np.random.default_rng(5)
    v = np.zeros(500)
    for n in range(1, 500):
        v[n] = 0.8 * v[n - 1] + rng.normal()
    length = 12
    df = spark.createDataFrame(
        [("x", 0, i, float(i), float(v[i]), length) for i in range(500)], "k STRING, run INT, i INT, pos DOUBLE, v DOUBLE, L BIGINT"
    )
    got = resampling.block_ci(df, ["k"], "mean", replicates=2000).first()
    blocks = np.lib.stride_tricks.sliding_window_view(v, length)
    pick = rng.integers(0, len(blocks), (2000, int(np.ceil(500 / length))))
    exact = np.percentile(blocks[pick].mean(axis=(1, 2)), [2.5, 97.5])
    width = exact[1] - exact[0]
    assert abs(got["ci_low"] - exact[0]) < 0.12 * width and abs(got["ci_high"] - exact[1]) < 0.12 * width
    seg = resampling.block_ci(df, ["k"], "mean", replicates=2000, size=40).first()
    assert seg["ci_low"] == pytest.approx(got["ci_low"], abs=1e-9)
    few = resampling.block_ci(df.where("i < 15"), ["k"], "mean", replicates=50).first()
    assert few["ci_low"] is None


def test_blocks_stay_inside_runs(spark):
    df = spark.createDataFrame([("x", i // 5, i, float(i), 1.0, 3) for i in range(20)], "k STRING, run INT, i INT, pos DOUBLE, v DOUBLE, L BIGINT")
    b = resampling.block_sums(df, ["k"], ["v"])
    assert b.count() == 4 * 3 and {r.v for r in b.collect()} == {3.0}


def test_autocorrelation_with_stacked_positions(spark):
    data = [("x", 0, i, float(i // 3) * 0.2, float((i * 7) % 5)) for i in range(30)]
    df = spark.createDataFrame(data, "k STRING, run INT, i INT, pos DOUBLE, v DOUBLE")
    v = np.array([d[4] for d in data])
    p = np.array([d[3] for d in data])
    num, cnt = np.zeros(20), np.zeros(20, int)
    for a in range(30):
        for b in range(a + 1, 30):
            if p[b] - p[a] < 3.0:
                k = int((p[b] - p[a]) / 0.15)
                num[k] += (v[a] - v.mean()) * (v[b] - v.mean())
                cnt[k] += 1
    for r in resampling.lag_autocorr(df, ["k"]).collect():
        assert r["pairs"] == cnt[r["bin"]]
        assert r["ac"] == pytest.approx(num[r["bin"]] / cnt[r["bin"]] / v.var())


def test_empty_frames_and_thin_sides(spark):
    pts = spark.createDataFrame(
        [(1, "L", 0, n, 0.5 + n, 1.2) for n in range(5)] + [(1, "R", 0, 9, 1.0, -1.0)],
        "i INT, side STRING, kind INT, o INT, X DOUBLE, Y DOUBLE",
    )
    spine = spark.createDataFrame([(1,), (2,)], "i INT")
    got = {r.i: r.cls for r in rowfit.classify_frames(pts, ["i"], spine).collect()}
    assert got == {1: "single_row", 2: "none"}
    side = {r.side: r for r in rowfit.fit_sides(pts, ["i"]).collect()}
    assert side["R"]["reason"] == "too_few_near_seed" and side["L"]["ok"]


def test_two_clean_rows(spark):
    data = [(1, s, 0, n, 0.5 + n, y + 0.02 * n) for s, y in (("L", 1.2), ("R", -1.0)) for n in range(9)]
    pts = spark.createDataFrame(data, "i INT, side STRING, kind INT, o INT, X DOUBLE, Y DOUBLE")
    r = rowfit.classify_frames(pts, ["i"]).first()
    assert r["cls"] == "two_row"
    assert r["offset"] == pytest.approx(0.1 + 0.02 * 1.5) and r["mc"] == pytest.approx(0.02)


def test_gain_grid_simulation_matches_closed_form(spark):
    f, sc = V.frames(spark, SF), V.scores(spark, SF)
    g = commands.derive_gains(f)
    inputs = commands.fold_inputs(commands.to_streams(sc, f.where("eligible").drop("eligible")), g).cache()
    sim = commands.simulate_grid(inputs).where(F.col("gain") % 4 == 0)
    plain = commands.proportional_errors(inputs)
    key = ["rec", "arm", "seed", "pass_id", "gain"]
    close(rows(sim.select(*key, "n", "sse_imu", "sse_odom"), *key), rows(plain.select(*key, "n", "sse_imu", "sse_odom"), *key), 1e-7)


def test_stream_over_several_batches_equals_batch(spark, tmp_path):
    f, sc = V.frames(spark, SF), V.scores(spark, SF)
    ok = f.where("eligible").select("rec", "i", "pass_id", "t", "vx", "yaw_odom", "yaw_imu")
    src = with_gains(commands.to_streams(sc, ok), commands.derive_gains(f)).cache()
    cut = src.selectExpr("percentile(t, 0.5)").first()[0]
    late = src.where(F.col("t") <= cut).orderBy(F.desc("t"), "arm", "seed", "i").limit(3)
    parts = [src.where(F.col("t") <= cut), src.where(F.col("t") > cut), late]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
        q = stream_commands(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        q.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(spark.read.parquet(out).schema).parquet(out)
    batch = commands.command_stream(sc, f)
    cols = ["rec", "arm", "seed", "pass_id", "i", "hold_reason", "hold_run", "omega_cmd", "omega_cmd_ramp"]
    close(rows(got.select(*cols)), rows(batch.select(*cols)))


def test_splits_never_leak(spark):
    g = V.groups(spark, SF)
    s = samples.stratified_split(samples.representative(g, "gid", "doc_id"), "gid", "stratum")
    assert s.count() == g.count() and samples.leakage(s, "gid").count() == 0


def test_block_best_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(4)
    b, q = rng.normal(size=(230, 8)), rng.normal(size=(17, 8))
    bank = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(b)], "frame BIGINT, vec ARRAY<DOUBLE>")
    qs = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(q)], "q STRING, vec ARRAY<DOUBLE>")
    monkeypatch.setattr(matching, "BANK_BLOCK", 50)
    monkeypatch.setattr(matching, "QUERY_BLOCK", 5)
    got = {(r.q, r.frame) for r in matching.block_best(bank, qs, 4).collect()}
    want = {(str(n), int(f)) for n, row in enumerate(q @ b.T) for f in np.argsort(-row)[:4]}
    assert got == want


def test_nearest_line_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    ls = [(n, *map(float, rng.uniform(0, 40, 4))) for n in range(12)]
    ps = [(n, float(x), float(y), 0.3, 0.1) for n, (x, y) in enumerate(rng.uniform(0, 40, (300, 2)))]
    lines = spark.createDataFrame(ls, "line_id BIGINT, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE")
    pts = spark.createDataFrame(ps, "i BIGINT, px DOUBLE, py DOUBLE, hx DOUBLE, hy DOUBLE")
    want = {}
    for i, x, y, *_ in ps:
        best = None
        for k, ax, ay, bx, by in ls:
            ab = np.array([bx - ax, by - ay])
            t = np.clip(((np.array([x, y]) - [ax, ay]) @ ab) / (ab @ ab), 0, 1)
            v = np.array([x, y]) - (np.array([ax, ay]) + t * ab)
            off = abs(v @ np.array([-ab[1], ab[0]]) / np.linalg.norm(ab))
            if off <= 1.6 and (best is None or off < best[0] - 1e-12):
                best = (off, k)
        if best:
            want[i] = best[1]
    assert {r.i: r.line_id for r in reference.nearest_line(pts, lines).collect()} == want


def test_rules_take_unused_rows(spark):
    df = spark.createDataFrame([(n, 10 - n) for n in range(6)], "id INT, v INT")
    always = F.lit(True)
    got = lookups.pick_by_rules(df, [("a", always, -F.col("v")), ("b", always, -F.col("v")), ("c", F.col("v") < 7, F.col("v"))], "id")
    assert [(r.rule, r.id) for r in got.orderBy("rule_no").collect()] == [("a", 0), ("b", 1), ("c", 5)]


def test_window_optimum_stops_at_first_loss(spark):
    cov, err = [50, 55, 55.5, 60], [0.20, 0.21, 0.24, 0.24]
    df = spark.createDataFrame([("A", 5.0 + 0.5 * n, c * 1.0, e) for n, (c, e) in enumerate(zip(cov, err))], "arm STRING, win DOUBLE, two_row_pct DOUBLE, full_rms DOUBLE")
    r = sweeps.window_optimum(df, ["arm"]).first()
    assert r["optimum_a"] == 5.5 and r["optimum_b"] == 5.5


def test_no_viable_cell(spark):
    df = spark.createDataFrame([("A", "agnostic", 10.0, 0.1, 0.05, 0.15)], "arm STRING, cell STRING, two_row_pct DOUBLE, rms DOUBLE, ci_low DOUBLE, ci_high DOUBLE")
    r = sweeps.select_config(df, ["arm"]).first()
    assert r["n_viable"] == 0 and r["locked"] is None and r["max_two_row_pct"] == 10.0


def test_backfill_is_additive_and_idempotent(spark):
    t = spark.createDataFrame([(1, 2.0), (2, 3.0)], "i INT, v DOUBLE")
    extra = spark.createDataFrame([(1, 9.0)], "i INT, w DOUBLE")
    once = integrity.backfill_additive(t, extra, ["i"])
    twice = integrity.backfill_additive(once, extra, ["i"])
    assert rows(once) == rows(twice) and integrity.prove_unchanged(t, once, ["w"]).count() == 0
    assert integrity.table_parity(t, t.withColumn("v", F.col("v") + 1)).count() == 4


def test_files(spark, tmp_path):
    csv = "arm,seed,i,cls,offset,heading,mL,mR,mc,n_base,adj,flags\nA,42,1,two_row,0.1,2.0,0.1,0.2,0.15,12,0,steep_slope|slope_mismatch\nA,42,2,none,,,,,,3,0,\n"
    (tmp_path / "s.csv").write_text(csv)
    s = readers.read_scores(spark, str(tmp_path / "s.csv")).orderBy("i").collect()
    assert s[0]["flags"] == ["steep_slope", "slope_mismatch"] and s[1]["offset"] is None and s[1]["flags"] == []
    man = {"meta": {"bag": "r1"}, "frames": [{"i": 0, "timestamp_ns": 5, "x": 1.0, "eligible": True}, {"i": 1, "timestamp_ns": 9, "x": 2.0, "eligible": False}]}
    (tmp_path / "m.json").write_text(json.dumps(man))
    assert rows(readers.read_manifest(spark, str(tmp_path / "m.json")).select("rec", "i", "timestamp_ns")) == [("r1", 0, 5), ("r1", 1, 9)]
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "height": 4, "width": 4}], "annotations": [{"image_id": 1, "category_id": 2, "segmentation": [[0.0, 1.0]], "bbox": [0.0]}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    a = readers.read_annotations(spark, {"train": str(tmp_path / "c.json")}).first()
    assert a["annotation"]["category_id"] == 2 and a["orig_split"] == "train"
    rep = spark.createDataFrame([(1, "A", 2.0), (1, "B", 3.0), (2, "A", 1.0)], "rec INT, arm STRING, v DOUBLE")
    reports.write_report(rep, str(tmp_path / "rep"), label=["arm"])
    assert spark.read.json(str(tmp_path / "rep")).count() == 2
    reports.write_rows(rep, str(tmp_path / "rows"), "rec", ["arm"])
    assert spark.read.csv(str(tmp_path / "rows"), header=True).count() == 3


def test_signs(spark):
    df = spark.createDataFrame([(s, "A-B", "offset", g) for s, g in ((44, "+"), (42, "-"), (43, "+"))], "seed INT, pair STRING, metric STRING, sign STRING")
    r = paired.sign_consistency(df, []).first()
    assert r["signs"] == "- + +" and not r["consistent"]


@pytest.mark.parametrize("rate", [0.01, 1.0, 50.0, 200.0, 2000.0])
def test_poisson_draws_at_any_rate(rate):
    n, reps = 400, 100
    one, two = np.random.default_rng(9).integers(1, resampling.PRIME, (2, n))
    w = resampling.poisson_draws(one, two, np.arange(1, reps + 1), resampling.poisson_plan(rate))
    assert abs(w.mean() - rate) < 5 * np.sqrt(rate / w.size)
    assert abs(w.var() / rate - 1) < 0.05 + 5 * np.sqrt((2 + 1 / rate) / w.size)


def test_frozen_integral_against_a_walk():
    rng = np.random.default_rng(2)
    base, gain, step, top = rng.normal(size=(30, 200)), rng.normal(size=30) * 2, rng.normal(size=200), np.full(200, 1.5)
    start = rng.normal(size=30)
    got = commands.frozen_integral(base, gain, step, top, start)
    for g in range(30):
        total = start[g]
        for k in range(200):
            if abs(base[g, k] + gain[g] * (total + step[k])) <= top[k]:
                total += step[k]
            assert abs(got[g, k] - total) < 1e-9


def test_stream_law_keeps_ties_and_counts_late_rows(spark, tmp_path):
    base = dict(rec=1, arm="A", seed=1, pass_id=0, vx=1.0, abstained=False, offset=0.1, heading=1.0, kp=0.5, kpsi=0.02, omega_max=0.4, v_min=0.1, slew_rate=0.9)
    batches = [[(0, 10.0), (1, 10.1), (2, 10.1)], [(3, 10.1), (4, 10.05), (5, 10.2)]]
    frames = [pd.DataFrame([{**base, "i": i, "t": t} for i, t in b]) for b in batches]
    schema = "rec BIGINT, arm STRING, seed BIGINT, pass_id BIGINT, vx DOUBLE, abstained BOOLEAN, offset DOUBLE, heading DOUBLE, kp DOUBLE, kpsi DOUBLE, omega_max DOUBLE, v_min DOUBLE, slew_rate DOUBLE, i BIGINT, t DOUBLE"
    for f in frames:
        rows_in = spark.createDataFrame(f, schema).withColumn("event_time", F.timestamp_millis(F.lit(1_704_067_200_000) + (F.col("t") * 1000).cast("bigint")))
        rows_in.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(rows_in.schema).parquet(str(tmp_path / "in"))
        q = stream_commands(src, ki=0.3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        q.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("i").collect()
    assert [(r.i, r.late_dropped) for r in got] == [(0, 0), (1, 0), (2, 0), (3, 1), (5, 1)]
