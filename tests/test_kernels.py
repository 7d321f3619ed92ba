"""Thinning by successors and the sweep kernel against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tracklab import params as P
from tracklab.operators import rowfit, subsample, sweeps
from tracklab.operators.sidefit import POLE, TRUNK, Cell, cell_frames


def walk(xy, ds):
    kept, k = [], 0
    while k < len(xy):
        kept.append(k)
        n = k + 1
        while n < len(xy):
            far = np.flatnonzero(np.sqrt(((xy[n : n + 512] - xy[k]) ** 2).sum(axis=1)) >= ds)
            if far.size:
                n += far[0]
                break
            n += 512
        k = n
    return kept


def series():
    rng = np.random.default_rng(8)
    steps = {
        "wander": rng.normal(0, 0.4, (900, 2)),
        "even": np.tile([0.1, 0.0], (700, 1)),
        "parked": np.concatenate([rng.normal(0, 0.5, (60, 2)), np.zeros((400, 2)), rng.normal(0, 0.5, (60, 2))]),
        "still": np.zeros((500, 2)),
        "far": rng.normal(0, 50, (200, 2)),
        "one": np.zeros((1, 2)),
    }
    return {k: np.cumsum(v, axis=0) for k, v in steps.items()}


@pytest.mark.parametrize("size, names", [(3, ["far", "one"]), (64, ["wander", "even", "parked", "still", "far", "one"]), (4096, ["wander", "parked", "one"])])
def test_thinning_by_successors(spark, size, names):
    made = {k: xy[:24] if size == 3 else xy for k, xy in series().items() if k in names}
    df = spark.createDataFrame([(k, 3 * i, float(p[0]), float(p[1])) for k, xy in made.items() for i, p in enumerate(xy)], "rec STRING, i INT, x DOUBLE, y DOUBLE")
    want = sorted((k, 3 * int(i)) for k, xy in made.items() for i in walk(xy, 1.5))
    got = subsample.greedy_subsample(df.repartition(5), ["rec"], size=size)
    assert got.columns == ["rec", "i"] and rows(got) == want


def test_thinning_edges(spark):
    schema = "rec STRING, run INT, i BIGINT, x DOUBLE, y DOUBLE, pos DOUBLE"
    assert subsample.greedy_subsample(spark.createDataFrame([], schema), ["rec"]).count() == 0
    lost = spark.createDataFrame([("a", 0, 0, 0.0, 0.0, 0.0), ("a", 0, 1, None, 5.0, 1.0), ("a", 1, 2, 5.0, None, 2.0), ("a", 1, 3, 2.0, 0.0, 4.0), ("b", 0, 9, None, None, 0.0), ("b", 0, 11, 9.0, 9.0, 9.0)], schema)
    for size in (2, 100):
        assert rows(subsample.greedy_subsample(lost, ["rec"], size=size)) == [("a", 0), ("a", 3), ("b", 9)]
        assert rows(subsample.greedy_arc(lost, ["rec", "run"], size=size)) == [("a", 0, 0), ("a", 1, 2), ("a", 1, 3), ("b", 0, 9), ("b", 0, 11)]


def test_thinning_of_one_long_key(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("rec"), F.col("id").alias("i"), (F.col("id") * 0.01 + F.sin(F.col("id") * 0.37)).alias("x"), F.cos(F.col("id") * 0.011).alias("y"))
    xy = np.array([(r.x, r.y) for r in df.select("x", "y").toPandas().itertuples()])
    got = subsample.greedy_subsample(df, ["rec"])
    assert [r.i for r in got.orderBy("i").collect()] == walk(xy, 1.5)


def frames_of_points(spark, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(120):
        for side, sign in (("L", 1), ("R", -1)):
            n = int(rng.integers(0, 14))
            x = rng.choice([rng.uniform(0, 12, n), np.round(rng.uniform(0, 12, n) * 4) / 4][int(rng.integers(2))].ravel(), n) if n else []
            base = rng.choice([1.2, 1.2, 2.9, 0.4])
            for k in range(n):
                y = sign * (base + rng.choice([0.0, 0.05, 0.25, 0.5, 1.6]) + 0.02 * rng.integers(-3, 4))
                out.append((i // 3, int(i % 3), side, int(rng.integers(2)), int(rng.integers(10**6)), float(x[k]), float(y)))
    return spark.createDataFrame(out, "i INT, seed INT, side STRING, kind INT, o INT, X DOUBLE, Y DOUBLE")


def members(pts, cell):
    """Points that take part in a cell, with the order that the cell gives to equals."""
    own = pts
    if cell.only is not None:
        own = pts.where(F.col("kind") == cell.only)
    elif cell.prefer is not None:
        n = pts.groupBy("i", "seed", "side").agg(F.count_if(F.col("kind") == cell.prefer).alias("n"))
        own = pts.join(n, ["i", "seed", "side"]).where((F.col("kind") == cell.prefer) | (F.col("n") < cell.least)).drop("n")
    first = F.lit(0) if cell.first is None else (F.col("kind") != cell.first).cast("int")
    return own.withColumn("o", F.struct(first.alias("f"), F.col("o").alias("o")))


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_kernel_equals_single_fits(spark, seed):
    pts = frames_of_points(spark, seed)
    cells = [Cell("all"), Cell("wide", near=8.0), Cell("trunk", prefer=TRUNK, least=3, first=TRUNK), Cell("pole", prefer=POLE, least=2, first=POLE), Cell("only", only=POLE)]
    cols = ["i", "seed", "cls", "offset", "heading", "mL", "mR", "n_base", "adj"]
    got = cell_frames(pts, ["i", "seed"], cells)
    seen = set()
    for cell in cells:
        a = rows(got.where(F.col("cell") == cell.name).select(*cols))
        b = rows(rowfit.classify_frames(members(pts, cell), ["i", "seed"], near_m=cell.near).select(*cols))
        assert len(a) == len(b)
        for u, v in zip(a, b):
            assert u[:3] == v[:3] and u[7:] == v[7:] and all((p is None) == (q is None) and (p is None or p == pytest.approx(q, abs=1e-9)) for p, q in zip(u[3:7], v[3:7]))
            seen.add(u[2])
    assert seen == {"none", "single_row", "two_row"}
    per = {r.cell: r for r in sweeps.config_sweep(pts.withColumn("rec", F.lit(0)), ["rec"], cells=cells).collect()}
    both = got.where("cls = 'two_row'").groupBy("cell", "i").agg(F.avg("offset").alias("o"), F.count("*").alias("n")).where("n = 3").groupBy("cell").agg(F.sqrt(F.avg(F.col("o") * F.col("o"))).alias("rms"), F.count("*").alias("n"))
    assert {r.cell: r.n for r in both.collect()} == {k: r.n_two_row_frames for k, r in per.items() if r.n_two_row_frames}
    for r in both.collect():
        assert per[r.cell].offset_rms == pytest.approx(r.rms)


def test_sweep_kernel_of_nothing(spark):
    none = spark.createDataFrame([], "rec INT, i INT, seed INT, side STRING, kind INT, o INT, X DOUBLE, Y DOUBLE")
    assert cell_frames(none, ["i"], [Cell("all")]).count() == 0 and sweeps.config_sweep(none, ["rec"]).count() == 0
    lost = spark.createDataFrame([(0, 0, 42, "L", 0, 1, None, 1.0), (0, 0, 42, None, 0, 2, 1.0, 1.0), (0, 1, 42, "L", 0, 3, 1.0, 1.0)], none.schema)
    assert [tuple(r) for r in sweeps.window_frames(lost, ["rec", "i", "seed"], (5.0,)).select("i", "cls", "n_base", "win").collect()] == [(1, "none", 1, 5.0)]


def test_limiter_side_by_side():
    from tracklab.operators import commands

    rng = np.random.default_rng(4)
    for many in (1, 5, 40):
        length = rng.integers(1, 60, many)
        starts = np.cumsum(length) - length
        x, reach, entry = rng.normal(0, 1, length.sum()), rng.uniform(0, 0.4, length.sum()), rng.normal(0, 1, many)
        want = np.concatenate([commands._follow(y, x[a : a + n], reach[a : a + n]) for a, n, y in zip(starts, length, entry)])
        assert np.array_equal(commands.follow(x, reach, starts, entry), want)
    assert commands.follow(np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros(0)).size == 0


def test_nearest_line_with_far_and_lost_points(spark):
    from tracklab.operators import reference

    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.uniform(-40, 40, (300, 2)), rng.uniform(-40, 40, (50, 2)) + 7e6, [[1e9, -1e9], [1e9, 1e9 + 0.5], [1e17, 3.0]]])
    pts = [(i, float(x), float(y), 1.0, 0.2) for i, (x, y) in enumerate(xy)]
    lost = [(900, float("nan"), 1.0, 1.0, 0.0), (901, None, 1.0, 1.0, 0.0), (902, float("inf"), 0.0, 1.0, 0.0), (903, 0.0, float("-inf"), 1.0, 0.0)]
    lines = [(k, 2.45 * k - 20, -30.0, 2.45 * k - 20 + (k % 3 - 1) / 2, 50.0) for k in range(16)] + [(50, 0.0, 0.0, 1.0, 1.0), (51, 5.0, 5.0, 5.0, 5.0)]
    want = {}
    for i, x, y, *_ in pts:
        for k, ax, ay, bx, by in lines:
            n = np.hypot(bx - ax, by - ay)
            off = abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / n if n else np.inf
            if off <= 1.6 and (i not in want or (off, k) < want[i]):
                want[i] = (off, k)
    got = reference.nearest_line(spark.createDataFrame(pts + lost, "i INT, px DOUBLE, py DOUBLE, hx DOUBLE, hy DOUBLE"), spark.createDataFrame(lines, "line_id INT, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE"))
    assert {r.i: r.line_id for r in got.collect()} == {i: k for i, (_, k) in want.items()} and 351 in want
