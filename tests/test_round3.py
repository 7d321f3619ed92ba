"""Findings of round 3: each of these failed before."""

import math

import numpy as np

from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracklab.catalog import commands as catalog_commands
from tracklab.operators import commands, reference, resampling, samples
from tracklab.plans.quantiles import exact_quantiles


def test_stale_status_runs(spark, sf):
    now = entry.queries()["K4_resolve_status"](spark, sf).where("state <> 'CURRENT'")
    stale = entry.queries()["K4_stale_status"](spark, sf)
    assert rows(stale.select("conv_id", "section", "state")) == rows(now.select("conv_id", "section", "state"))


def test_samples_on_the_edge_of_the_view(spark):
    # The robot looks along or across the line, so that samples fall on the sides of the window, or all of them lie on one.
    spots = [(1, 4.0, 0.0, 0.0, 1.0), (2, 4.0, 0.5, 0.0, 0.2), (3, 3.0, 8.0, 1.0, 0.0), (4, -1.0, 7.0, 0.2, 0.0), (5, 1.7, 20.0, 0.1, 0.3), (6, 4.0 + 1e-12, 3.0, 0.0, 0.4)]
    df = spark.createDataFrame(spots, "i INT, px DOUBLE, py DOUBLE, hx DOUBLE, hy DOUBLE")
    df = df.withColumns({"ax": F.lit(0.0), "ay": F.lit(0.0), "bx": F.lit(0.0), "by": F.lit(50.0)})
    got = reference.line_in_view(df, 1.0, 8.0).orderBy("i").collect()
    for r in got:
        h = math.radians(math.degrees(math.atan2(r.hx, r.hy)))

        def count(first, step, n):
            hits = 0
            for k in range(n):
                t = first + k * step
                x, y = r.ax + t * (r.bx - r.ax) - r.px, r.ay + t * (r.by - r.ay) - r.py
                hits += 1.0 <= -(x * math.sin(h) + y * math.cos(h)) <= 8.0 and abs(x * math.cos(h) - y * math.sin(h)) < 4.0
            return hits

        assert (r.n_segment, r.n_extended) == (count(0.0, 1.0 / 199, 200), count(-1.5, 4.0 / 399, 400)), r


def test_percentile_among_equal_values_is_that_value(spark):
    for n in (10, 45, 48):
        df = spark.range(n).select(F.lit(1).alias("k"), F.lit(0.3).alias("v"))
        assert exact_quantiles(df, ["k"], "v", [0.01]).first().q == 0.3


def test_representative_has_the_rows_of_the_split(spark, tmp_path):
    texts = [(n, f"text {n % 10}", "x" if n % 2 == 0 and n >= 20 else "y", "web", 6) for n in range(40)]
    spark.createDataFrame(texts, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["I2_representative"](spark, str(tmp_path))
    want = entry.queries()["I3_stratified_split"](spark, str(tmp_path))
    assert rows(got.select("doc_id")) == rows(want.select("doc_id"))


def test_totals_count_a_group_once(spark):
    s = _split_of_crossing_groups(spark)
    total = samples.split_tallies(s, "g", "s").where("split = 'ALL' and s = 'ALL'").first()
    assert (total.n_rows, total.n_groups) == (s.count(), 10)


def test_audit_lists_strata_of_which_nothing_is_wanted(spark):
    s = _split_of_crossing_groups(spark)
    got = samples.audit_counts(s, s.where("is_representative"), ["split", "s"])
    assert rows(got.select("split", "s")) == rows(s.select("split", "s").distinct())


def test_draws_equal_their_plain_law():
    p = resampling.PRIME
    a, b, reps = [0, p - 1, 1, 123456789, p - 2], [1, p - 1, p - 2, 987654321, 2], [1, 2, 499, 2000]
    for rate in (0.03, 1.0, 5.5, 70.0):
        parts, cuts = resampling.poisson_plan(rate)
        cells = resampling.weight_cells(cuts)
        got = resampling.poisson_draws(np.array(a), np.array(b), np.array(reps), (parts, cuts), cells)
        for n, (x0, y0) in enumerate(zip(a, b)):
            for m, rep in enumerate(reps):
                weight = 0
                for part in range(parts):
                    first = (x0 + 48271 * part) % p
                    x = (first + rep * y0) % p
                    for key in (first, y0):
                        x = (pow(x, 5, p) + key) % p
                    weight += sum(x / p > c for c in cuts)
                assert got[n, m] == weight
        # The few cells without a weight hold a threshold each, so nearly all draws are looked up.
        assert (cells < 0).sum() <= cuts.size


def test_exit_maps_of_caught_up_stretches_are_cheap_and_exact():
    rng = np.random.default_rng(3)
    for n, pace in ((3, 0.01), (50, 0.05), (4000, 0.02), (4000, 1e-6)):
        x, d = rng.uniform(-1, 1, n), rng.uniform(0, pace, n)
        xs, ys = commands._exit_map(x, d, 1.0)
        for y in (-1.0, -0.3, 0.0, 0.7, 1.0):
            want = commands._follow(y, x, d)[-1]
            got = commands._respond(y, xs, ys)
            assert abs(got - want) <= 1e-12 and (ys[0] != ys[-1] or got == want)
    assert len(commands._exit_map(*(rng.uniform(0.5, 1, 4000) for _ in range(2)), 1.0)[0]) == 2


def test_held_rows_bring_the_time_since_the_previous_row(spark, sf):
    s = entry.queries()  # registers the views
    assert "J4_hold_last" in s
    streams, gains, _ = catalog_commands._streams(spark, sf)
    held = commands.hold_last(commands.command(streams, gains, size=4), 4)
    want = commands.with_dt(held.drop("dt"), 4)
    names = [*commands.STREAM, "e", "dt"]
    assert rows(held.select(*names)) == rows(want.select(*names)) and held.count() > 0
