"""Findings of round 4: the first two tests failed before."""

from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracklab.operators import runs
from tracklab.plans import segments as S


def _ran(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_are_not_broadcast(spark, sf):
    # The stored file of these 200,000 rows is small enough for a broadcast, whatever the rows take in memory.
    s = spark.range(200_000).select((F.col("id") % 50).alias("rec"), F.expr("id div 50").alias("i"))
    got = S.fills(s, ["rec"], ["i"], before={"_b": F.when(F.col("i") % 7 == 0, F.col("i"))})
    assert "Broadcast" not in _ran(got)
    assert got.where("_b <> i - i % 7").count() == 0 and got.count() == 200_000
    assert "Broadcast" not in _ran(entry.queries()["C16_run_phase"](spark, sf))


def test_values_ahead_come_from_frames_that_grow(spark):
    s = spark.range(100_000).select((F.col("id") % 2).alias("rec"), F.expr("id div 2").alias("i"))
    got = S.fills(s, ["rec"], ["i"], after={"_a": F.when(F.col("i") % 7 == 0, F.col("i"))})
    assert "unboundedfollowing" not in _ran(got)
    assert got.where("i <= 49994 and _a <> i + (7 - i % 7) % 7").count() == 0


def test_stretches_have_both_ends(spark):
    on = {1: "1101110", 2: "1111111111", 3: "0", 4: "1", 5: "0000010"}
    s = spark.createDataFrame([(k, i, v == "1") for k, t in on.items() for i, v in enumerate(t)], "rec LONG, i LONG, on BOOLEAN")
    want = []
    for k, t in on.items():
        for i, v in enumerate(t):
            a = t.rfind("0", 0, i) + 1
            b = t.find("0", i)
            want.append((k, i, a if v == "1" else None, (b if b >= 0 else len(t)) - 1 if v == "1" else None))
    for size in (3, 4, 4096):
        got = S.islands(s.withColumn("on", F.when(F.col("on"), True)), ["rec"], F.col("on"), "a", size=size, end="b")
        assert rows(got.select("rec", "i", "a", "b"), "rec", "i") == want
        phase = runs.run_phase(s, ["rec"], F.col("on"), size)
        places = [(k, i, 0.5 if a == b else (i - a) / (b - a)) for k, i, a, b in want if a is not None]
        assert rows(phase.select("rec", "i", "centrality"), "rec", "i") == [(k, i, 1 - 2 * abs(at - 0.5)) for k, i, at in places]
