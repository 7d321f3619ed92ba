"""Exclusion intervals, screens and human decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklab import params as P
from tracklab.functions.geometry import area_fraction
from tracklab.plans.segments import SEGMENT_ROWS, bounded, dense_index, fills


def merge_intervals(
    points: DataFrame, lengths: DataFrame, keys: Sequence[str], half: int, size: int = SEGMENT_ROWS
) -> DataFrame:
    """Points widened by ``half`` rows, clipped to the recording (``n`` rows) and merged when they touch."""
    keys = list(keys)
    p = points.select(*keys, "i").distinct()
    p = dense_index(p, keys, ["i"], "_k")
    apart = lambda w: {"_new": F.coalesce(F.col("i") - half > F.lag("i").over(w) + half + 1, F.lit(False)).cast("int")}
    p = bounded(p, keys, 1, [apart], idx="_k", size=size)
    p = fills(p, keys, ["_k"], sums={"_g": F.col("_new")}, idx="_k", size=size)
    g = p.groupBy(*keys, "_g").agg((F.min("i") - half).alias("a"), (F.max("i") + half).alias("b")).join(lengths, keys)
    return g.select(*keys, F.greatest("a", F.lit(0)).alias("a"), F.least("b", F.col("n") - 1).alias("b"))


def flag_in_intervals(
    rows: DataFrame, intervals: DataFrame, keys: Sequence[str], out: str = "inside", size: int = SEGMENT_ROWS
) -> DataFrame:
    """Mark rows inside one of the merged (disjoint) intervals, both ends included."""
    keys = list(keys)
    start = intervals.select(*keys, F.col("a").alias("i"), F.col("b").alias("_b"))
    hit = fills(rows.join(start, [*keys, "i"], "left"), keys, ["i"], before={"_b": F.col("_b")}, size=size)
    return hit.withColumn(out, F.coalesce(F.col("i") <= F.col("_b"), F.lit(False))).drop("_b")


def screen(boxes: DataFrame, keys: Sequence[str], target: int, conf: float = P.SCREEN_CONF) -> DataFrame:
    """Frames with a target-class hit at or above ``conf``."""
    hits = boxes.where((F.col("cls") == target) & (F.col("conf") >= conf)).withColumn("_f", area_fraction())
    g = hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_hits"), F.max("conf").alias("max_conf"), F.max("_f").alias("max_fraction")
    )
    return g.withColumn("likely_distant", F.col("max_fraction") < P.DISTANT_FRACTION)


def exclude_flagged(rows: DataFrame, flagged: DataFrame, screened: DataFrame, keys: Sequence[str], scope: str = "rec") -> DataFrame:
    """Rows not flagged by the screen; a recording that was never screened is an error."""
    done = rows.join(screened.select(scope, F.lit(True).alias("_done")).distinct(), scope, "left")
    fail = F.raise_error(F.concat(F.lit("recording was never screened: "), F.col(scope).cast("string"))).cast("boolean")
    done = done.where(F.coalesce(F.col("_done"), fail)).drop("_done")
    return done.join(flagged.select(*keys).distinct(), list(keys), "left_anti")


def apply_confirmations(verdicts: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Human decisions replace ``needs_review`` only; what stays undecided keeps blocking."""
    out = verdicts.join(decisions.select(key, "decision"), key, "left")
    use = (F.col("verdict") == "needs_review") & F.col("decision").isin("present", "absent")
    use = F.coalesce(use, F.lit(False))
    return out.withColumns({"verdict": F.when(use, F.col("decision")).otherwise(F.col("verdict")), "confirmed": use}).drop(
        "decision"
    )


def gate_status(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``needs_review`` while any row is undecided, else ``clear``."""
    blocked = F.bool_or(F.col("verdict") == "needs_review")
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("present", "needs_review", "absent")]
    return verdicts.groupBy(*keys).agg(F.when(blocked, "needs_review").otherwise("clear").alias("status"), *counts)


def require_clear(status: DataFrame) -> DataFrame:
    """Pass cleared recordings on and fail on any other."""
    fail: Column = F.raise_error(F.lit("review is pending; the next stage is blocked")).cast("boolean")
    return status.where(F.when(F.col("status") == "clear", F.lit(True)).otherwise(fail))
