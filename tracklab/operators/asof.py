"""Pairing of series that run on their own clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklab.plans.segments import fills


def asof_nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, take: Sequence[str]
) -> DataFrame:
    """Give every left row the right row nearest in ``at``; an equal distance goes to the earlier one.

    One union and one carried fill instead of a range join.  Adds the taken columns, ``<at>_right`` and ``gap``.
    """
    payload = F.struct(F.col(at).alias("_at"), *[F.col(c) for c in take])
    lhs = left.withColumn("_r", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType))
    rhs = right.select(*keys, at, payload.alias("_r"))
    both = lhs.withColumn("_src", F.lit(1)).unionByName(rhs.withColumn("_src", F.lit(0)), allowMissingColumns=True)
    order = [at, "_src"]
    known = F.col("_r")
    both = fills(both, keys, order, before={"_before": known}, after={"_after": known}, idx=None)
    rows = both.where(F.col("_src") == 1)
    d_before = F.col(at) - F.col("_before._at")
    d_after = F.col("_after._at") - F.col(at)
    earlier = F.col("_after").isNull() | (F.col("_before").isNotNull() & (d_before <= d_after))
    rows = rows.withColumn("_pick", F.when(earlier, F.col("_before")).otherwise(F.col("_after")))
    return rows.select(
        *left.columns,
        *[F.col(f"_pick.{c}").alias(c) for c in take],
        F.col("_pick._at").alias(f"{at}_right"),
        F.abs(F.col(at) - F.col("_pick._at")).alias("gap"),
    )


def join_exact(frames: DataFrame, series: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Equi-join several series onto the frames and fail on the first frame without a partner."""
    out = frames
    for n, s in enumerate(series):
        tagged = s.withColumn(f"_hit{n}", F.lit(True))
        out = out.join(tagged, list(keys), "left")
        named = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
        missing = F.raise_error(F.concat(F.lit("frame without partner: "), named)).cast("boolean")
        out = out.where(F.coalesce(F.col(f"_hit{n}"), missing)).drop(f"_hit{n}")
    return out
