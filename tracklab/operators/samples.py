"""De-duplication, leakage-safe splits and their audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklab.plans.segments import SEGMENT_ROWS, dense_index

# fixed values: split ratios; the remainder goes to test
TRAIN_RATIO, VALID_RATIO = 0.7, 0.2


def flag_duplicates(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The first row of a group by ``order`` is canonical, the others are duplicates."""
    first = rows.groupBy(group).agg(F.min(order).alias("_first"))
    out = rows.join(first, group)
    return out.withColumn("is_duplicate", F.col(order) > F.col("_first")).drop("_first")


def representative(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Mark the lexicographically first member of each group."""
    first = rows.groupBy(group).agg(F.min(name).alias("_first"))
    return rows.join(first, group).withColumn("is_representative", F.col(name) == F.col("_first")).drop("_first")


def stratified_split(
    rows: DataFrame, group: str, stratum: str, seed: int = 42
) -> DataFrame:
    """Assign whole groups to train/valid/test inside each stratum.

    Groups are ranked by a seeded hash; rounded shares decide the cut-offs and every member inherits.
    """
    g = rows.select(group, stratum).distinct()
    g = g.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")).cast("binary")))
    g = dense_index(g, [stratum], ["_h", group], "_r")
    n = g.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    train, valid = F.bround(TRAIN_RATIO * F.col("_n"), 0), F.bround(VALID_RATIO * F.col("_n"), 0)
    g = g.join(n, stratum).withColumns({"_t": train, "_v": F.least(train + valid, F.col("_n"))})
    part = F.when(F.col("_r") < F.col("_t"), "train").when(F.col("_r") < F.col("_v"), "valid").otherwise("test")
    return rows.join(g.select(group, part.alias("split")), group)


def leakage(rows: DataFrame, group: str) -> DataFrame:
    """Groups that break the rules: more than one split, or not exactly one representative."""
    g = rows.groupBy(group).agg(
        F.min("split").alias("_a"), F.max("split").alias("_b"), F.count_if("is_representative").alias("representatives")
    )
    g = g.withColumn("crosses", F.col("_a") != F.col("_b")).drop("_a", "_b")
    return g.where("crosses or representatives <> 1")


def split_tallies(rows: DataFrame, group: str, stratum: str) -> DataFrame:
    """Rows and groups by split and stratum, with totals; a group in several strata counts once in a total."""
    per = rows.groupBy("split", stratum, group).agg(F.count(F.lit(1)).alias("_n"))
    c = per.cube("split", stratum).agg(F.sum("_n").alias("n_rows"), F.count_distinct(group).alias("n_groups"))
    return c.withColumns({k: F.coalesce(k, F.lit("ALL")) for k in ("split", stratum)})


def consume_split(rows: DataFrame) -> DataFrame:
    """Training uses every row, evaluation the representatives only."""
    return rows.where((F.col("split") == "train") | F.col("is_representative"))


def audit_counts(rows: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows expected from the split table against rows actually consumed."""
    kept = (F.col("split") == "train") | F.col("is_representative")
    want = rows.groupBy(*keys).agg(F.count_if(kept).alias("expected"))
    got = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    out = want.join(got, list(keys), "full").na.fill(0, ["expected", "actual"])
    return out.withColumn("ok", F.col("expected") == F.col("actual"))
