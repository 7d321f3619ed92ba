"""Picking rows: anchors, even samples, representatives, prioritised picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklab.plans.quantiles import quantile_columns
from tracklab.plans.segments import SEGMENT_ROWS, dense_index


def mid_run_anchors(
    rows: DataFrame, keys: Sequence[str], k: int = 2, size: int = SEGMENT_ROWS
) -> DataFrame:
    """``k`` rows at the middle of each key's longest run (``pass_id``); the earlier run wins ties."""
    keys = list(keys)
    runs = rows.groupBy(*keys, "pass_id").agg(F.count(F.lit(1)).alias("_n"), F.min("i").alias("_first"))
    best = runs.groupBy(*keys).agg(
        F.max_by(F.struct("pass_id", "_n"), F.struct("_n", -F.col("_first"))).alias("_b")
    ).select(*keys, "_b.pass_id", "_b._n")
    held = rows.join(best, [*keys, "pass_id"])
    held = dense_index(held, [*keys, "pass_id"], ["i"], "_at")
    first = F.greatest(F.lit(0), F.floor((F.col("_n") - k) / 2))
    return held.where((F.col("_at") >= first) & (F.col("_at") < first + k)).drop("_at", "_n")


def even_sample(rows: DataFrame, keys: Sequence[str], order: str, n: int, size: int = SEGMENT_ROWS) -> DataFrame:
    """``n`` rows spread evenly over each key, ends included (position = integer part of the even step)."""
    keys = list(keys)
    ranked = dense_index(rows, keys, [order], "_at")
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda j: F.floor(j * (F.col("_n") - 1) / F.lit(float(max(n - 1, 1)))).cast("bigint"),
    )
    wanted = total.select(*keys, F.explode(F.array_distinct(step)).alias("_at"))
    return ranked.join(wanted, [*keys, "_at"]).drop("_at")


def median_representative(
    rows: DataFrame, keys: Sequence[str], value: str, tie: str, skip: Column | None = None, size: int = SEGMENT_ROWS
) -> DataFrame:
    """Row of each key closest to the key's median of ``value``; lowest ``tie`` first, skipped rows excluded."""
    keys = list(keys)
    mid = quantile_columns(rows, keys, value, {"median": 0.5})
    cand = (rows if skip is None else rows.where(~skip)).join(mid, keys)
    best = F.min_by(F.struct(tie, value), F.struct(F.abs(F.col(value) - F.col("median")), F.col(tie)))
    return cand.groupBy(*keys).agg(F.max("median").alias("median"), best.alias("_b")).select(*keys, "median", "_b.*")


def pick_by_rules(rows: DataFrame, rules: Sequence[tuple[str, Column, Column]], tie: str) -> DataFrame:
    """For each rule in turn the best row not taken by an earlier rule.

    With R rules the row a rule ends up with is among its own R best, so only those meet; the greedy pass
    then runs over at most R x R rows inside one array fold.
    """
    depth = len(rules)
    tops = []
    for n, (name, cond, rank) in enumerate(rules):
        top = (
            rows.where(cond)
            .select(F.lit(n).alias("rule_no"), F.lit(name).alias("rule"), rank.cast("double").alias("_rank"), F.col(tie).alias("id"))
            .orderBy("_rank", "id")
            .limit(depth)
        )
        tops.append(top)
    cand = tops[0]
    for t in tops[1:]:
        cand = cand.unionByName(t)
    ordered = F.array_sort(F.collect_list(F.struct("rule_no", "_rank", "id", "rule")))
    free = lambda acc, x: ~F.exists(acc, lambda a: (a.rule_no == x.rule_no) | (a.id == x.id))
    empty = F.filter(F.col("_all"), lambda x: F.lit(False))
    picked = F.aggregate("_all", empty, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return cand.agg(ordered.alias("_all")).select(F.explode(picked).alias("_p")).select("_p.rule_no", "_p.rule", "_p.id")


def top_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Top-k report per key; Spark keeps only ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
