"""Completeness, parity, additive backfill and status of append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklab.plans.segments import SEGMENT_ROWS, dense_index, fills


def completeness(
    recordings: DataFrame, present: DataFrame, artefacts: Sequence[str], exempt: DataFrame | None = None, key: str = "rec"
) -> DataFrame:
    """Expected artefacts of each recording that are missing and not exempt."""
    want = recordings.select(key, F.explode(F.array(*[F.lit(a) for a in artefacts])).alias("artefact"))
    want = want.join(present.select(key, "artefact").distinct(), [key, "artefact"], "left_anti")
    return want if exempt is None else want.join(exempt.select(key, "artefact"), [key, "artefact"], "left_anti")


def table_parity(left: DataFrame, right: DataFrame, normalise: dict[str, Column] | None = None) -> DataFrame:
    """Rows, with multiplicity, found on one side only after normalising the named columns."""
    cols = left.columns
    norm = normalise or {}

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(*[norm.get(c, F.col(c)).alias(c) for c in cols], F.lit(n).alias("_n"))

    both = side(left, 1).unionByName(side(right, -1)).groupBy(*cols).agg(F.sum("_n").alias("_d"))
    drift = both.where("_d <> 0")
    return drift.withColumn("side", F.when(F.col("_d") > 0, "left").otherwise("right")).withColumn(
        "copies", F.abs("_d")
    ).drop("_d")


def backfill_additive(table: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add or refresh derived columns; running it again changes nothing."""
    new = [c for c in extra.columns if c not in keys]
    return table.drop(*new).join(extra, list(keys), "left")


def prove_unchanged(before: DataFrame, after: DataFrame, new: Sequence[str]) -> DataFrame:
    """Drift in the columns that existed before a backfill; must be empty."""
    old = [c for c in before.columns if c not in new]
    return table_parity(before.select(*old), after.select(*old))


STATES = ("CURRENT", "AMENDED", "PARTIAL", "DEAD")


def resolve_status(
    text: DataFrame,
    keys: Sequence[str],
    order: str,
    header: Column,
    patterns: dict[str, str],
    retires: str,
    size: int = SEGMENT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """State of every section of an append-only log, and the ids each section retires.

    Blocks where ``header`` is true open a section; lines of later blocks belong to it.  The strongest marker
    among its lines decides (DEAD, PARTIAL, AMENDED, else CURRENT).
    """
    keys = list(keys)
    t = fills(text, keys, [order], before={"section": F.when(header, F.col(order))}, idx=None)
    lines = t.where(F.col("section").isNotNull()).select(
        *keys, "section", order, F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    rank = F.lit(0)
    for n, state in enumerate(STATES[1:], start=1):
        rank = F.greatest(rank, F.when(F.col("line").rlike(patterns[state]), n).otherwise(0))
    lines = lines.withColumn("_rank", rank)
    state = lines.groupBy(*keys, "section").agg(
        F.element_at(F.array(*[F.lit(s) for s in STATES]), F.max("_rank") + 1).alias("state"),
        F.count_if(F.col("_rank") > 0).alias("n_markers"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    dead = lines.select(*keys, "section", F.explode(F.regexp_extract_all("line", F.lit(retires), F.lit(1))).alias("retired"))
    return state, dead.distinct()


def stale_status(current: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sections whose stored state no longer matches, is missing, or is left over."""
    s = stored.select(*keys, F.col("state").alias("stored"))
    return current.select(*keys, "state").join(s, list(keys), "full").where(~F.col("state").eqNullSafe(F.col("stored")))


def inventory(messages: DataFrame, keys: Sequence[str], value: str, time: str) -> DataFrame:
    """Messages per topic with duration and signal statistics; a flat signal is marked."""
    g = messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.max(time) - F.min(time)) / 1e6).alias("duration_s"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return g.withColumn("flat", F.col("min") == F.col("max"))


def at_fractions(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], fractions: Sequence[float]
) -> DataFrame:
    """Rows at fixed fractions of each session (position int(f * (n - 1)))."""
    keys = list(keys)
    ranked = dense_index(rows, keys, order, "_k")
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spots = F.array(*[F.struct(F.lit(f).alias("fraction"), F.floor(f * (F.col("_n") - 1)).alias("_k")) for f in fractions])
    want = n.select(*keys, F.explode(spots).alias("_s")).select(*keys, "_s.*")
    return ranked.join(want, [*keys, "_k"]).drop("_k")
