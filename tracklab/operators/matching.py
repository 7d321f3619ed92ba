"""Finding samples inside recordings: coarse search, shortlist, verification, census."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab import params as P
from tracklab.functions.geometry import band
from tracklab.session import stored

SCORE_DIGITS = 9
BANK_BLOCK, QUERY_BLOCK = 50_000, 2_000


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside ``body``; a plain reuse would evaluate it again per array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_vector(v: Column) -> Column:
    """Zero-mean, unit-length copy of a numeric array."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def scale(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        return _let(norm, lambda n: F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c))

    def centre(a: Column) -> Column:
        return _let(total(a) / F.size(a), lambda m: _let(F.transform(a, lambda x: x - m), scale))

    return _let(v.cast("array<double>"), centre)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def block_best(bank: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` bank rows most similar to each query, exactly.

    ``bank(frame, vec)`` and ``queries(q, vec)`` are cut into blocks; every pair of blocks is one matrix
    product, of which only the best ``k`` per query leave the task.  Memory per task is bounded by the
    block sizes.  Ties go to the lower frame.
    """
    n_b, n_q = _blocks(bank, BANK_BLOCK), _blocks(queries, QUERY_BLOCK)
    own_b = F.pmod(F.xxhash64("frame"), F.lit(n_b)).cast("int").alias("_b")
    own_q = F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int").alias("_q")
    lhs = bank.select("frame", "vec", own_b, F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("_q"))
    rhs = queries.select("q", "vec", own_q, F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))).alias("_b"))
    schema = T.StructType(
        [
            T.StructField("q", queries.schema["q"].dataType),
            T.StructField("frame", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "frame": [], "score": []})
        left = left.sort_values("frame")
        frames = left["frame"].to_numpy()
        sim = np.round(np.stack(right["vec"].to_numpy()) @ np.stack(left["vec"].to_numpy()).T, SCORE_DIGITS)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        m = order.shape[1]
        return pd.DataFrame(
            {
                "q": np.repeat(right["q"].to_numpy(), m),
                "frame": frames[order].ravel(),
                "score": np.take_along_axis(sim, order, 1).ravel(),
            }
        )

    part = lhs.groupBy("_b", "_q").cogroup(rhs.groupBy("_b", "_q")).applyInPandas(best, schema)
    if k == 1:
        top = part.groupBy("q").agg(F.max_by(F.struct("frame", "score"), F.struct("score", -F.col("frame"))).alias("_t"))
        return top.select("q", "_t.*")
    from tracklab.operators.lookups import top_n

    return top_n(part, ["q"], [F.desc("score"), F.asc("frame")], k).drop("rank")


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def nearby(hits: DataFrame, half: int) -> DataFrame:
    """One row per frame within ``half`` of each hit."""
    around = F.sequence(F.greatest(F.col("frame") - half, F.lit(0)), F.col("frame") + half)
    return hits.withColumn("near_frame", F.explode(around))


def coarse_fine_match(
    bank: DataFrame, versions: DataFrame, stride: int = P.COARSE_STRIDE, half: int = P.FINE_HALF
) -> DataFrame:
    """Best frame of each group over all its versions: strided search, then the neighbourhood of each hit.

    ``bank(frame, vec)`` has dense frames; ``versions(group, version, vec)``.
    """
    keyed = versions.select(F.concat_ws("|", F.col("group").cast("string"), F.col("version").cast("string")).alias("q"), "group", "version", "vec")
    keyed = stored(keyed)
    coarse = block_best(bank.where(F.col("frame") % stride == 0), keyed.select("q", "vec"), 1)
    around = nearby(coarse.select("q", "frame"), half).select("q", F.col("near_frame").alias("frame"))
    fine = around.join(keyed, "q").join(bank.withColumnRenamed("vec", "_v"), "frame")
    fine = fine.withColumn("score", F.round(dot(F.col("vec"), F.col("_v")), SCORE_DIGITS))
    best = F.max_by(F.struct("frame", "version", "score"), F.struct("score", -F.col("frame"), -F.col("version")))
    out = fine.groupBy("group").agg(best.alias("_b")).select("group", "_b.*")
    return out.withColumn("confidence", F.when(F.col("score") >= P.HIGH_SIMILARITY, "high").otherwise("low"))


def attribution_gate(
    coarse_bank: DataFrame, coarse_queries: DataFrame, bank: DataFrame, queries: DataFrame, low: int, high: int,
    stride: int = P.COARSE_STRIDE, shortlist: int = P.SHORTLIST,
) -> DataFrame:
    """Shortlist by the coarse descriptor, verify the shortlist only, keep the best, give a verdict.

    The verify score is the full similarity in whole percent.
    """
    short = block_best(coarse_bank.where(F.col("frame") % stride == 0), coarse_queries, shortlist)
    v = short.select("q", "frame").join(queries, "q").join(bank.withColumnRenamed("vec", "_v"), "frame")
    v = v.withColumn("verified", percent(F.col("vec"), F.col("_v")))
    best = F.max_by(F.struct("frame", "verified"), F.struct("verified", -F.col("frame")))
    out = v.groupBy("q").agg(best.alias("_b")).select("q", "_b.*")
    out = out.withColumn("verified", F.greatest("verified", F.lit(0)).cast("bigint"))
    return out.withColumn("verdict", band(F.col("verified"), low, high))


def percent(a: Column, b: Column) -> Column:
    return F.floor(F.round(100.0 * dot(a, b), SCORE_DIGITS - 2)).cast("bigint")


def fine_verify(gate: DataFrame, bank: DataFrame, queries: DataFrame, low: int, high: int, half: int = P.FINE_HALF) -> DataFrame:
    """Verify rows in the review band over the whole neighbourhood, keep the larger score, decide again."""
    gate = stored(gate)
    open_rows = gate.where("verdict = 'needs_review'")
    n = nearby(open_rows.select("q", "frame"), half).select("q", F.col("near_frame").alias("frame"))
    f = n.join(queries, "q").join(bank.withColumnRenamed("vec", "_v"), "frame")
    f = f.groupBy("q").agg(F.max(percent(F.col("vec"), F.col("_v"))).alias("_fine"))
    out = gate.join(f, "q", "left").withColumn("verified", F.greatest("verified", F.coalesce("_fine", "verified")))
    return out.drop("_fine").withColumn("verdict", band(F.col("verified"), low, high))


def word_grams(texts: DataFrame, key: str, n: int = 8) -> DataFrame:
    """Distinct n-word grams of whole texts, one row per gram.

    The words are passed through a one-element explode, so they are split once per text and not again for
    every gram.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " ")
    w = texts.select(key, F.explode(F.array(words)).alias("_w")).where(F.size("_w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda p: F.array_join(F.slice("_w", p, n), " "))
    return w.select(key, F.explode(F.array_distinct(grams)).alias("gram"))


def shared_grams(texts: DataFrame, items: DataFrame, key: str, item: str, n: int = 8) -> DataFrame:
    """Number of distinct grams a text shares with an item, for pairs sharing any."""
    a, b = word_grams(texts, key, n), word_grams(items, item, n)
    return a.join(b, "gram").groupBy(key, item).agg(F.count(F.lit(1)).alias("score"))


def census(matches: DataFrame, intervals: DataFrame, lengths: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per recording: matches, merged intervals, excluded share and whether the next stage may start."""
    keys = list(keys)
    m = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("located"))
    iv = intervals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_intervals"), F.sum(F.col("b") - F.col("a") + 1).alias("excluded")
    )
    st = verdicts.groupBy(*keys).agg(F.bool_or(F.col("verdict") == "needs_review").alias("_open"))
    out = lengths.join(m, keys, "left").join(iv, keys, "left").join(st, keys, "left").na.fill(0, ["located", "n_intervals", "excluded"])
    return out.select(
        *keys,
        "n",
        "located",
        "n_intervals",
        "excluded",
        (100.0 * F.col("excluded") / F.col("n")).alias("excluded_pct"),
        F.when(F.coalesce("_open", F.lit(False)), "needs_review").otherwise("clear").alias("status"),
    )
