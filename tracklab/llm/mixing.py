"""Temperature mixing of sources, in DataFrame operations only.

A source's weight is its token share to the power ``alpha``, normalised; 1 keeps the shares, 0 makes all sources equal.
``alpha`` is bisected to the largest value whose weights reach ``entropy`` (a share of the logarithm of the number of
sources), but stays high enough that no source is read more than ``repeats`` times. Each pass over the sources evaluates
``2 ** BITS - 1`` exponents, so it makes ``BITS`` bisection steps at once.

The budget in tokens is ``budget`` times all tokens; None is the least budget at which every source is read at least once,
so that no document is lost. A source's quota is its weight times the budget. It is realised as whole epochs and a last
partial one. An epoch is a block permutation: documents in the order of a hash of epoch and id, in 4,096 blocks per source by
the first three digits. The partial epoch takes the longest run of that order within the rest of the quota; only sums per
block are ordered, and one block per source is looked at row by row.

A document has as many tokens as words (runs of other than ASCII white space) and one end token.

Defined results: a null source is a source of its own; a null or empty text has one token; rows that repeat an id share a
hash and are taken or left together; a null id counts as -1 in the hash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklab.llm.common import cut_lineage, free_name, written

ENTROPY = 0.9
REPEATS = 4.0
BITS = 8
PASSES = 5
SEED = "mix"
#: Sources are broadcast up to this number, joined by a shuffle beyond.
MOST_BROADCAST = 100_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long") + 1


def source_key(source: Column) -> Column:
    """The source as text that joins a null to itself."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def order_hash(epoch: Column, doc_id: Column) -> Column:
    """Place of a document in the permutation of an epoch."""
    return F.md5(F.concat_ws("|", F.lit(SEED), epoch.cast("string"), F.coalesce(doc_id, F.lit(-1)).cast("string")))


def temperature(sources: DataFrame, entropy: float, repeats: float, budget: float | None, passes: int = PASSES, bits: int = BITS) -> float:
    """The exponent, from a table of sources with their ``tokens``; a pass brings one number to the driver."""
    log = F.log(F.col("tokens").cast("double"))
    top, total, n = sources.agg(F.max(log), F.log(F.sum("tokens").cast("double")), F.count("*")).first()
    logs = sources.select(log.alias("l"))
    lo, hi, cells = 0.0, 1.0, 2**bits
    for _ in range(passes):
        width = (hi - lo) / cells
        points = F.transform(F.sequence(F.lit(1), F.lit(cells - 1)), lambda k: F.struct(k.alias("k"), (F.lit(lo) + k * F.lit(width)).alias("a")))
        scaled = logs.select("l", F.explode(points).alias("p")).select("p.k", "l", (F.col("p.a") * (F.col("l") - F.lit(top))).alias("x"))
        rows = scaled.groupBy("k").agg(
            F.sum(F.exp("x")).alias("z"), F.sum(F.exp("x") * F.col("x")).alias("wx"), F.max(F.col("x") - F.col("l")).alias("most"), F.min(F.col("x") - F.col("l")).alias("least")
        )
        value = F.log("z") - F.col("wx") / F.col("z")
        times = F.exp(F.col("most") - F.col("least")) if budget is None else F.exp(F.col("most") + F.lit(total) - F.log("z")) * F.lit(budget)
        # True from the wanted exponent upwards: the entropy falls below the target and the repetition limit holds.
        above = (value < F.lit(entropy) * F.log(F.lit(float(n)))) & (times <= F.lit(repeats))
        first = rows.where(above).agg(F.min("k")).first()[0]
        first = cells if first is None else first
        lo, hi = lo + (first - 1) * width, lo + first * width
    return hi


def plan(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per source: key, tokens, weight, quota, full epochs, rest, and the last hash that the partial epoch takes (null: none)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), source_key(F.col(source_col)).alias("key"), token_count(F.col(text_col)).alias("n"))
    narrow = written(narrow, "tokens-of")
    sources = cut_lineage(narrow.groupBy("key").agg(F.sum("n").alias("tokens")))
    if sources.isEmpty():
        return sources.select("key", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(0).cast("long").alias("full"), F.lit(0).cast("long").alias("rest"), F.lit("").alias("last"))
    alpha = temperature(sources, entropy, repeats, budget)
    scaled = sources.withColumn("p", F.exp(F.lit(alpha) * F.log(F.col("tokens").cast("double"))))
    total = scaled.agg(F.sum("p").alias("z"), F.sum("tokens").alias("t"), F.max(F.col("tokens") / F.col("p")).alias("most")).first()
    size = total.t * budget if budget is not None else total.most * total.z
    quota = F.round(F.col("p") / F.lit(total.z) * F.lit(float(size))).cast("long")
    quotas = scaled.select("key", "tokens", (F.col("p") / F.lit(total.z)).alias("weight"), quota.alias("quota"))
    quotas = quotas.withColumn("full", F.floor(F.col("quota") / F.col("tokens"))).withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens"))
    quotas = cut_lineage(quotas)
    small = F.broadcast(quotas) if quotas.count() <= MOST_BROADCAST else quotas
    placed = narrow.join(small.where("rest > 0").select("key", "full", "rest"), "key").select("key", "rest", "n", order_hash(F.col("full"), F.col("id")).alias("h"))
    placed = placed.withColumn("block", F.substring("h", 1, 3))
    sums = placed.groupBy("key", "rest", "block").agg(F.sum("n").alias("n"))
    upto = sums.select("key", "rest", "block", (F.sum("n").over(Window.partitionBy("key").orderBy("block")) - F.col("n")).alias("before"), "n")
    edge = cut_lineage(upto.where("before <= rest"))
    # Blocks wholly inside the rest need no look at their rows; the one that crosses it does.
    inside = edge.where("before + n <= rest").groupBy("key").agg(F.max("block").alias("inside"))
    crossing = edge.where("before + n > rest").select("key", "block", "before")
    crossing = F.broadcast(crossing) if quotas.count() <= MOST_BROADCAST else crossing
    rows = placed.join(crossing, ["key", "block"]).select("key", "h", "rest", (F.col("before") + F.sum("n").over(Window.partitionBy("key", "block").orderBy("h"))).alias("sum"))
    last = rows.where("sum <= rest").groupBy("key").agg(F.max("h").alias("last"))
    found = quotas.join(inside, "key", "left").join(last, "key", "left")
    found = found.withColumn("last", F.coalesce("last", F.concat("inside", F.lit("g")))).drop("inside")
    return cut_lineage(found.select("key", "tokens", "weight", "quota", "full", "rest", "last"))


def with_copies(docs: DataFrame, sources: DataFrame, name: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Append a struct: weight of the document's source, full epochs, whether the partial epoch takes it, copies, its place in that epoch."""
    key = free_name(docs, "_key")
    table = sources.select(F.col("key").alias(key), F.struct("weight", "full", "last").alias(key + "s"))
    table = F.broadcast(table) if sources.count() <= MOST_BROADCAST else table
    joined = docs.withColumn(key, source_key(F.col(source_col))).join(table, key)
    own = F.col(key + "s")
    place = order_hash(own["full"], F.col(id_col).cast("long"))
    taken = F.coalesce(place <= own["last"], F.lit(False))
    made = F.struct(own["weight"].alias("weight"), own["full"].alias("full"), taken.alias("partial"), (own["full"] + taken.cast("long")).alias("copies"), place.alias("place"))
    return joined.withColumn(name, made).drop(key, key + "s")


def realise(docs: DataFrame, sources: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixed rows with the columns of the input: each document once for each of its copies."""
    name = free_name(docs, "mix")
    marked = with_copies(docs, sources, name, id_col, source_col).where(F.col(f"{name}.copies") > 0)
    turn = free_name(marked, "_turn")
    return marked.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies")))).drop(turn, name)
