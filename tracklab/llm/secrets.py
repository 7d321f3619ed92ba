"""Secret scan with multipart credential linking, in DataFrame operations only.

Base findings are exact: assignments to secret names, access keys, long hex runs. The linking adds weak candidates that
prove nothing alone: identifiers (``user=``, ``login=``, ``client_id=`` and the like), bare random-looking strings, and
endpoints (URLs, ``host=``). Every part opens a scope from ``REACH`` characters before its start to ``REACH`` after its end,
however long it is; two parts are near if one reaches into the other's scope. A weak part is reported only where scopes
hold complementary parts: a bare string needs an identifier and an endpoint near it, or an access key; an identifier
or endpoint needs a secret (assignment or reported bare string's candidate) and the other of the two, either in its own
scope, or both it and the other in the scope of one secret.

Positions come from the gaps between matches, so no text is walked by hand. Parts are joined by running counts over their
starts and ends within a document: those that start before a scope's end, less those that end before its start. Work
follows the parts, whatever the number in reach, and rows with a third of all documents share no key.

Defined results: a null or empty text has no findings; equal texts have equal findings, and repeated rows keep their own
row; overlapping findings of different kinds all stay; a document without weak parts never leaves its task; other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklab.llm.common import cut_lineage, free_name

REACH = 200
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:\b(user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
ENDPOINT = r"""(?i:\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[^\s"'<>]{3,}|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{3,})"""
#: A bare string of 20 or more characters with a digit, an upper and a lower letter.
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9a-z+/_=-]*[A-Z])(?=[0-9A-Z+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
#: In the order of the joined lists.
KINDS = ("assign", "access", "hex", "ident", "bare", "endpoint")
LEAST_VALUE = 6


#: Matches whose positions are summed up together; lists grow no longer than this within a text.
BLOCK = 128


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: leftmost non-overlapping matches with positions in code points, end exclusive.

    The text is split at the matches; a match starts after all gaps and matches before it. These sums are taken in blocks, and
    both lists are made once for a text, so the work is linear in the number of matches up to some ten thousand.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cells = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size"), m.alias("value")))

    def add(held: Column, cell: Column) -> Column:
        start = held["at"] + cell["gap"]
        end = start + cell["size"]
        one = F.struct(start.alias("start"), end.alias("end"), cell["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(held["spans"], F.array(one)).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    in_block = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), add, lambda held: held["spans"])

    def positions(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda at, cell: at + cell["gap"] + cell["size"]))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda held, n: F.concat(held, F.array(F.element_at(held, -1) + n)))
        placed = F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), in_block)
        return F.filter(F.flatten(placed), lambda span: span["value"].isNotNull())

    # A list of one is the way to name a value that is used more than once.
    blocks = F.transform(F.array(cells), lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / BLOCK).cast("int")), lambda k: F.slice(c, k * BLOCK + 1, BLOCK)))
    return F.when(F.size(found) > 0, F.get(F.transform(blocks, positions), F.lit(0))).otherwise(none)


def _labelled(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))


def base_findings(text: Column) -> tuple[Column, Column, Column]:
    """Spans of assignments, access keys and hex runs. An assignment with a short value is dropped after matching, so it still blocks what it covers."""
    value = F.regexp_extract
    assign = F.filter(matches(text, ASSIGN), lambda s: F.length(value(s["value"], ASSIGN, 2)) >= LEAST_VALUE)
    return _labelled(assign, "assign"), _labelled(matches(text, ACCESS), "access"), _labelled(matches(text, HEX), "hex")


def weak_candidates(text: Column) -> Column:
    """Spans of identifiers, bare strings and endpoints."""
    parts = [_labelled(matches(text, p), k) for p, k in ((IDENT, "ident"), (BARE, "bare"), (ENDPOINT, "endpoint"))]
    return F.concat(*parts)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def in_reach(parts: DataFrame, sides: dict[str, Column], reach: int) -> DataFrame:
    """Append a flag for each side: whether a part for which it holds is within ``reach`` of the row's own span."""
    own, at, opens = parts.columns, free_name(parts, "at"), free_name(parts, "opens")
    ends = F.array(*[F.struct(F.col(c).alias("at"), F.lit(c == "start").alias("opens")) for c in ("start", "end")])
    events = parts.select(*own, F.inline(ends).alias(at, opens))
    by = Window.partitionBy("key").orderBy(at)
    # Read at a part's end: parts that start up to the end of its scope. Read at its start: parts that end before its scope.
    started, ended = by.rangeBetween(Window.unboundedPreceding, reach), by.rangeBetween(Window.unboundedPreceding, -reach - 1)
    count = lambda side: F.when(F.col(opens), -F.count_if(side & ~F.col(opens)).over(ended)).otherwise(F.count_if(side & F.col(opens)).over(started))
    counted = events.select(*own, *[count(side).alias(name) for name, side in sides.items()])
    return counted.groupBy(*own).agg(*[(F.sum(name) > 0).alias(name) for name in sides])


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """From (key, start, rank, end) of all parts: the weak ones with complementary parts in reach."""
    is_one = lambda *kinds: F.col("rank").isin([KINDS.index(k) for k in kinds])
    secret = is_one("assign", "bare", "hex")
    flags = in_reach(parts, {"access": is_one("access"), "secret": secret, "who": is_one("ident", "access"), "where": is_one("endpoint")}, reach)
    flags = in_reach(flags, {"whole": secret & F.col("who") & F.col("where")}, reach)
    bare = is_one("bare") & (F.col("access") | (F.col("who") & F.col("where")))
    ident = is_one("ident") & (F.col("whole") | (F.col("secret") & F.col("where")))
    endpoint = is_one("endpoint") & (F.col("whole") | (F.col("secret") & F.col("who")))
    return flags.where(bare | ident | endpoint).select("key", "start", "rank", "end")


def scan(docs: DataFrame, name: str = "secrets", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Append a struct: base spans by kind, and the linked weak spans. Weak parts travel by a digest of their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, held, weak = (free_name(docs, x) for x in ("_key", "_held", "_weak"))
    assign, access, hexes = base_findings(text)
    found = docs.withColumn(held, F.struct(assign.alias("assign"), access.alias("access"), hexes.alias("hex"), weak_candidates(text).alias("weak")))
    base = lambda: F.concat(*[F.col(f"{held}.{k}") for k in ("assign", "access", "hex")])
    # Texts without weak parts get a key of their own that finds nothing, spread over all tasks.
    digest = F.when(F.size(f"{held}.weak") > 0, F.sha2(text, 256)).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64(text, *[c for c in docs.columns if c != text_col and dict(docs.dtypes)[c] in ("bigint", "int")]))))
    found = found.withColumn(key, digest)
    parts = found.where(F.size(f"{held}.weak") > 0).select(F.col(key).alias("key"), F.explode(F.concat(base(), F.col(f"{held}.weak"))).alias("p"))
    parts = parts.select("key", "p.start", "p.rank", "p.end").distinct()
    kept = linked(parts, reach).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias(weak)).withColumnRenamed("key", key)
    kept = cut_lineage(kept)  # read anew, so that the join can split a text that very many documents share
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    joined_back = found.join(kept, key, "left")
    plain = F.transform(base(), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    made = F.struct(plain.alias("base"), F.coalesce(F.col(weak), none).alias("weak"), F.transform(base(), lambda s: s["value"]).alias("values"))
    return joined_back.withColumn(name, made).drop(key, held, weak)
