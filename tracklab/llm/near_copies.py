"""Near-duplicates of a Jaccard similarity of 0.8 or more over shingles of five words, for the corpus pipeline.

At that similarity the SimHash fingerprints of whole texts lie about 10 of 64 bits apart (an angle of arccos 0.889), where
no cover by anchors separates copies from other texts. So candidates come from two sides and every one is checked exactly:

* whole texts: fingerprints within three bits, by the anchor-point covering of ``simhash``;
* samples: of each of BANDS groups of ROWS hash orders, the shingle that is smallest under each order. Two texts draw the
  same sample with probability similarity ** ROWS, so a pair of similarity 0.8 shares one of 12 samples in 99.8 % of cases.

Texts of equal words (A-Z in lower case, any ASCII white space between) are one class, known by its 64-bit hash, before
anything is joined. A group of candidates is compared with one centre, the class that meets most others in all its samples, never
pair by pair; within a sample, those who also agree on half of the next one have a centre of their own. A link counts if the exact
similarity of the two shingle sets reaches the limit. Links that no centre shows are found by prefixes: two sets of a similarity of
0.8 or more share one of the first fifth of their shingles in any common order, here from rare to frequent. Shingles that only
classes of one group share are left out. Classes that share another one meet in tiles of bounded size, where sizes, places and parity
bits rule out nearly all pairs; a task returns no pairs but links that connect those left. What these connect is compared exactly,
again in tiles that return at most one link a class, so that no link between two groups is lost. Components of all links are the result.

Only texts that are compared are shuffled: the others are left out by a bitmap of one bit a row, the part of it for 32,768
rows being one row of a small table.

A centre with many candidates is copied to tasks of MEMBERS candidates each, and tasks hold one centre's shingles at a time.

Defined results: fewer words than a shingle are one shingle; texts without words (null, empty, blank) are one class; of a
group the smallest id stays (a row without one only if no row has an id), then the smallest text hash, then one of
the equal rows; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab.llm import simhash
from tracklab.llm.common import free_name, with_struct, written

SHINGLE = 5
SIMILAR = 0.8
BANDS = 12
ROWS = 4
#: Fingerprints on each side of a tile of the cover; copies fill whole tiles, whose matrices two tasks of an executor hold.
TILE = 1024
#: Candidates compared with one copy of their centre.
MEMBERS = 500
#: Classes of one shingle on each side of a tile, and pairs that are looked at together.
MEET = 512
PAIRS = 1 << 17
#: Classes, and shingles of all of them, on each side of a tile that compares exactly.
EXACT = 1024
EXACT_SHINGLES = 1 << 20
#: Connected classes that a task remembers.
HELD = 500_000
#: Texts, about, that show which shingles are frequent, and shingles kept. They set the order of the prefixes only: any order is exact.
SHOWN = 10_000
FREQUENT = 50_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def orders(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``count`` hash orders."""
    made = np.random.default_rng(42).integers(0, 1 << 63, (2, count), np.int64).astype(np.uint64)
    return made[0] * np.uint64(2) + np.uint64(1), made[1]


def smallest(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each order, in slices of bounded size."""
    low = np.full(factors.size, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, hashes.size, 1 << 12):
        low = np.minimum(low, (hashes[k : k + (1 << 12)] * factors[:, None] + offsets[:, None]).min(axis=1))
    return low


def sample_keys(low: np.ndarray) -> np.ndarray:
    """Two keys for each sample: of itself, and of itself with half of the next one."""

    def fold(key: np.ndarray, values: np.ndarray) -> np.ndarray:
        for column in values.T:
            key = (key ^ column) * MIX
            key = key ^ (key >> np.uint64(29))
        return key

    bands = low.reshape(BANDS, ROWS)
    own = fold(np.zeros(BANDS, np.uint64), bands)
    return np.concatenate([own, fold(own, np.roll(bands, -1, axis=0)[:, : ROWS // 2])])


def with_marks(docs: DataFrame, name: str, text_col: str) -> DataFrame:
    """Append a struct: ``cls`` (hash of the words), ``fp`` (SimHash), ``n`` (shingles) and ``keys`` of the samples."""
    schema = T.StructType(
        [T.StructField("cls", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    )

    def work():
        from xxhash import xxh64_intdigest

        factors, offsets = orders(BANDS * ROWS)

        def apply(texts: pa.Array) -> pa.StructArray:
            cls, fp, n, keys = [], [], [], []
            for item in texts.cast(pa.binary()):
                text = item.as_py() or b""
                hashes = simhash.shingle_hashes(text, SHINGLE)
                cls.append(xxh64_intdigest(b" ".join(text.lower().split()), simhash.SEED))
                fp.append(simhash.fingerprint(hashes))
                n.append(hashes.size)
                keys.append(sample_keys(smallest(hashes, factors, offsets)).view(np.int64) if hashes.size else None)
            signed = np.array(cls, np.uint64).view(np.int64)
            return pa.StructArray.from_arrays([pa.array(signed), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["cls", "fp", "n", "keys"])

        return apply

    return with_struct(docs, [text_col], name, schema, work)


def candidates(classes: DataFrame) -> DataFrame:
    """(cls, centre): classes to be compared with the centres of a group they belong to, each pair once."""

    slots = classes.select("cls", F.posexplode(F.array(*[f"key{k}" for k in range(2 * BANDS)])).alias("slot", "key"))
    roots = simhash.components(simhash.links(classes.select("fp").distinct(), tile=TILE))
    whole = classes.join(roots, classes["fp"] == roots["node"], "left").select("cls", F.lit(-1).alias("slot"), F.coalesce("root", "fp").alias("key"))
    keys, group = written(slots.unionByName(whole), "keys"), ["slot", "key"]
    met = written(keys.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1"), "met")
    shared = written(keys.join(met, group), "shared")
    score = shared.groupBy("cls").agg(F.sum("n").alias("score"))
    centres = written(shared.join(score, "cls").groupBy(*group).agg(F.max(F.struct("score", "cls"))["cls"].alias("centre")), "centres")
    found = shared.join(centres, group).where("cls <> centre")
    return written(found.select(F.greatest("cls", "centre").alias("cls"), F.least("cls", "centre").alias("centre")).distinct(), "candidates")


def alike(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs (cls, centre) whose shingle sets have a Jaccard similarity of ``least`` or more.

    ``texts`` has one row (cls, text) for each class.
    """
    crowd = written(pairs.groupBy("centre").agg(F.ceil(F.count("*") / MEMBERS).alias("parts")), "crowd")
    dealt = written(pairs.join(crowd, "centre").select("cls", "centre", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part")), "dealt")
    roles = dealt.withColumn("member", F.lit(True)).unionByName(dealt.select(F.col("centre").alias("cls"), "centre", "part").distinct().withColumn("member", F.lit(False)))
    keys = ["centre", "part"]
    placed = roles.join(texts, "cls").select(*keys, "member", "cls", "text").repartition(*keys).sortWithinPartitions(*keys, "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = None
        for batch in batches:
            a, b = [], []
            centre, member, cls = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for at, text in enumerate(batch.column(4).cast(pa.binary())):
                own = np.unique(simhash.shingle_hashes(text.as_py(), SHINGLE))
                if not member[at]:
                    core = own
                    continue
                if min(own.size, core.size) < least * max(own.size, core.size):
                    continue
                shared = np.intersect1d(own, core, assume_unique=True).size
                if shared >= least * (own.size + core.size - shared):
                    a.append(cls[at])
                    b.append(centre[at])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return written(placed.mapInArrow(run, "a long, b long"), "alike")


def parity(hashes: np.ndarray) -> bytes:
    """Bit k tells whether an odd number of the hashes end in k. Two such bitmaps differ in no more bits than the sets in elements.

    Their length is the largest power of two up to the size of the set, 512 at least and 32,768 at most.
    """
    size = 1 << min(max(hashes.size.bit_length() - 1, 9), 15)
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words, place, table) for every length: the bitmaps of that length or more, folded to it, and the row's place among them."""
    words = np.array([len(b) // 8 for b in bits], np.int64)
    out, level = [], 8
    while words.size and level <= words.max():
        able = np.flatnonzero(words >= level)
        place, table = np.full(words.size, -1), np.empty((able.size, level), np.uint64)
        place[able] = np.arange(able.size)
        for w in np.unique(words[able]):
            own = np.flatnonzero(words[able] == w)
            whole = np.frombuffer(b"".join(bits[k] for k in able[own]), np.uint64).reshape(own.size, w // level, level)
            table[own] = np.bitwise_xor.reduce(whole, axis=1)
        out.append((level, place, table))
        level *= 2
    return out


def pairs_within(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of one group, about ``PAIRS`` at a time; ``ends`` is where the group of a row ends."""
    count = ends - np.arange(ends.size) - 1
    until = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < ends.size:
        hi = max(lo + 1, int(np.searchsorted(until, until[lo] + PAIRS, "right")) - 1)
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        yield i, np.arange(i.size) - np.repeat(until[lo:hi] - until[lo], c) + i + 1
        lo = hi


def possible(tables: list[tuple[int, np.ndarray, np.ndarray]], n: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows can have a similarity of ``least`` or more, by sizes and parity bits."""
    ok = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
    most = (1 - least) / (1 + least) * (n[i] + n[j]) + 1e-9
    for level, place, table in tables:
        at = np.flatnonzero(ok & (place[i] >= 0) & (place[j] >= 0))
        step = (1 << 20) // level
        for k in range(0, at.size, step):
            part = at[k : k + step]
            ok[part] = np.bitwise_count(table[place[i[part]]] ^ table[place[j[part]]]).sum(axis=1, dtype=np.int64) <= most[part]
    return ok


class Forest:
    """Which nodes are connected so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def find(self, node: int) -> int:
        above = self.above
        while (up := above.get(node, node)) != node:
            above[node] = node = above.get(up, up)
        return node

    def join(self, a: int, b: int) -> bool:
        """Connect two nodes; false if they were connected."""
        a, b = self.find(a), self.find(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def in_tiles(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, one, two, part, cls, *columns), tile by tile: a tile has two of the ``parts`` of a group, every row goes to all tiles of its own part."""
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    every = rows.withColumn("part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    keys = [group, "one", "two"]
    tiled = every.withColumns({"one": F.least("part", "_other"), "two": F.greatest("part", "_other")}).select(*keys, "part", "cls", *columns)
    return tiled.repartition(*keys).sortWithinPartitions(*keys)


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of whole tiles, where the tile of each row ends); the first ``keys`` columns name a tile."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches(([] if held is None else held.to_batches()) + [batch])
        if not table.num_rows:
            continue
        key = np.stack([table.column(k).to_numpy().astype(np.int64) for k in range(keys)])
        cuts = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
        last = int(cuts[-1]) if cuts.size else 0
        held = table.slice(last)
        if last:
            yield table.slice(0, last), np.repeat(cuts, np.diff(cuts, prepend=0))
    if held is not None and held.num_rows:
        yield held, np.full(held.num_rows, held.num_rows)


def frequent_shingles(marked: DataFrame, cls, text) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, rank): the shingles found most often in a bounded sample of the texts, from rare to frequent by rank from 1."""
    every = max(1, marked.count() // SHOWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column(0).cast(pa.binary()):
                own = np.unique(simhash.shingle_hashes(item.as_py(), SHINGLE))
                for k in range(0, own.size, 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(own[k : k + (1 << 14)].view(np.int64))], names=["token"])

    shown = marked.where(F.pmod(F.xxhash64(cls), F.lit(every)) == 0).select(text.alias("text"))
    counts = shown.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    tokens = np.array([r["token"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.arange(len(found), 0, -1)[order]


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The shingles of a set, from rare to frequent, one of which every set of a similarity of ``least`` or more must share."""
    tokens, ranks = frequent
    rank = np.zeros(hashes.size, np.int64)
    if tokens.size:
        at = np.minimum(np.searchsorted(tokens, hashes), tokens.size - 1)
        rank = np.where(tokens[at] == hashes, ranks[at], 0)
    return hashes[np.lexsort((hashes, rank))][: hashes.size - int(np.ceil(least * hashes.size - 1e-9)) + 1]


def shared_prefixes(marked: DataFrame, cls, text, least: float) -> DataFrame:
    """(token, cls, at, n, bits): places ``at`` of prefix shingles that several rows have, and the number of shingles of the class.

    One row more for each class has no place (-1) and its parity bits.
    """
    frequent = frequent_shingles(marked, cls, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for one, item in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if one in seen:
                    continue
                seen = seen if len(seen) < 100_000 else set()
                seen.add(one)
                own = np.unique(simhash.shingle_hashes(item.as_py(), SHINGLE))
                if own.size:
                    first = prefix(own, frequent, least)
                    # The row of the bits goes where its class does, so that these rows are spread too.
                    tokens = np.concatenate([[one], first.view(np.int64)])
                    columns = [tokens, np.full(tokens.size, one), np.arange(-1, first.size, dtype=np.int32), np.full(tokens.size, own.size, np.int32)]
                    bits = pa.concat_arrays([pa.array([parity(own)], pa.binary()), pa.nulls(first.size, pa.binary())])
                    yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], bits], names=["token", "cls", "at", "n", "bits"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class once for a token that several have, and for its bits; the last row of a batch waits for the next one."""
        held, before, known = None, None, None
        for batch in batches:
            lone = batch.filter(pc.less(batch.column(2), 0))
            if lone.num_rows:
                one = lone.column(1).to_numpy()
                yield lone.filter(pa.array(np.concatenate([[one[0] != known], one[1:] != one[:-1]])))
                known = one[-1]
                batch = batch.filter(pc.greater_equal(batch.column(2), 0))
            table = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
            if not table.num_rows:
                continue
            token, one = table.column("token").to_numpy(), table.column("cls").to_numpy()
            again = np.concatenate([[False], (token[1:] == token[:-1]) & (one[1:] == one[:-1])])
            table, token = table.filter(pa.array(~again)).combine_chunks(), token[~again]
            same = token[1:] == token[:-1]
            keep = np.concatenate([[before is not None and before == token[0]], same]) | np.concatenate([same, [False]])
            yield from table.slice(0, table.num_rows - 1).filter(pa.array(keep[:-1])).to_batches()
            held = table.slice(table.num_rows - 1).to_batches()[0]
            before = token[-2] if token.size > 1 else before
        if held is not None and before is not None and before == held.column("token")[0].as_py():
            yield held

    schema = "token long, cls long, at int, n int, bits binary"
    placed = marked.select(cls.alias("cls"), text.alias("text")).mapInArrow(cut, schema)
    return written(placed.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(repeated, schema), "prefixes")


def crossing(prefixes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(cls, centre): links that connect the classes of all pairs of different groups that may have a similarity of ``least`` or more.

    Not every such pair is a link. At the first shingle that two similar sets share in the common order, what is left of both
    is as much as they share at least.
    """
    places = prefixes.where("at >= 0").drop("bits")
    rooted = places.join(roots, places["cls"] == roots["node"], "left").select("token", "cls", "at", "n", F.coalesce("root", "cls").alias("root"))
    rooted = written(rooted, "rooted")
    several = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / MEET).alias("parts")).where("low < high")
    rows = rooted.join(several.select("token", "parts"), "token").join(prefixes.where("at < 0").select("cls", "bits"), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table, ends in whole_tiles(batches, 3):
            one, two, part, cls, at, n, root = (table.column(k).to_numpy().astype(np.int64) for k in range(1, 8))
            tables = folded(table.column(8).to_pylist())
            for i, j in pairs_within(ends):
                overlap = least / (1 + least) * (n[i] + n[j]) - 1e-9
                meet = (root[i] != root[j]) & ((one[i] == two[i]) | (part[i] != part[j])) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= overlap)
                i, j = i[meet], j[meet]
                ok = possible(tables, n, i, j, least)
                pairs = zip(cls[i[ok]].tolist(), cls[j[ok]].tolist())
                links = [(max(a, b), min(a, b)) for a, b in pairs if forest.join(a, b)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["cls", "centre"])
            if len(forest.above) > HELD:
                forest = Forest()

    tiles = in_tiles(rows, "token", ["at", "n", "root", "bits"])
    return written(tiles.mapInArrow(run, "cls long, centre long").distinct(), "crossing-links")


def alike_within(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): links of a similarity of ``least`` or more between classes of one set, as many as connect what such links connect.

    ``members`` has (cls, whole, root, n): the set, the group that the class is known to belong to and its shingles; classes of
    one group are not compared. ``texts`` has one row (cls, text) for each class.
    """
    parts = F.ceil(F.greatest(F.count("*") / EXACT, F.sum("n") / EXACT_SHINGLES)).alias("parts")
    crowd = written(members.groupBy("whole").agg(parts), "wholes")
    rows = members.join(crowd, "whole").join(texts, "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in whole_tiles(batches, 3):
            for lo, hi in zip(np.unique(np.concatenate([[0], ends]))[:-1].tolist(), np.unique(ends).tolist()):
                one, two, part, cls, root = (table.column(k).slice(lo, hi - lo).to_numpy().astype(np.int64) for k in range(1, 6))
                sets = [np.unique(simhash.shingle_hashes(t.as_py(), SHINGLE)) for t in table.column(6).slice(lo, hi - lo).cast(pa.binary())]
                n, tables, forest, links = np.array([x.size for x in sets], np.int64), folded([parity(x) for x in sets]), Forest(), []
                for i, j in pairs_within(np.full(hi - lo, hi - lo)):
                    meet = (root[i] != root[j]) & ((one[i] == two[i]) | (part[i] != part[j]))
                    i, j = i[meet], j[meet]
                    ok = possible(tables, n, i, j, least)
                    for x, y in zip(i[ok].tolist(), j[ok].tolist()):
                        if forest.find(int(root[x])) == forest.find(int(root[y])):
                            continue
                        shared = np.intersect1d(sets[x], sets[y], assume_unique=True).size
                        if shared >= least * (n[x] + n[y] - shared):
                            forest.join(int(root[x]), int(root[y]))
                            links.append((int(cls[x]), int(cls[y])))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return written(in_tiles(rows, "whole", ["root", "text"]).mapInArrow(run, "a long, b long"), "alike-within")


def chosen(rows: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """The rows whose number ``row`` is among those of ``wanted`` (one column of that name), without a shuffle of ``rows``.

    A bitmap of 32,768 numbers is one row of a table that goes to all tasks: a bit for each of the rows, 4 KB at least a file.
    """
    number, at = F.bitmap_bucket_number(F.col(row)), F.bitmap_bit_position(F.col(row))
    place, bits = free_name(rows, "_place"), free_name(rows, "_bits")
    found = written(wanted.groupBy(number.alias(place)).agg(F.bitmap_construct_agg(at).alias(bits)), "bits")
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn(place, number).join(F.broadcast(found), place)
    return placed.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).drop(place, bits)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``."""
    mark, row = free_name(docs, "_mark"), free_name(docs, "_row")
    marked = written(with_marks(docs.withColumn(row, F.monotonically_increasing_id()), mark, text_col), "marked")
    m = F.col(mark)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.col(row).alias("row"))).alias("first")
    columns = [first, F.min(m["fp"]).alias("fp"), F.min(m["n"]).alias("n"), *[F.min(m["keys"][k]).alias(f"key{k}") for k in range(2 * BANDS)]]
    classes = written(marked.groupBy(m["cls"].alias("cls")).agg(*columns), "classes")
    sized = classes.where("n > 0")

    def texts_of(shown: DataFrame) -> DataFrame:
        wanted = classes.join(shown, "cls", "left_semi").select(F.col("first.row").alias(row))
        return chosen(marked.select(m["cls"].alias("cls"), F.col(text_col).alias("text"), row), row, wanted).select("cls", "text")

    pairs = candidates(sized)
    shown = alike(pairs, texts_of(pairs.select("cls").unionByName(pairs.select(F.col("centre").alias("cls"))).distinct()), least)
    groups = written(simhash.components(shown), "groups")
    prefixes = shared_prefixes(marked.where(m["n"] > 0), m["cls"], F.col(text_col), least)
    links = crossing(prefixes, groups, least).select(F.col("cls").alias("a"), F.col("centre").alias("b"))
    sets = simhash.components(links)
    sets = sets.select(F.col("node").alias("cls"), F.col("root").alias("whole")).unionByName(sets.select(F.col("root").alias("cls"), F.col("root").alias("whole")).distinct())
    known = sets.join(groups, sets["cls"] == groups["node"], "left").select("cls", "whole", F.coalesce("root", "cls").alias("root"))
    members = written(known.join(classes.select("cls", "n"), "cls"), "members")
    roots = simhash.components(shown.unionByName(alike_within(members, texts_of(members.select("cls")), least)))
    grouped = classes.join(roots, classes["cls"] == roots["node"], "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("first").alias("first"))
    kept = grouped.select(F.col("first.row").alias(row))
    return marked.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
