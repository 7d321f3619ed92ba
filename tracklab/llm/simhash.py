"""SimHash near-duplicates found by anchor-point covering.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most 1 bit in one half. Each half of 32 bits is
covered by anchors: the words of the perfect Hamming code on 31 bits, with the last bit free, so that every half lies
within radius 1 of one anchor, its home. If two halves differ in at most 1 bit, the second lies within 2 (radius plus
threshold) of the home of the first. Every fingerprint goes to its home and, as a visitor, to all anchors within 2: 17 per
half. Homes are compared with visitors per anchor, so no linked pair is lost.

Equal fingerprints are merged first. An anchor's homes and visitors are dealt into tiles of bounded size; a tile returns the
parts it connects (at most one row per fingerprint), never its pairs. Parts are joined by alternating star contraction.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other; fewer words than
a shingle are one shingle; repeated rows share a fingerprint and a component; a null id never names a component unless all
ids of the component are null; an empty table gives no rows; other columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab.llm.common import cut_lineage, free_name, with_struct, written

SHINGLE = 3
SEED = 42
THRESHOLD = 3
#: Homes and visitors of one tile.
TILE = 4096


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it. Summed in slices, so a long text needs no more memory."""
    total = np.zeros(64, np.int64)
    for k in range(0, hashes.size, 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > hashes.size, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, name: str = "fp", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Append a struct of one signed 64-bit number, ``value``."""

    def work():
        def apply(texts: pa.Array) -> pa.StructArray:
            found = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in texts.cast(pa.binary())]
            return pa.StructArray.from_arrays([pa.array(found, pa.int64())], names=["value"])

        return apply

    return with_struct(docs, [text_col], name, T.StructType([T.StructField("value", T.LongType())]), work)


def _parity_checks() -> np.ndarray:
    """Bit k (1 to 31) of a half has syndrome k: a mask of the bits for each of the five checks."""
    return np.array([sum(1 << (k - 1) for k in range(1, 32) if k >> j & 1) for j in range(5)], np.uint32)


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchors, which halves are no code word, the anchors two flips away from each of those).

    Bit 31 is free and belongs to the anchor, so the home with that bit flipped is within reach too.
    """
    syndrome = np.zeros(halves.size, np.int64)
    for j, mask in enumerate(_parity_checks()):
        syndrome |= (np.bitwise_count(halves & mask).astype(np.int64) & 1) << j
    flip = np.concatenate([[0], 1 << np.arange(31)]).astype(np.uint32)
    home = halves ^ flip[syndrome]
    # Two flips reach a code word if their syndromes add up to that of the half; a code word has no other within 2.
    pairs = np.array([[(k, k ^ s) for k in range(1, 32) if k < k ^ s] for s in range(1, 32)], np.int64)
    off = syndrome > 0
    chosen = pairs[syndrome[off] - 1]
    two = halves[off][:, None] ^ flip[chosen[:, :, 0]] ^ flip[chosen[:, :, 1]]
    return home, off, two


def replicate(fingerprints: DataFrame) -> DataFrame:
    """(half, anchor, fp, home): one row for each anchor within reach of each distinct fingerprint ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for lo in range(0, signed.size, 1 << 14):
                fp = signed[lo : lo + (1 << 14)]
                for half in (0, 1):
                    part = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
                    home, off, two = anchors(part)
                    anchor = np.concatenate([home, home ^ np.uint32(1 << 31), two.ravel()]).astype(np.int64)
                    who = np.concatenate([fp, fp, np.repeat(fp[off], two.shape[1])])
                    own = np.zeros(anchor.size, bool)
                    own[: fp.size] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(anchor.size, half, np.int8)), pa.array(anchor), pa.array(who), pa.array(own)], names=["half", "anchor", "fp", "home"]
                    )

    return fingerprints.select("fp").mapInArrow(run, "half byte, anchor long, fp long, home boolean")


def parts(homes: np.ndarray, visitors: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint of its part in this tile), for those linked to another one."""
    linked = np.bitwise_count(homes.view(np.uint64)[:, None] ^ visitors.view(np.uint64)[None, :]) <= threshold
    h, v = linked.any(axis=1), linked.any(axis=0)
    linked, homes, visitors = linked[np.ix_(h, v)], homes[h], visitors[v]
    if not homes.size:
        return homes, homes
    top, low = homes.copy(), visitors.copy()
    far = np.int64(np.iinfo(np.int64).max)
    while True:
        low = np.minimum(low, np.where(linked, top[:, None], far).min(axis=0))
        new = np.minimum(top, np.where(linked, low[None, :], far).min(axis=1))
        if np.array_equal(new, top):
            break
        top = new
    who, root = np.concatenate([homes, visitors]), np.concatenate([top, low])
    keep = who != root
    return who[keep], root[keep]


def links(fingerprints: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints which chains of close pairs connect; not every close pair."""
    replicas = written(replicate(fingerprints), "replicas")
    crowd = replicas.groupBy("half", "anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).where("n > 1 and h > 0")
    # A home stands among its anchor's visitors too. Hash tiles bound both sides of a crowded anchor.
    crowd = crowd.select("half", "anchor", F.ceil(F.col("h") / tile).cast("int").alias("rows"), F.ceil(F.col("n") / tile).cast("int").alias("cols"))
    placed = replicas.join(crowd, ["half", "anchor"])
    row, col = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("rows")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(2)), F.col("cols")).cast("int")
    as_home = placed.where("home").select("half", "anchor", row.alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"), "fp", F.lit(True).alias("home"))
    as_visitor = placed.select("half", "anchor", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), col.alias("c"), "fp", F.lit(False).alias("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, visitors, now = [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            h, v = np.concatenate(homes or [np.zeros(0, np.int64)]), np.concatenate(visitors or [np.zeros(0, np.int64)])
            for x in range(0, h.size, tile):
                for y in range(0, v.size, tile):
                    a, b = parts(h[x : x + tile], v[y : y + tile], threshold)
                    if a.size:
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            fp, home = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, fp.size]):
                if hi == lo:
                    continue
                this = tuple(key[:, lo])
                if this != now:
                    yield from flush()
                    homes, visitors, now = [], [], this
                own = home[lo:hi]
                homes.append(fp[lo:hi][own])
                visitors.append(fp[lo:hi][~own])
        yield from flush()

    keys = ["half", "anchor", "r", "c"]
    return as_home.unionByName(as_visitor).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b), by alternating star contraction."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(limit):
        # Large star: larger neighbours of a node go to its smallest neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself go to the smallest one.
        lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id, root, text_key): the fingerprint and the smallest document id that chains of links reach.

    ``root`` names the component also where ids collide; ``text_key`` is a 64-bit hash of the text.
    """
    if threshold > 3:
        raise ValueError("the halves are covered for thresholds up to 3")
    name = free_name(docs, "fp")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    text_key = F.xxhash64("text").alias("text_key")
    marked = written(with_fingerprint(base, name, "text", shingle).select("doc_id", F.col(f"{name}.value").alias("fp"), text_key), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(distinct, threshold))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(joined.select("fp", "root").join(named, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "component_id", "root", "text_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component: the smallest id and, where unlike rows share it, the smallest hash of the text.

    Rows of one id and text are one row. Texts of one id that are not linked all stay; rows without an id stay, one for each text.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    key, text_key = free_name(docs, "_key"), free_name(docs, "_text_key")
    none = F.lit(-(1 << 63))
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    firsts = found.where("doc_id is not null").groupBy("root").agg(first).select(F.col("first.doc_id").alias(key), F.col("first.text_key").alias(text_key))
    lone = found.where("doc_id is null").select(none.alias(key), F.col("text_key").alias(text_key))
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), none), text_key: F.xxhash64(text_col)})
    kept = keyed.join(firsts.unionByName(lone).distinct(), [key, text_key], "left_semi")
    return kept.dropDuplicates([key, text_key]).drop(key, text_key)
