"""Target-distribution importance resampling over hashed n-grams, interned in open-addressed NumPy tables.

Words are runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased; features are all runs of one to
``ORDER`` words. A feature's bucket is the CRC32 of its bytes by ``BUCKETS``. Bucket counts over all documents and over the
target give every bucket a whole-number gain, a document weighs the sum of its features' gains, and the Gumbel trick turns weights
into a draw without replacement: the highest scores are kept.

Words of a slice of a batch are joined by single blanks, so that every feature is one stretch of bytes. Stretches are interned in
an open-addressed table: XXH64 keys, computed side by side for all stretches, linear probing, and a comparison of the bytes before an
occurrence takes a slot. A slot stores bucket and count; the counts go to one accumulator of ``BUCKETS`` numbers a
task, and with the occurrences' slots the gains are gathered and added up by document. A slice holds ``SLICE`` words, so a
table is bounded whatever the length of a text; a longer text is cut into pieces that overlap by ``ORDER`` - 1 words.

Only the bucket counts (``BUCKETS`` numbers) reach the driver. Ranks come from a range partitioning by score.

Defined results: a null or empty text, or one of marks only, has no features, weight 0, and is never drawn, as all texts under
``LEAST_WORDS`` words; a null id draws noise as the empty string and stands last among equal scores; repeated rows are each scored and may be
drawn together, equal ones in any order; an empty target gives gains against a uniform one; an empty table gives no rows; other
columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tracklab.llm.common import free_name, with_struct, written
from tracklab.llm.decontaminate import words_of
from tracklab.plans.segments import dense_index

ORDER = 3
BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 42
#: Words of a slice; a table holds at most ORDER times as many features.
SLICE = 1 << 15

WEIGHT = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])

#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _crc_table() -> np.ndarray:
    """Remainders of the 256 bytes by the CRC32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


class Stretches:
    """Stretches [start, end) of one byte string: their keys and comparisons, eight bytes at a time."""

    #: Longer ones are hashed and compared one by one.
    SHORT = 32

    def __init__(self, data: bytes, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.size = data, start, end - start
        held = np.frombuffer(data + bytes(8), np.uint8)
        self.lanes = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))
        self.keys = self._keys()

    def __len__(self) -> int:
        return self.start.size

    def bytes(self, k: int) -> bytes:
        return self.data[self.start[k] : self.start[k] + self.size[k]]

    def _keys(self, seed: int = 0) -> np.ndarray:
        """XXH64 of every stretch."""
        size, at = self.size, self.start.copy()
        h = np.uint64(seed) + _P5 + size.astype(np.uint64)
        short = size < self.SHORT
        for lane in range(3):
            on = np.flatnonzero(short & (size >= 8 * (lane + 1)))
            h[on] = _turn(h[on] ^ (_turn(self.lanes[at[on]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[on] += 8
        on = np.flatnonzero(short & (size % 8 >= 4))
        h[on] = _turn(h[on] ^ ((self.lanes[at[on]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[on] += 4
        for k in range(1, 4):
            on = np.flatnonzero(short & (size % 4 >= k))
            h[on] = _turn(h[on] ^ ((self.lanes[at[on]] & np.uint64(0xFF)) * _P5), 11) * _P1
            at[on] += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
        for k in np.flatnonzero(~short):
            h[k] = xxh64_intdigest(self.bytes(k), seed)
        return h

    def crc32(self, which: np.ndarray) -> np.ndarray:
        """CRC32 of the named stretches, a byte of all of them at a time; the longest come first, so that those still on lead."""
        order = np.argsort(-self.size[which], kind="stable")
        start, size = self.start[which][order], self.size[which][order]
        long = int(np.searchsorted(-size, -self.SHORT, "right"))
        c = np.full(size.size, 0xFFFFFFFF, np.uint32)
        for k in range(int(size[long]) if long < size.size else 0):
            on = slice(long, int(np.searchsorted(-size, -k, "left")))
            if k % 8 == 0:
                lane = self.lanes[start[on] + k]
            lane = lane[: on.stop - long]
            c[on] = _CRC[(c[on] ^ lane.astype(np.uint32)) & np.uint32(0xFF)] ^ (c[on] >> np.uint32(8))
            lane = lane >> np.uint64(8)
        out = np.empty_like(c)
        out[order] = ~c
        for k in order[:long]:
            out[k] = zlib.crc32(self.bytes(which[k]))
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether stretches ``a`` and ``b`` hold the same bytes, pair by pair."""
        same = (self.keys[a] == self.keys[b]) & (self.size[a] == self.size[b])
        for lane in range(self.SHORT // 8):
            rest = self.size[a] - 8 * lane
            on = np.flatnonzero(same & (rest > 0) & (self.size[a] < self.SHORT))
            if not on.size:
                break
            drop = np.uint64(8) * np.maximum(0, 8 - rest[on]).astype(np.uint64)
            unlike = self.lanes[self.start[a[on]] + 8 * lane] ^ self.lanes[self.start[b[on]] + 8 * lane]
            same[on] = (unlike << drop) == 0
        for k in np.flatnonzero(same & (self.size[a] >= self.SHORT) & (a != b)):
            same[k] = self.bytes(a[k]) == self.bytes(b[k])
        return same


class Interned:
    """Open-addressed table of the distinct stretches: slot of every occurrence, bucket and count of every slot."""

    def __init__(self, found: Stretches, buckets: int = BUCKETS):
        n = len(found)
        width = 1 << max(1, 2 * n - 1).bit_length()
        owner = np.full(width, -1, np.int64)
        slot = (found.keys & np.uint64(width - 1)).astype(np.int64)
        waiting = np.arange(n)
        while waiting.size:
            at = slot[waiting]
            free = owner[at] < 0
            owner[at[free]] = waiting[free]
            missed = ~found.equal(waiting, owner[at])
            waiting = waiting[missed]
            slot[waiting] = (slot[waiting] + 1) & (width - 1)
        taken = np.flatnonzero(owner >= 0)
        number = np.zeros(width, np.int64)
        number[taken] = np.arange(taken.size)
        self.slot = number[slot]
        self.count = np.bincount(self.slot, minlength=taken.size)
        self.bucket = (found.crc32(owner[taken]) % np.uint32(buckets)).astype(np.int64)


class Slice:
    """Words of several documents, or of a part of one, and the features that start in them."""

    def __init__(self, pieces: list[tuple[int, list[bytes], int]], order: int):
        """``pieces``: document, words, and the number of leading words at which features start."""
        data = b" ".join(chain.from_iterable(words for _, words, _ in pieces))
        ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20), len(data))
        starts = np.append(0, ends[:-1] + 1)
        length = np.array([len(words) for _, words, _ in pieces])
        upto = np.cumsum(length)
        piece = np.repeat(np.arange(length.size), length)
        within = np.arange(ends.size) - (upto - length)[piece]
        opens = within < np.array([n for *_, n in pieces])[piece]
        first, last = [], []
        for n in range(order):
            k = np.flatnonzero(opens & (within + n < length[piece]))
            first.append(k)
            last.append(k + n)
        first, last = np.concatenate(first), np.concatenate(last)
        self.docs = np.array([d for d, *_ in pieces])[piece[first]]
        self.found = Stretches(data, starts[first], ends[last])


def slices(texts: pa.Array, order: int = ORDER, size: int = SLICE) -> Iterator[tuple[Slice, dict[int, int]]]:
    """Slices of a batch with the word counts of the documents that end in them."""
    pieces, held, ended = [], 0, {}
    for d, text in enumerate(texts.cast(pa.binary())):
        words = words_of(text.as_py())
        ended[d] = len(words)
        for lo in range(0, len(words), size):
            piece = words[lo : lo + size + order - 1]
            if held and held + len(piece) > size:
                yield Slice(pieces, order), {}
                pieces, held = [], 0
            pieces.append((d, piece, min(size, len(words) - lo)))
            held += len(piece)
    yield Slice(pieces, order) if pieces else None, ended


def bucket_counts(docs: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, size: int = SLICE) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends one row for each bucket it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part, _ in slices(batch.column(0), order, size):
                if part is not None:
                    table = Interned(part.found, buckets)
                    np.add.at(total, table.bucket, table.count)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, size: int = SLICE) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of every bucket in the target over that in the documents."""
    own = bucket_counts(docs, text_col, order, buckets, size).select("bucket", F.lit(False).alias("wanted"), "n")
    all_counts = own.unionByName(bucket_counts(target, target_col, order, buckets, size).select("bucket", F.lit(True).alias("wanted"), "n"))
    counts = np.zeros((2, buckets))
    for row in all_counts.collect():
        counts[int(row.wanted), row.bucket] = row.n
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def with_weight(docs: DataFrame, gain: np.ndarray, name: str = "sample", text_col: str = "text", order: int = ORDER, size: int = SLICE) -> DataFrame:
    """Append a struct: words, features, and the sum of the features' gains."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def work():
        own = sent.value

        def apply(texts: pa.Array) -> pa.StructArray:
            features, weight, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for part, ended in slices(texts, order, size):
                for d, n in ended.items():
                    words[d] = n
                if part is not None:
                    table = Interned(part.found, own.size)
                    np.add.at(weight, part.docs, own[table.bucket][table.slot])
                    np.add.at(features, part.docs, 1)
            return pa.StructArray.from_arrays([pa.array(x) for x in (words, features, weight)], names=WEIGHT.names)

        return apply

    return with_struct(docs, [text_col], name, WEIGHT, work)


def gumbel(id_col: str | Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), with u from the first 8 hex digits of the SHA-256 of ``seed:id``."""
    name = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = SEED, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    gain = gains(docs, target, text_col, target_col, order, buckets)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    name = free_name(base, "sample")
    own = with_weight(base, gain, name, "text", order).select("doc_id", f"{name}.*")
    scored = written(own.withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    # Ascending order with nulls last: the id's own null flag stands before it.
    placed = able.withColumns({"_down": -F.col("score"), "_no_id": F.col("doc_id").isNull()})
    placed = dense_index(placed, [], ["_down", "_no_id", "doc_id", "n_features", "weight"], "_place").drop("_down", "_no_id")
    ranked = placed.withColumn("rank", F.when(F.col("_place") < drawn, F.col("_place") + 1)).drop("_place")
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others)


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns and their rank, ``draw_rank``. Rows that repeat an id come together, under its best rank."""
    rank, key = free_name(docs, "draw_rank"), free_name(docs, "_drawn_id")
    ranks = resample(docs, target, percent, id_col=id_col, **options).where("rank is not null").groupBy(F.col("doc_id").alias(key)).agg(F.min("rank").alias(rank))
    return docs.join(ranks, F.col(id_col).eqNullSafe(F.col(key))).drop(key)
