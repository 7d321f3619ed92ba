"""Token ids on disk: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

File format (a folder): ``code`` holds one row per used id with its code length; ``blocks`` holds one row per block in
ascending document order. A block carries whole documents: their ids, token counts, the bit offset of every
``CHECKPOINT`` tokens, and the bits. Documents start on a 32-bit word, so every block and every checkpoint can be decoded
alone. Shards are ranges of document ids; ``before`` is the number of tokens of the shard in front of the block.

Defined results: a null or empty text is the end id alone; a null document id comes first; repeated rows are all written,
next to each other; an empty table gives empty ``code`` and ``blocks``; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklab.llm.common import new_path, ordered_bucket, quantile_bounds, shuffle_width, written

CHECKPOINT = 512
BLOCK_TOKENS = 1 << 18
COUNT_TASKS = 64
MAX_BITS = 16
#: Entries of a worker's memos of encoded pieces: those met again, and those met once so far. A memo is emptied when full.
MEMO_ENTRIES = 200_000
NEW_ENTRIES = 200_000
#: Documents that are encoded between two results, so that a task never holds the ids of many long texts.
DOCS_AT_ONCE = 512
#: ASCII marks that the byte-level pattern always splits from a letter before them (the apostrophe is not one).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space that pieces cannot be cut at: any but blanks and line ends.
OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")

_encoders: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Whole-text encoding by the tokenizers library, remembering the ids of pieces between single blanks.

    A byte-level vocabulary never joins text across a single blank or line end between two words, so the ids of a text
    are the ids of its pieces in order. A text with a special token, or with white space that is not a single blank or
    line end between two words, is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: Each look-up of the model makes a new object, so its method is kept.
        self.units = self.whole.model.tokenize
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.unlike = (*self.special, *OTHER_SPACE)
        self.byte_letters = _byte_letters()
        self.code = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        #: Ids of a word with the blank before it, or of a line end and the word after it; words met once wait in ``new``.
        self.memo: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        #: Ids of trailing marks.
        self.tails: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str, blank: bool) -> bytes:
        """Ids of a word of letters only, which is one unit of the vocabulary's merges."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_letters)
        units = self.units(self.byte_letters[0x20] + shown if blank else shown)
        return array(self.code, [u.id for u in units]).tobytes()

    def _piece(self, piece: str, blank: bool = True) -> bytes:
        if piece[0] == "\n":
            return self._tail("\n") + self._piece(piece[1:], False)
        core = piece.rstrip(MARKS)
        if not core.isalpha():
            if not core or not core[-1].isalnum():
                return self._plain(" " + piece if blank else piece)
            ids = self._plain(" " + core if blank else core)
        elif len(core) == len(piece) or not blank:
            ids = self._letters(core, blank)
        else:
            ids = self.memo.get(core) or self._remember(core)
        return ids + self._tail(piece[len(core) :]) if len(core) < len(piece) else ids

    def _remember(self, piece: str) -> bytes:
        """Ids of a piece that is not in the memo; met for the second time, it goes there."""
        ids = self.new.pop(piece, None)
        if ids is not None:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[piece] = ids
            return ids
        ids = self._piece(piece)
        if len(self.new) >= NEW_ENTRIES:
            self.new.clear()
        self.new[piece] = ids
        return ids

    def _tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            if len(self.tails) >= NEW_ENTRIES:
                self.tails.clear()
            ids = self.tails[marks] = self._plain(marks)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as unsigned numbers of 16 bits, or 32 for a vocabulary of more than 65,536 ids."""
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any(s in text for s in self.unlike):
            return self._plain(text)
        pieces = text.replace("\n", " \n").split(" ")
        memo = self.memo
        found = list(map(memo.get, pieces))
        found[0] = self._piece(pieces[0], False)
        found.append(None)
        k = found.index(None)
        while k < len(pieces):
            piece = pieces[k]
            # Two blanks or line ends in a row leave one of these, which no memo holds.
            if piece == "" or piece == "\n":
                return self._plain(text)
            ids = memo.get(piece)
            found[k] = self._remember(piece) if ids is None else ids
            k = found.index(None, k + 1)
        found.pop()
        return b"".join(found)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def release() -> None:
    """Forget the encoders of this process; a worker lives on after its last text and would keep them beside those of other steps."""
    _encoders.clear()


def id_type(vocabulary: str) -> np.dtype:
    return np.dtype(encoder(vocabulary).code)


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, counts): a row for each document with its ids and the end id, and a last row for each task with the
    number of times that it has written each id. The other of ``ids`` and ``counts`` is null."""
    names = ["doc_id", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end, kind = array(own.code, [end_id]).tobytes(), np.dtype(own.code)
        total = np.zeros(0, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(lo, DOCS_AT_ONCE)
                ids = [own.encode(t.as_py() or "") + end for t in part.column(1)]
                seen = np.bincount(np.frombuffer(b"".join(ids), kind), minlength=total.size)
                seen[: total.size] += total
                total = seen
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        if total.size:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def count_ids(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the tasks' own counts. They are added up in a bounded number of tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen = np.frombuffer(x.as_py(), np.int64)
                short, long = sorted((seen, total), key=len)
                total = long.copy()
                total[: short.size] += short
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    own = encoded.where("counts is not null").select("counts").coalesce(COUNT_TASKS)
    return own.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``limit`` (package-merge), for counts above zero."""
    n = counts.size
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("limit too small for the number of symbols")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order]
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[: merged.size // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: sorted by length, then by id; the decoding table is indexed by the next ``bits`` bits."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths.max()) if self.lengths.size else 1
        width = np.left_shift(np.int64(1), self.bits - self.lengths)
        self.codes = (np.cumsum(width) - width) >> (self.bits - self.lengths)

    def encode_tables(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.symbols.max()) + 1 if self.symbols.size else 1
        code, length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.symbols], length[self.symbols] = self.codes, self.lengths
        return code, length

    def decode_tables(self) -> tuple[np.ndarray, np.ndarray]:
        width = np.left_shift(np.int64(1), self.bits - self.lengths)
        pad = (1 << self.bits) - int(width.sum())
        return np.append(np.repeat(self.symbols, width), np.zeros(pad, np.int64)).astype(np.uint32), np.append(np.repeat(self.lengths, width), np.ones(pad, np.int64))


def pack(flat: np.ndarray, sizes: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of several documents, each from a word boundary: (words as bytes, first word of each and the end, token bit offsets, token starts)."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bits = length[flat]
    ends = np.concatenate([[0], np.cumsum(bits)])
    words = (ends[starts[1:]] - ends[starts[:-1]] + 31) >> 5
    first = np.concatenate([[0], np.cumsum(words)])
    at = ends[:-1] + np.repeat(first[:-1] * 32 - ends[starts[:-1]], sizes)
    value = code[flat] << (64 - (at & 31) - bits).astype(np.uint64)
    word, n = at >> 5, int(first[-1]) + 2
    total = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    total += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return total[: first[-1]].astype(">u4").tobytes(), first, at, starts


def pack_documents(encoded: DataFrame, own: Code, kind: np.dtype) -> DataFrame:
    """(doc_id, n_tokens, marks, bits): each document's bits and the bit offset of every ``CHECKPOINT`` tokens."""
    code, length = own.encode_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(lo, DOCS_AT_ONCE)
                ids = part.column(1).to_pylist()
                sizes = np.array([len(x) // kind.itemsize for x in ids], np.int64)
                data, first, at, starts = pack(np.frombuffer(b"".join(ids), kind), sizes, code, length)
                marks = [(at[a:b:CHECKPOINT] - 32 * w).tolist() for a, b, w in zip(starts[:-1], starts[1:], first)]
                bits = [data[4 * a : 4 * b] for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    names=["doc_id", "n_tokens", "marks", "bits"],
                )

    return encoded.where("ids is not null").select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, marks array<long>, bits binary")


BLOCKS = "shard int, block int, before long, doc_ids array<long>, n_tokens array<long>, marks array<long>, bits binary"


def gather_blocks(packed: DataFrame, bounds: list[int]) -> DataFrame:
    """Group documents in ascending id into blocks of about ``BLOCK_TOKENS``; one shuffle of packed bits by id range."""
    names = BLOCKS.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, held = None, 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held
            shift, marks = 0, []
            for _, _, m, bits in held:
                marks.extend(shift + x for x in m)
                shift += 8 * len(bits)
            sizes = [h[1] for h in held]
            row = [shard, block, before, [h[0] for h in held], sizes, marks, b"".join(h[3] for h in held)]
            block, before, held = block + 1, before + sum(sizes), []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        size = 0
        for batch in batches:
            for k, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (k != shard or size >= BLOCK_TOKENS):
                    yield flush()
                    size = 0
                if k != shard:
                    shard, block, before = k, 0, 0
                held.append(row)
                size += row[1]
        if held:
            yield flush()

    ranged = packed.select(ordered_bucket(F.col("doc_id"), bounds).cast("int").alias("shard"), "doc_id", "n_tokens", "marks", "bits")
    return ranged.repartition("shard").sortWithinPartitions("shard", "doc_id", "bits").mapInArrow(run, BLOCKS)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them to ``path`` in ascending document id."""
    spark = docs.sparkSession
    encoded = written(encode_documents(docs, vocabulary, end_id, id_col, text_col), "ids")
    counts = np.array([(r.id, r.n) for r in count_ids(encoded).collect()], np.int64).reshape(-1, 2)
    counts = counts[np.argsort(counts[:, 0])]
    limit = max(MAX_BITS, int(counts.shape[0]).bit_length())
    lengths = code_lengths(counts[:, 1], limit)
    table = pa.table({"id": pa.array(counts[:, 0], pa.int64()), "length": pa.array(lengths, pa.int64())})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/code")
    packed = pack_documents(encoded, Code(counts[:, 0], lengths), id_type(vocabulary))
    gather_blocks(packed, quantile_bounds(encoded.where("ids is not null"), "doc_id", 2 * shuffle_width(spark))).write.option("compression", "none").parquet(f"{path}/blocks")


def unpack(data: np.ndarray, at: np.ndarray, size: np.ndarray, table: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    """Decode segments side by side: step k decodes the k-th id of every segment that has one."""
    symbol, length = table
    window = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    order = np.argsort(-size, kind="stable")
    at, live = at[order].copy(), size[order]
    first = np.concatenate([[0], np.cumsum(size)])[:-1][order]
    out = np.empty(int(size.sum()), np.uint32)
    left = live.size
    for k in range(int(live[0]) if live.size else 0):
        while live[left - 1] <= k:
            left -= 1
        p = at[:left]
        key = (window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        out[first[:left] + k] = symbol[key]
        p += length[key]
    return out


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) decoded from the files; ``start`` counts the ids of all documents before.

    Ids are little-endian unsigned 32-bit numbers; with ``digest`` their crc32 is returned instead, as ``ids_crc32``.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    code = spark.read.parquet(f"{path}/code").collect()
    own = Code(np.array([r.id for r in code], np.int64), np.array([r.length for r in code], np.int64))
    if own.bits > 25:
        raise ValueError("codes of more than 25 bits")
    last = "ids_crc32" if digest else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = own.decode_tables()
        for batch in batches:
            for k in range(batch.num_rows):
                shard, before, doc_ids, sizes, marks, bits = (c[k].as_py() for c in batch.columns)
                n = np.array(sizes, np.int64)
                per = -(-n // CHECKPOINT)
                size = np.full(int(per.sum()), CHECKPOINT, np.int64)
                size[np.cumsum(per) - 1] = n - CHECKPOINT * (per - 1)
                flat = unpack(np.frombuffer(bits + b"\0\0\0\0", np.uint8), np.array(marks, np.int64), size, table, own.bits).astype("<u4")
                ends = np.cumsum(n)
                parts = (flat[b - m : b] for b, m in zip(ends, n))
                made = pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array([x.tobytes() for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(sizes), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(before + ends - n, pa.int64()), pa.array(n), made],
                    names=["shard", "doc_id", "within", "n_tokens", last],
                )

    schema = f"shard int, doc_id long, within long, n_tokens long, {last} {'long' if digest else 'binary'}"
    decoded = blocks.select("shard", "before", "doc_ids", "n_tokens", "marks", "bits").mapInArrow(run, schema)
    # One total per shard: the shards are a fixed multiple of the shuffle partitions, so this stays on the driver's side.
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")).orderBy("shard").collect()
    offsets, run_total = {}, 0
    for r in totals:
        offsets[r.shard] = run_total
        run_total += r.n
    rows = spark.createDataFrame(pa.table({"shard": pa.array(list(offsets), pa.int32()), "offset": pa.array(list(offsets.values()), pa.int64())}))
    return decoded.join(F.broadcast(rows), "shard").select("doc_id", (F.col("within") + F.col("offset")).alias("start"), "n_tokens", last)


def token_digest(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the texts, read them back: (doc_id, start, n_tokens, ids_crc32) from the files."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(spark, path, digest=True)
