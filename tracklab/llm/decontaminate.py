"""Benchmark decontamination: a generalised suffix automaton of the test items, along which training words are streamed.

Words are runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased. The automaton gives at every
word the longest item passage that ends there. A window is ``window`` consecutive words of an item, or a whole shorter
item; a word inside an occurring window is hit. Spans of hit words are cut when they exceed ``max_span`` words, and a
document goes when its hit share reaches ``max_coverage``.

Words of no item put the automaton back to its start, so only runs of known words that are long enough for a window are
walked; the result is the same.

Items are taken in shards of at most ``SHARD_WORDS`` words, each with its own automaton; documents pass through the
automata one after another in one job. Shards bound the size of one automaton, not the memory: the driver holds all item
texts and a task the automata of all shards, so the whole benchmark has to fit both.

Defined results: a null or empty text, or one of marks only, has no words and no hits; an item without words has no
windows; items without an id are ignored; repeated items and rows are judged alike; an empty benchmark hits nothing;
other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab.llm.common import free_name, with_struct

WINDOW = 13
SHARD_WORDS = 200_000
_LETTERS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of words stay (lower-cased), all others become blanks.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _LETTERS.fullmatch(bytes([b])) else 0x20 for b in range(256))

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the windows that each state stands for."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]) for name, text in items]
        coded = [(name, seq) for name, seq in coded if seq]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: state -> [(window length, items)], for the state that holds a whole window
        found: dict[int, dict[int, set[str]]] = {}
        for name, seq in coded:
            n, state = min(len(seq), window), 0
            for i, c in enumerate(seq):
                state = self.next[state][c]
                if i + 1 >= n:
                    found.setdefault(self._holder(state, n), {}).setdefault(n, set()).add(name)
        self.windows = {s: sorted((n, tuple(sorted(v))) for n, v in by.items()) for s, by in found.items()}
        self.least = min((n for by in self.windows.values() for n, _ in by), default=0)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new = self._state({}, self.size[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.size[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, edges: dict[int, int], size: int, link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _holder(self, state: int, n: int) -> int:
        """The state of the last n words of what has been read."""
        while self.size[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], int, set[str]]:
        """(hit spans as [first, end) words, longest passage of at least a window, items with an occurring window)."""
        spans: list[list[int]] = []
        items: set[str] = set()
        longest, least = 0, self.least
        if not least or len(words) < least:
            return spans, longest, items
        codes = np.fromiter(map(self.vocab.get, words, _UNKNOWN), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], codes >= 0, [False]]).astype(np.int8)))
        for a, b in edge.reshape(-1, 2):
            if b - a < least:
                continue
            state = n = 0
            for i, c in enumerate(codes[a:b].tolist(), a + 1):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    n = self.size[state]
                if c in self.next[state]:
                    state, n = self.next[state][c], n + 1
                if n >= least:
                    widest, s = 0, state
                    while s > 0 and self.size[s] >= least:
                        for k, names in self.windows.get(s, ()):
                            if k <= n:
                                widest = max(widest, k)
                                items.update(names)
                        s = self.link[s]
                    if widest:
                        longest = max(longest, n)
                        first = int(i - widest)
                        while spans and spans[-1][0] >= first:
                            spans.pop()
                        if spans and spans[-1][1] >= first:
                            spans[-1][1] = int(i)
                        else:
                            spans.append([first, int(i)])
        return spans, longest, items


class _Minus:
    """An endless default for ``map(dict.get, ...)``."""

    def __iter__(self) -> Iterator[int]:
        while True:
            yield -1


_UNKNOWN = _Minus()


def item_shards(items: DataFrame, id_col: str, text_col: str, shard_words: int = SHARD_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """Items in lists of bounded total length, read one partition at a time. An item longer than a shard stands alone."""
    held, size = [], 0
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("i is not null and t is not null")
    for row in rows.toLocalIterator():
        n = len(words_of(bytes(row.t)))
        if held and size + n > shard_words:
            yield held
            held, size = [], 0
        held.append((row.i, bytes(row.t)))
        size += n
    if held:
        yield held


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    name: str = "hits",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    max_span: int | None = None,
) -> DataFrame:
    """Append a struct: n_words, n_hit, longest passage, hit spans as [first, end) words, ids of items with occurring windows.

    With ``max_span`` the struct also has ``cut``: the text without longer spans (null if it has none). It is made in the
    pass of the last shard, as a pass of its own would keep a second Python worker for each core.
    """
    shards = list(item_shards(items, item_id, item_text, shard_words)) or [[]]
    for k, shard in enumerate(shards):
        earlier = [] if k == 0 else [name]
        cuts = max_span is not None and k + 1 == len(shards)
        sent = docs.sparkSession.sparkContext.broadcast(shard)

        def work(sent=sent, cuts=cuts):
            automaton = ItemAutomaton(sent.value, window)

            def apply(texts: pa.Array, before: pa.StructArray | None = None) -> pa.StructArray:
                out, held = [], before.to_pylist() if before is not None else None
                for n, text in enumerate(texts.cast(pa.binary())):
                    words = words_of(text.as_py())
                    spans, longest, found = automaton.scan(words)
                    if held is not None:
                        spans, longest = _merge(spans + held[n]["spans"]), max(longest, held[n]["longest"])
                        found = found | set(held[n]["items"])
                    hit = sum(b - a for a, b in spans)
                    out.append({"n_words": len(words), "n_hit": hit, "longest": longest, "spans": spans, "items": sorted(found)})
                    if cuts and any(b - a > max_span for a, b in spans):
                        out[-1]["cut"] = cut_spans(text.as_py().decode(), spans, max_span)
                kind = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]
                return pa.array(out, pa.struct([*kind, ("cut", pa.string())] if cuts else kind))

            return apply

        schema = T.StructType([*HITS.fields, T.StructField("cut", T.StringType())]) if cuts else HITS
        if earlier:
            step = free_name(docs, name + "_next")
            docs = with_struct(docs, [text_col, name], step, schema, work).drop(name).withColumnRenamed(step, name)
        else:
            docs = with_struct(docs, [text_col], name, schema, work)
    return docs


def cut_spans(text: str, spans: list[list[int]], max_span: int) -> str:
    """The text without the spans of more than ``max_span`` words, cut from the first to the last character of each."""
    data = text.encode()
    places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data)]
    kept, at = [], 0
    for a, b in spans:
        if b - a > max_span:
            kept.append(data[at : places[a][0]])
            at = places[b - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def contaminated(hits: str, max_coverage: float):
    share = F.col(f"{hits}.n_hit") >= F.lit(max_coverage) * F.col(f"{hits}.n_words")
    return (F.col(f"{hits}.n_hit") > 0) & share


def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = 0.05, max_span: int | None = None, text_col: str = "text", **options) -> DataFrame:
    """Documents below the coverage limit, with the columns of the input. With ``max_span``, longer hit spans are cut from the text."""
    name = free_name(docs, "hits")
    kept = find_hits(docs, items, name, text_col, max_span=max_span, **options).where(~contaminated(name, max_coverage))
    if max_span is not None:
        kept = kept.withColumn(text_col, F.coalesce(F.col(f"{name}.cut"), F.col(text_col)))
    return kept.drop(name)
