"""Fill-in-middle transformation over a Roaring-style set of the places where a text may be cut.

The boundaries of a text are the byte offsets of its UTF-8 form at which a unit (code point, word or line) starts, and its
end. The set keeps them by the upper 16 bits of the offset in containers of three kinds, whichever is smallest: a sorted
array, a bitmap, or runs; cumulative cardinalities stand beside them. The k-th boundary is found by a search over the
cumulative cardinalities and a select inside one container. Two selects give both cuts.

A hash of the document id draws the number of units in front of each cut, whether the text stays plain, and the order of
the parts. A text that holds one of the three marks stays plain, so that the marks of an output are the only ones
and the text can be rebuilt from output and form.

Defined results: a null or empty text is plain, with zero units and an empty output; a null id draws as the empty string;
repeated rows are treated alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab.llm.common import free_name, with_struct

#: Marks in front of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Per cent of texts to transform, and of those the per cent written suffix first.
RATE, SUFFIX_FIRST = 90, 20
ARRAY, BITMAP, RUNS = range(3)
_CHUNK = 1 << 16

CUT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_units", T.LongType()),
        T.StructField("middle_units", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


class Container:
    """Sorted 16-bit numbers as an array, a bitmap or runs (first, length), whichever needs the fewest bytes."""

    def __init__(self, low: np.ndarray):
        breaks = np.flatnonzero(np.diff(low) != 1) + 1
        sizes = {ARRAY: 2 * low.size, BITMAP: _CHUNK // 8, RUNS: 4 * (breaks.size + 1)}
        self.kind = min(sizes, key=lambda k: (sizes[k], -k))
        if self.kind == ARRAY:
            self.data = low.astype(np.uint16)
        elif self.kind == BITMAP:
            bits = np.zeros(_CHUNK, np.uint8)
            bits[low] = 1
            self.data = np.packbits(bits, bitorder="little").view("<u8")
            self.upto = np.cumsum(np.bitwise_count(self.data), dtype=np.int64)
        else:
            first = np.concatenate([[0], breaks])
            length = np.diff(np.concatenate([first, [low.size]]))
            self.data = np.stack([low[first], length])
            self.upto = np.cumsum(length)

    def select(self, k: int) -> int:
        """The k-th number, from 0."""
        if self.kind == ARRAY:
            return int(self.data[k])
        at = int(np.searchsorted(self.upto, k, "right"))
        before = int(self.upto[at - 1]) if at else 0
        if self.kind == RUNS:
            return int(self.data[0, at]) + k - before
        word = self.data[at : at + 1].view(np.uint8)
        return 64 * at + int(np.flatnonzero(np.unpackbits(word, bitorder="little"))[k - before])


class BoundarySet:
    """A set of ascending offsets with select."""

    def __init__(self, offsets: np.ndarray):
        keys, first = np.unique(offsets >> 16, return_index=True)
        ends = np.append(first[1:], offsets.size)
        self.keys = keys
        self.containers = [Container(offsets[a:b] & (_CHUNK - 1)) for a, b in zip(first, ends)]
        self.upto = np.asarray(ends)

    def __len__(self) -> int:
        return int(self.upto[-1]) if self.upto.size else 0

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, "right"))
        before = int(self.upto[at - 1]) if at else 0
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - before)


def boundaries(text: bytes, unit: str = "char") -> BoundarySet:
    """Where units start, and the end of the text: ``n`` units have ``n`` + 1 boundaries.

    A word is a run of characters other than ASCII white space with the white space before it (and, for the last, after it);
    a line ends behind its line feed.
    """
    data = np.frombuffer(text, np.uint8)
    if unit == "char":
        starts = (data & 0xC0) != 0x80
    elif unit == "line":
        starts = np.append(np.ones(min(1, data.size), bool), data[:-1] == 0x0A)
    elif unit == "word":
        blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        ends = ~blank[:-1] & blank[1:]
        after = np.flatnonzero(ends) + 1
        last = data.size - int(np.argmin(blank[::-1])) if (~blank).any() else 0
        starts = np.zeros(data.size, bool)
        starts[:1] = True
        starts[after[after < last]] = True
    else:
        raise ValueError(unit)
    return BoundarySet(np.append(np.flatnonzero(starts), data.size))


def draws(id_col: str | Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers from the first 32 hex digits of the SHA-256 of ``seed:id``."""
    name = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut(text: str, h: Sequence[int], unit: str = "char", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: Sequence[str] = MARKS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, units of the prefix, units of the middle, output)."""
    data = text.encode()
    places = boundaries(data, unit)
    n = len(places) - 1
    if not data or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = places.select(low), places.select(high)
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    if h[3] % 100 < suffix_first:
        return n, "spm", low, high - low, f"{marks[1]}{suffix}{marks[0]}{prefix}{marks[2]}{middle}"
    return n, "psm", low, high - low, f"{marks[0]}{prefix}{marks[1]}{suffix}{marks[2]}{middle}"


def with_cut(docs: DataFrame, name: str = "fim", text_col: str = "text", id_col: str = "doc_id", seed: int = SEED, **options) -> DataFrame:
    """Append a struct: number of units, form, units of prefix and middle (null if plain), and the output text."""
    drawn = [free_name(docs, f"_h{k}") for k in range(4)]

    def work():
        def apply(texts: pa.Array, *h: pa.Array) -> pa.StructArray:
            made = [cut(t or "", row, **options) for t, *row in zip(texts.to_pylist(), *[x.to_pylist() for x in h])]
            columns = list(zip(*made)) or [()] * len(CUT)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=CUT.names)

        return apply

    return with_struct(docs.withColumns(dict(zip(drawn, draws(id_col, seed)))), [text_col, *drawn], name, CUT, work).drop(*drawn)


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output was made of."""
    first, second, third = (re.escape(m) for m in marks)
    psm = F.regexp_replace(output, rf"(?s)\A{first}(.*?){second}(.*?){third}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{second}(.*?){first}(.*?){third}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
