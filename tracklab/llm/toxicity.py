"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a draw from all documents of the training fold, confirmed or not, is the
unlabelled set. A logistic model over presence features is fitted in numpy with the risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``: where the bracket falls below zero on a batch, the step goes the other
way, so the model cannot gain by calling unlabelled toxic text clean. The class prior is the toxic share of the labelled rows.

Features are hashes of the distinct words of the whole text and of their beginnings (3 to 8 bytes); those kept stand in a
fair share of the positives and in significantly more of them than of the unlabelled rows, so that chance words of a small
draw teach nothing.

The fit uses at most ``POSITIVES`` + ``UNLABELLED`` documents, drawn by a hash of the id; every document is scored.

Defined results: a null or empty text has no features and gets the score of the bias; without positives every score is 0;
repeated rows get equal scores; labels without a document, null labels and null ids teach nothing; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab.llm.common import held_out, with_struct

POSITIVES = 3000
UNLABELLED = 9000
FEATURES = 1024
#: Least standard deviations between the share among positives and that among unlabelled rows.
LEAST_Z = 4.5
#: Least share of the positives that hold a feature, and least number of them.
LEAST_SHARE = 0.02
LEAST_DOCS = 3
_LETTER = re.compile(rb"[a-z\x80-\xff]")
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _LETTER.match(bytes([b])) else 0x20 for b in range(256))
_BEGINNINGS = range(3, 9)


def word_features(word: bytes) -> list[int]:
    """The word, marked by a blank at the end, and its beginnings, as 32-bit hashes."""
    return [zlib.crc32(word + b" "), *(zlib.crc32(word[:n]) for n in _BEGINNINGS if len(word) > n)]


def features(text: bytes | None) -> np.ndarray:
    words = set(text.translate(_TO_WORDS).split()) if text else ()
    return np.unique(np.array([f for w in words for f in word_features(w)], np.uint32))


def draw(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(text, positive) of the bounded training draw, outside the held-out fold. Ids only are sorted; texts are read by a broadcast of the drawn ids."""
    order = F.xxhash64("id", F.lit(8))
    known = labels.where(f"{label_col} = 1").select(F.col(id_col).alias("id")).where("id is not null").distinct()
    every = docs.select(F.col(id_col).alias("id")).where("id is not null")
    pos = known.where(~held_out("id")).orderBy(order, "id").limit(positives).select("id", F.lit(True).alias("positive"))
    unl = every.where(~held_out("id")).orderBy(order, "id").limit(unlabelled).distinct().select("id", F.lit(False).alias("positive"))
    chosen = pos.unionByName(unl)  # at most positives + unlabelled rows
    return docs.select(F.col(id_col).alias("id"), "text").join(F.broadcast(chosen), "id").select("text", "positive")


def prior(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> float:
    """Toxic share of the labelled rows of the training fold."""
    row = labels.where(~held_out(id_col)).agg(F.avg(F.when(F.col(label_col).isNotNull(), (F.col(label_col) == 1).cast("double")))).first()
    return float(row[0] or 0.0)


def featurise(chosen: DataFrame) -> DataFrame:
    """(features, positive): the hashed features of each drawn text as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["features", "positive"])

    return chosen.select("text", "positive").mapInArrow(run, "features binary, positive boolean")


def select_features(bags: list[np.ndarray], positive: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """Ascending features whose share among positives is large and stands at least ``LEAST_Z`` above that among the rest."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    none = np.zeros(0, np.uint32)
    kept, p = np.unique(np.concatenate([none, *(b for b, y in zip(bags, positive) if y)]), return_counts=True)
    often = p >= max(LEAST_DOCS, LEAST_SHARE * n_p)
    kept, p = kept[often], p[often]
    other, n = np.unique(np.concatenate([none, *(b for b, y in zip(bags, positive) if not y)]), return_counts=True)
    at = np.minimum(np.searchsorted(other, kept), max(0, other.size - 1))
    u = np.where(other[at] == kept, n[at], 0) if other.size else np.zeros(kept.size)
    share = (u + p) / (n_p + n_u)
    z = (p / n_p - u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-9)
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(kept[best[z[best] >= LEAST_Z]])


class Model:
    """A linear score over presence features."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self._memo: dict[bytes, tuple[int, ...]] = {}

    def score(self, text: bytes | None) -> float:
        present: set[int] = set()
        memo = self._memo
        if len(memo) > 200_000:
            memo.clear()
        for w in set(text.translate(_TO_WORDS).split()) if text else ():
            known = memo.get(w)
            if known is None:
                known = memo[w] = tuple(f for f in word_features(w) if f in self.weights)
            if known:
                present.update(known)
        z = self.bias + sum(self.weights[f] for f in sorted(present))
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, size: int, share: float, epochs: int = 150, batches: int = 8, rate: float = 0.03, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss; ``rows`` hold the feature numbers of each document."""
    rng = np.random.default_rng(8)
    share = min(max(share, 1e-4), 0.9)
    w, m, v, step = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), 0
    w[size] = np.log(share / (1 - share))
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    parts = max(1, min(batches, pos.size, unl.size))
    for _ in range(epochs):
        for ps, us in zip(np.array_split(rng.permutation(pos), parts), np.array_split(rng.permutation(unl), parts)):
            chosen = [rows[k] for k in (*ps, *us)]
            lens = np.fromiter(map(len, chosen), np.int64, len(chosen))
            at, row = np.concatenate([*chosen, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(lens.size), lens)
            z = np.bincount(row, w[at], lens.size) + w[size]
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            n_p = ps.size
            negative_risk = np.logaddexp(0, z[n_p:]).mean() - share * np.logaddexp(0, z[:n_p]).mean()
            g = np.zeros(lens.size)
            if negative_risk >= 0:
                g[:n_p] = share * (s[:n_p] - 1) / n_p - share * s[:n_p] / n_p
                g[n_p:] = s[n_p:] / us.size
            else:
                g[:n_p] = share * s[:n_p] / n_p
                g[n_p:] = -s[n_p:] / us.size
            grad = np.append(np.bincount(at, g[row], size), g.sum())
            grad[:size] += ridge * w[:size]
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:size], float(w[size])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    rows = featurise(draw(docs, labels, positives, unlabelled)).collect()
    rows.sort(key=lambda r: (not r.positive, bytes(r.features)))
    positive = np.array([r.positive for r in rows], bool)
    if not positive.any() or positive.all():
        return Model({}, -745.0)
    bags = [np.frombuffer(bytes(r.features), np.uint32) for r in rows]
    names = select_features(bags, positive)
    coded = [np.flatnonzero(np.isin(names, bag, assume_unique=True)) for bag in bags]
    w, bias = fit_nnpu(coded, positive, names.size, prior(labels))
    return Model(dict(zip(names.tolist(), w.tolist())), bias)


def with_score(docs: DataFrame, model: Model, name: str = "toxicity", text_col: str = "text") -> DataFrame:
    """Append a struct of one double, ``score``: the higher, the likelier toxic."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def work():
        own = Model(*sent.value)

        def apply(texts: pa.Array) -> pa.StructArray:
            return pa.StructArray.from_arrays([pa.array([own.score(t.as_py()) for t in texts.cast(pa.binary())], pa.float64())], names=["score"])

        return apply

    return with_struct(docs, [text_col], name, T.StructType([T.StructField("score", T.DoubleType())]), work)
