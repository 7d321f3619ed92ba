"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from its bytes and words (shares of character
classes, word lengths, repeated and distinct words), a small network turns the code into a hidden vector, gated attention
(tanh times sigmoid) weighs the passages, and the weighted sum is scored. All weights, the attention's included, are learned
together from document labels, in numpy by Adam.

The fit uses at most ``TRAIN_DOCS`` labelled documents, drawn by a hash of the id; every document is scored from all its
passages. Attention is accumulated over slices of passages, so a long text needs no more memory than a short one.

Defined results: a null or empty text is one passage of zeros and is scored like any other; without labels of both kinds the
score is the share of good labels, or 0.5 without any; repeated rows get equal scores; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab.llm.common import held_out, with_struct

PASSAGE = 64
TRAIN_DOCS = 6000
HIDDEN = 16
GATE = 12
#: Passages that are encoded at once.
SLICE = 4096

CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?;:", "|", "#$%&*@^~", "'\"`", "()[]{}<>", "-_/\\=+"]


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for k, chars in enumerate(CLASSES):
        table[list(chars.encode())] = k
    table[0x80:] = len(CLASSES) + 1
    return table


_CLASS = _class_table()
_KINDS = len(CLASSES) + 2
WIDTH = _KINDS + 5


def encode_passages(text: bytes | None) -> Iterator[np.ndarray]:
    """Codes of all passages in slices of at most ``SLICE`` rows."""
    words = text.split() if text else []
    if not words:
        yield np.zeros((1, WIDTH))
        return
    step = PASSAGE * SLICE
    for lo in range(0, len(words), step):
        part = words[lo : lo + step]
        yield _encode(part)


def _encode(words: list[bytes]) -> np.ndarray:
    n = len(words)
    passages = -(-n // PASSAGE)
    lens = np.fromiter(map(len, words), np.int64, n)
    owner = np.arange(n) // PASSAGE
    size = np.bincount(owner, lens, passages)
    data = np.frombuffer(b"".join(words), np.uint8)
    spread = np.repeat(owner * _KINDS, lens)
    shares = np.bincount(spread + _CLASS[data], minlength=passages * _KINDS).reshape(passages, _KINDS) / size[:, None]
    count = np.bincount(owner, minlength=passages)
    marks = np.fromiter(map(hash, words), np.int64, n)
    again = np.append(False, (marks[1:] == marks[:-1]) & (owner[1:] == owner[:-1]))
    order = np.lexsort((marks, owner))
    fresh = np.append(True, (np.diff(marks[order]) != 0) | (np.diff(owner[order]) != 0))
    return np.column_stack(
        [
            shares,
            size / count / 10,
            np.log1p(count) / 4,
            np.bincount(owner, again, passages) / count,
            np.bincount(owner[order], fresh, passages) / count,
            np.bincount(owner, lens == 1, passages) / count,
        ]
    )


class Network:
    """Gated-attention network over passage codes."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator, mean: np.ndarray, scale: np.ndarray) -> "Network":
        small = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        return cls({"mean": mean, "scale": scale, "W": small(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": small(HIDDEN, GATE), "U": small(HIDDEN, GATE), "a": small(GATE), "c": small(HIDDEN), "d": np.zeros(1)})

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = self.w
        h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        return h, t, g, (t * g) @ w["a"]

    def score(self, text: bytes | None) -> float:
        """Softmax over all passages, kept as a running maximum, weight and weighted sum."""
        top, weight, total = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in encode_passages(text):
            h, _, _, e = self.hidden(x)
            new = max(top, float(e.max()))
            old, p = np.exp(top - new), np.exp(e - new)
            top, weight, total = new, weight * old + float(p.sum()), total * old + p @ h
        z = float(total @ self.w["c"] / weight + self.w["d"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss of a batch; ``first`` is each document's first passage."""
        w = self.w
        lens = np.diff(np.append(first, len(x)))
        bag = np.repeat(np.arange(len(first)), lens)
        h, t, g, e = self.hidden(x)
        p = np.exp(e - np.maximum.reduceat(e, first)[bag])
        p /= np.add.reduceat(p, first)[bag]
        z = np.add.reduceat(p[:, None] * h, first)
        s = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"][0], -500, 500)))
        out = weight * (s - y) / weight.sum()
        dz = out[:, None] * w["c"]
        dp = (h * dz[bag]).sum(1)
        de = p * (dp - np.add.reduceat(p * dp, first)[bag])
        dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
        dh = (p[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": ((x - w["mean"]) / w["scale"]).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ out, "d": np.array([out.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.01, ridge: float = 1e-5) -> Network:
    rng = np.random.default_rng(2)
    every = np.concatenate(bags)
    net = Network.fresh(rng, every.mean(0), every.std(0) + 0.02)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    step = 0
    steps_wanted = max(epochs, 600 // max(1, -(-len(bags) // batch)))
    for _ in range(steps_wanted):
        order = rng.permutation(len(bags))
        for lo in range(0, len(bags), batch):
            own = order[lo : lo + batch]
            chosen = [bags[k] for k in own]
            first = np.cumsum([0, *map(len, chosen[:-1])])
            grads = net.gradients(np.concatenate(chosen), first, y[own], np.ones(len(own)))
            step += 1
            for k, g in grads.items():
                g = g + ridge * net.w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.w[k] = net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def draw(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, label_col: str = "quality") -> DataFrame:
    """(text, label) of at most ``most`` labelled documents outside the held-out fold; ids only are sorted, texts are read by a broadcast of the drawn ids."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    chosen = known.where(~held_out("id")).orderBy(F.xxhash64("id", F.lit(2)), "id", "label").limit(most).dropDuplicates(["id"])
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Network | float:
    """A trained network, or a constant score where the labels are not of both kinds. Passages are encoded in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.concatenate(list(encode_passages(t.as_py()))).astype(np.float32).tobytes() for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), batch.column(1)], names=["codes", "label"])

    rows = draw(docs, labels, most).mapInArrow(run, "codes binary, label double").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.codes)))
    y = np.array([float(r.label == 1) for r in rows])
    if not 0 < y.sum() < y.size:
        return float(y.mean()) if y.size else 0.5
    return train([np.frombuffer(bytes(r.codes), np.float32).reshape(-1, WIDTH).astype(float) for r in rows], y)


def with_score(docs: DataFrame, model: Network | float, name: str = "quality", text_col: str = "text") -> DataFrame:
    """Append a struct of one double, ``score``: the higher, the likelier label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, float) else model.w)

    def work():
        held = sent.value

        def apply(texts: pa.Array) -> pa.StructArray:
            own = None if isinstance(held, float) else Network(held)
            scores = [held if own is None else own.score(t.as_py()) for t in texts.cast(pa.binary())]
            return pa.StructArray.from_arrays([pa.array(scores, pa.float64())], names=["score"])

        return apply

    return with_struct(docs, [text_col], name, T.StructType([T.StructField("score", T.DoubleType())]), work)
