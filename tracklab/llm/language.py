"""Language ID by nearest centroid over TF-IDF vectors of byte n-grams.

A text becomes counts of its hashed byte bigrams and trigrams (lower case, anything but letters as one blank), damped by a
logarithm, weighted by inverse document frequency and normalised. Each language has several centroids, found by spherical
k-means; the nearest by cosine decides. Each centroid has its own radius: a text farther away than nearly all of its members
is marked as rejected.

Document frequencies are counted over all training documents. Centroids are fitted on at most ``PER_LANGUAGE`` documents of
each language, drawn by a hash of the id, one language per task.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; without any training document so
are all; ties go to the smaller language value; repeated rows get equal results; documents without a language or an id teach
nothing; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklab.llm.common import held_out, with_struct

SIZE = 2048
CENTROIDS = 4
PER_LANGUAGE = 1000
#: Share of a centroid's own training documents that its radius leaves outside.
OUTSIDE = 0.005
SLICE = 1 << 20
#: Drawn ids are broadcast up to this number, joined by a shuffle beyond.
MOST_BROADCAST = 500_000


def _byte_table() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


_LETTERS = _byte_table()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str | None) -> np.ndarray:
    """Hashed n-gram counts; blanks in a row count once. Long texts are counted in slices that overlap by two bytes."""
    data = _LETTERS[np.frombuffer((text or "").lower().encode(), np.uint8)]
    total = np.zeros(SIZE, np.int64)
    data = np.concatenate([[0x20], data[np.append(True, (data[1:] != 0x20) | (data[:-1] != 0x20))] if data.size else data, [0x20]]).astype(np.uint32)
    for lo in range(0, max(1, data.size - 2), SLICE):
        part = data[lo : lo + SLICE + 2]
        pair = part[:-1] * np.uint32(257) + part[1:]
        two = (pair * np.uint32(2654435761)) >> np.uint32(21)
        three = ((pair[:-1] * np.uint32(263) + part[2:]) * np.uint32(2246822519)) >> np.uint32(21)
        total += np.bincount(two[: SLICE] if lo + SLICE + 2 < data.size else two, minlength=SIZE)
        total += np.bincount(three, minlength=SIZE)
    return total


def unit(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(rows) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per hashed n-gram over all of ``docs``, and the number of documents. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += counts(text) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(total), SIZE), pa.int32()), pa.array(np.append(total[total > 0], n), pa.int64())], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(SIZE + 1, np.int64)
    for r in rows:
        found[r.gram] = r.n
    return found[:SIZE], int(found[SIZE])


def cluster(vectors: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, radii as least cosines) by spherical k-means, started from members at even ranks of likeness to the mean."""
    k = min(k, len(vectors))
    order = np.argsort(vectors @ vectors.mean(0), kind="stable")
    c = vectors[order[(np.arange(k) * 2 + 1) * len(vectors) // (2 * k)]]
    for _ in range(rounds):
        own = np.argmax(vectors @ c.T, axis=1)
        new = np.array([vectors[own == j].sum(0) if (own == j).any() else c[j] for j in range(k)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    near = vectors @ c.T
    own = np.argmax(near, axis=1)
    radii = np.array([np.quantile(near[own == j, j], OUTSIDE) if (own == j).any() else 1.0 for j in range(k)])
    return c, radii


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> dict:
    """Model: idf, and the languages, centroids and radii in ascending language."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    df, n = document_frequency(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    # The rank limit works inside each task before the shuffle, so a frequent language sends no more than the rest.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id"))
    drawn = known.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", F.col("lang").alias("own")).distinct()
    if drawn.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        drawn = F.broadcast(drawn)
    chosen = known.join(drawn, (known["doc_id"] == drawn["doc_id"]) & (known["lang"] == drawn["own"])).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keep = [k for k, t in enumerate(texts) if has_letter(t)]
            made = [unit(counts(texts[k]), idf).astype(np.float32).tobytes() for k in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(made, pa.binary())], names=["lang", "vector"])

    def fit_one(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(rows["vector"].map(bytes))
        c, radii = cluster(np.array([np.frombuffer(b, np.float32) for b in ordered], float), centroids)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "vector": [x.tobytes() for x in c], "radius": radii})

    found = chosen.mapInArrow(run, "lang string, vector binary").groupBy("lang").applyInPandas(fit_one, "lang string, vector binary, radius double").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.vector)))
    return {
        "idf": idf,
        "langs": [r.lang for r in found],
        "centroids": np.array([np.frombuffer(bytes(r.vector)) for r in found]).reshape(-1, SIZE),
        "radii": np.array([r.radius for r in found]),
    }


PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def with_language(docs: DataFrame, model: dict, name: str = "language", text_col: str = "text") -> DataFrame:
    """Append a struct: nearest language, cosine to its nearest centroid, and whether that centroid's radius rejects the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        m = sent.value

        def apply(texts: pa.Array) -> pa.StructArray:
            langs, scores, rejected = [], [], []
            for text in texts:
                text = text.as_py()
                if not m["langs"] or not has_letter(text):
                    langs.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                near = m["centroids"] @ unit(counts(text), m["idf"])
                best = int(np.argmax(near))
                langs.append(m["langs"][best])
                scores.append(float(min(1.0, max(0.0, near[best]))))
                rejected.append(bool(near[best] < m["radii"][best]))
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang", "score", "rejected"])

        return apply

    return with_struct(docs, [text_col], name, PREDICTION, work)
