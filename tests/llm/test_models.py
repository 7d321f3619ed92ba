"""Trained operators: accuracy on the held-out fold, and that held-out labels teach nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklab.llm import common, language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
BIG = "/root/testdata/sf0.1"


def fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_fold(spark):
    rows = spark.range(200).select("id", common.held_out("id").alias("h")).collect()
    assert all(r.h == fold(r.id) for r in rows) and any(r.h for r in rows)


def test_quality_held_out(spark):
    got = queries.op2_quality(spark, SF).join(common.load(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.97


def test_toxicity_held_out(spark):
    got = queries.op8_toxicity(spark, BIG).join(common.load(spark, BIG, "labels"), "doc_id").where("held_out").collect()
    y, p = np.array([r.toxic for r in got]), np.array([r.predicted for r in got])
    assert p[y == 1].mean() >= 0.8 and p[y == 0].mean() <= 0.04


def test_language_held_out(spark):
    got = queries.op9_language(spark, SF).join(common.load(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.98
    assert sum(r.rejected for r in got) <= 0.1 * len(got)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = common.load(spark, SF, "documents"), common.load(spark, SF, "labels")
    turned = labels.withColumn("toxic", F.when(common.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(common.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.weights == b.weights and a.bias == b.bias
    x, y = quality.fit(docs, labels), quality.fit(docs, turned)
    assert all(np.array_equal(x.w[k], y.w[k]) for k in x.w)
    other = docs.withColumn("lang", F.when(common.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    m, n = language.fit(docs), language.fit(other)
    assert "xx" not in n["langs"] and np.array_equal(m["centroids"], n["centroids"])


def test_gradients_of_the_attention_network():
    rng = np.random.default_rng(0)
    x, y = rng.random((9, quality.WIDTH)), np.array([1.0, 0.0, 1.0])
    first, weight = np.array([0, 2, 6]), np.array([1.0, 2.0, 0.5])
    net = quality.Network.fresh(rng, x.mean(0), x.std(0) + 0.02)

    def loss():
        total = 0.0
        for k, (a, b) in enumerate(zip(first, [2, 6, 9])):
            h, _, _, e = net.hidden(x[a:b])
            p = np.exp(e - e.max())
            z = (p / p.sum()) @ h @ net.w["c"] + net.w["d"][0]
            total += weight[k] * (np.logaddexp(0, z) - y[k] * z)
        return total / weight.sum()

    for name, grad in net.gradients(x, first, y, weight).items():
        flat, g = net.w[name].reshape(-1), grad.reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 5)):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            assert g[k] == pytest.approx((up - loss()) / 2e-5, abs=1e-7)
            flat[k] = old


def test_sliced_passages_score_like_one_slice(monkeypatch):
    text = (" ".join(f"Word{k % 91}, {k}!" for k in range(3000))).encode()
    net = quality.Network.fresh(np.random.default_rng(1), np.zeros(quality.WIDTH), np.ones(quality.WIDTH))
    whole = net.score(text)
    monkeypatch.setattr(quality, "SLICE", 5)
    assert net.score(text) == pytest.approx(whole, abs=1e-12)


def test_sliced_gram_counts(monkeypatch):
    text = "Über den Wolken, 12 mal!  Noch  einmal. " * 50
    whole = language.counts(text)
    monkeypatch.setattr(language, "SLICE", 37)
    assert np.array_equal(language.counts(text), whole)


def test_nnpu_learns_from_unlabelled_text():
    """Feature 0 marks the positives, a fifth of the unlabelled set; feature 1 is noise."""
    rng = np.random.default_rng(4)
    rows, positive = [], []
    for k in range(1500):
        hidden = k < 300 or rng.random() < 0.2
        rows.append(np.array(sorted({0} if hidden else set()) + ([1] if rng.random() < 0.5 else []), np.int64))
        positive.append(k < 300)
    w, bias = toxicity.fit_nnpu(rows, np.array(positive), 2, 0.2)
    sig = lambda z: 1 / (1 + np.exp(-z))
    assert sig(bias + w[0]) > 0.7 and sig(bias) < 0.15 and abs(w[1]) < 1
