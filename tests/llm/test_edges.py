"""Nulls, empty and long texts, repeats, clashing columns and empty tables, with the results that the docstrings define."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.odd_tables import no_docs, odd_docs  # noqa: F401
from tests.llm.test_exact import plain_components, plain_fingerprint, plain_hits, plain_spans
from tracklab.llm import common, decontaminate, language, merkle, mixing, preference, quality, secrets, simhash, token_output, toxicity

BENCH = "item_id string, text string"
LABELS = "doc_id long, quality int, toxic int"


def bench(spark):
    return spark.createDataFrame([("a", "One two."), (None, "lost words"), ("b", None), ("c", "!!!"), ("d", "One two"), ("d", "One two")], BENCH)


def test_decontamination(spark, odd_docs, no_docs):
    name = common.free_name(odd_docs, "hits")
    assert name != "hits"
    rows = decontaminate.find_hits(odd_docs, bench(spark), name).collect()
    assert len(rows) == odd_docs.count()
    items = [("a", "One two."), ("d", "One two")]
    for r in rows:
        assert (r[name].n_words, r[name].n_hit, list(r[name]["items"])) == plain_hits(r.text, items)
    kept = decontaminate.decontaminate(odd_docs, bench(spark))
    assert kept.columns == odd_docs.columns and kept.count() == len(rows) - 4
    assert decontaminate.decontaminate(no_docs, bench(spark)).count() == 0
    none = spark.createDataFrame([], BENCH)
    assert decontaminate.decontaminate(odd_docs, none).count() == len(rows)


def test_simhash(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    own = {(r.doc_id, r.fp % (1 << 64)) for r in rows}
    assert own == {(d.doc_id, plain_fingerprint(d.text)) for d in odd_docs.collect()}
    marks = {k: m for k, m in own if k is not None and k != 5}
    got = {r.doc_id: r.component_id for r in rows if r.doc_id in marks}
    assert {k: v for k, v in got.items() if v != 5} == {k: v for k, v in plain_components(marks).items() if got[k] != 5}
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2, 3)} == {0}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 not in ids and ids.count(5) == 2 and ids.count(0) == 1 and 6 not in ids
    assert {r.text for r in kept.where("doc_id = 5").collect()} == {"One two.", "One two, other text"}
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_tokens(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_output.token_digest(odd_docs, path).collect()
    assert len(rows) == odd_docs.count()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda k: (k is not None, k))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert next(r for r in rows if r.doc_id == 0).n_tokens == 1
    assert token_output.token_digest(no_docs, path).count() == 0


def test_merkle(spark, odd_docs, no_docs):
    rows = merkle.compare_edits(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    order = sorted(((d.doc_id is None, -(d.doc_id or 0), d.text or "") for d in odd_docs.collect()))
    want = []
    for k, (_, i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][2], len(t) // 2
        want.append((None if order[k][0] else -i, t, t[: len(t) - half] + after[:half]))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.text, r.edited) for r in rows), key=key) == sorted(want, key=key)
    assert len({r.fingerprint for r in rows if r.text == ""}) == 1
    assert merkle.compare_edits(no_docs).count() == 0


def test_secrets(spark, odd_docs, no_docs):
    more = odd_docs.unionByName(odd_docs.limit(1).withColumn("text", F.lit("user=alice host=db.local token=abcdefgh aB3dE5gH7jK9mN1pQ3sT5"))).unionByName(odd_docs.limit(1).withColumn("text", F.lit("user=alice host=db.local token=abcdefgh aB3dE5gH7jK9mN1pQ3sT5")))
    name = common.free_name(more, "secrets")
    rows = secrets.scan(more, name).collect()
    assert len(rows) == more.count() and name == "secrets_"
    for r in rows:
        spans = sorted((s.start, s.rank, s.end) for s in [*r[name].base, *r[name].weak])
        assert spans == plain_spans(r.text or "")[1]
    assert sum(len(r[name].weak) > 2 for r in rows) == 2
    assert secrets.scan(no_docs, name).count() == 0


def test_mixing(spark, odd_docs, no_docs):
    plan = mixing.plan(odd_docs)
    assert {r.key for r in plan.collect()} == {"-", "+s0", "+s1"}
    mixed = mixing.realise(odd_docs, plan)
    assert mixed.columns == odd_docs.columns and mixed.count() >= odd_docs.count()
    assert mixed.select("doc_id", "text").distinct().count() == odd_docs.select("doc_id", "text").distinct().count()
    assert mixing.realise(no_docs, mixing.plan(no_docs)).count() == 0


def test_preference(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_pairs(preference.pair_by_opening(none)).count() == 0
    turns = "array<struct<role:string,text:string>>"
    made = preference.format_pairs(spark.createDataFrame([(1, None, None), (2, [("user", "a")], None), (3, [("user", "a")], [("user", "a")])], f"pair_id long, chosen {turns}, rejected {turns}")).orderBy("pair_id").collect()
    assert [r.identical for r in made] == [True, False, True] and [r.n_common for r in made] == [0, 0, 1]
    assert made[1].chosen == "<|user|>\na<|end|>\n" and made[1].rejected == "" and made[2].prompt == made[1].chosen


@pytest.mark.parametrize("labels", [[], [(1, None, None), (None, 1, 1)], [(5, 0, 1), (7, 1, 0), (8, 1, 0), (3, 0, 0), (99, 1, 1)]])
def test_scores(spark, odd_docs, no_docs, labels):
    labels = spark.createDataFrame(labels, LABELS)
    for module in (toxicity, quality):
        model = module.fit(odd_docs, labels)
        name = common.free_name(odd_docs, module.__name__.rsplit(".", 1)[1])
        rows = module.with_score(odd_docs, model, name).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r[name].score <= 1 for r in rows)
        assert len({r[name].score for r in rows if not (r.text or "").strip()}) == 1
        assert len({r[name].score for r in rows if r.text == "One two."}) == 1
        assert module.with_score(no_docs, module.fit(no_docs, labels), name).count() == 0


def test_language(spark, odd_docs, no_docs):
    name = common.free_name(odd_docs, "language")
    rows = language.with_language(odd_docs, language.fit(odd_docs), name).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        got = r[name]
        if any(c.isalpha() for c in r.text or ""):
            assert got.lang == "en" and 0 <= got.score <= 1
        else:
            assert (got.lang, got.score, got.rejected) == ("und", 0.0, True)
    rows = language.with_language(odd_docs, language.fit(no_docs), name).collect()
    assert {r[name].lang for r in rows} == {"und"}
    assert language.with_language(no_docs, language.fit(odd_docs), name).count() == 0


def test_ordered_bucket(spark):
    bounds = [3, 7, 8, 20]
    frame = spark.createDataFrame([(k,) for k in (None, -5, 3, 4, 7, 8, 9, 20, 21)], "k long")
    got = {r.k: r.b for r in frame.select("k", common.ordered_bucket(F.col("k"), bounds).alias("b")).collect()}
    assert got == {None: 0, **{k: sum(b < k for b in bounds) for k in (-5, 3, 4, 7, 8, 9, 20, 21)}}
    many = list(range(0, 1000, 7))
    got = spark.range(1100).select("id", common.ordered_bucket(F.col("id"), many).alias("b")).collect()
    assert all(r.b == sum(b < r.id for b in many) for r in got)
    assert hashlib.md5(b"").hexdigest() == spark.range(1).select(F.md5(F.lit(""))).first()[0]
