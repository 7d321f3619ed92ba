"""The pipeline against brute-force restatements of its stages."""

import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.odd_tables import no_docs, odd_docs  # noqa: F401
from tests.llm.test_exact import plain_hits, plain_mix, plain_words
from tests.llm.test_near_copies import plain_groups
from tracklab.llm import common, toxicity

SF = "/root/testdata/sf0.001"


def plain_cut(text, items, limit=26, window=13):
    """The text without stretches of more than ``limit`` hit words."""
    words, hit = plain_words(text), set()
    for _, item in items:
        own = plain_words(item)
        n = min(window, len(own))
        wanted = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1) if n else ():
            if tuple(words[k : k + n]) in wanted:
                hit.update(range(k, k + n))
    places = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    out, at, k = [], 0, 0
    while k < len(words):
        n = k
        while n in hit:
            n += 1
        if n - k > limit:
            out.append(text[at : places[k][0]])
            at = places[n - 1][1]
        k = max(n, k + 1)
    return "".join([*out, text[at:]])


def test_long_passages_in_long_texts_are_cut(spark):
    items = [(r.item_id, r.text) for r in common.load(spark, SF, "benchmark").collect()]
    passage = max((t for _, t in items), key=lambda t: len(plain_words(t)))
    assert len(plain_words(passage)) > 26
    filler = " ".join(f"filler{k % 5003}" for k in range(20_000))
    texts = [f"{filler}. {passage} {filler}", f"{filler} {passage[: len(passage) // 9]} {filler}", filler, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.STAGES[2][1](spark, docs, SF).collect()}
    assert got == {k: t and plain_cut(t, items) for k, t in enumerate(texts)}
    assert passage not in got[0] and plain_hits(got[0], items)[1] == 0 and got[2] == filler


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = common.load(spark, SF, "documents")
    columns = docs.columns
    model = toxicity.fit(docs, common.load(spark, SF, "labels"))
    own = toxicity.Model(model.weights, model.bias)
    every = docs.collect()
    left = {r.doc_id: r for r in every if own.score((r.text or "").encode()) < 0.3}
    stage = common.written(P.STAGES[0][1](spark, docs, SF), "t0")
    assert stage.columns == columns and {r.doc_id for r in stage.collect()} == left.keys()
    groups = plain_groups({k: r.text for k, r in left.items()})
    left = {k: r for k, r in left.items() if groups[k] == k}
    stage = common.written(P.STAGES[1][1](spark, stage, SF), "t1")
    assert stage.columns == columns and sorted(r.doc_id for r in stage.collect()) == sorted(left)
    items = [(r.item_id, r.text) for r in common.load(spark, SF, "benchmark").collect()]
    hits = {k: plain_hits(r.text, items) for k, r in left.items()}
    left = {k: r for k, r in left.items() if not (hits[k][1] > 0 and 20 * hits[k][1] >= hits[k][0])}
    stage = common.written(P.STAGES[2][1](spark, stage, SF), "t2")
    texts = {k: r.text and plain_cut(r.text, items) for k, r in left.items()}
    assert stage.columns == columns and {r.doc_id: r.text for r in stage.collect()} == texts
    _, copies = plain_mix([(r.doc_id, r.source, texts[k]) for k, r in left.items()], 0.9, 4.0)
    stage = common.written(P.STAGES[3][1](spark, stage, SF), "t3")
    got = {("+" + r.source, r.doc_id): r.n for r in stage.groupBy("source", "doc_id").agg(F.count("*").alias("n")).collect()}
    assert stage.columns == columns and got == {k: n for k, n in copies.items() if n}
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for k in sorted(left):
        ids = [*whole.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        for _ in range(copies[("+" + left[k].source, k)]):
            want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(tuple(r) for r in P.STAGES[4][1](spark, stage, SF).collect()) == sorted(want)


def test_run_and_odd_tables(spark, odd_docs, no_docs):
    assert P.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    for table in (odd_docs, no_docs):
        docs = table
        for name, stage in P.STAGES[:-1]:
            docs = common.written(stage(spark, docs, SF), name)
            assert docs.columns == table.columns
        assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()
        assert (docs.count() == 0) == (table is no_docs)
