"""Near copies by shingles of five words against brute force over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.odd_tables import no_docs, odd_docs  # noqa: F401
from tracklab.llm import common, near_copies


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


def plain_groups(texts, least=0.8):
    """Smallest id of each id's group: texts of a similarity of ``least`` or more are linked, and so are texts without words."""
    sets = {k: plain_shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            low, high = sorted((len(sets[a]), len(sets[b])))
            if high == 0 or (low >= least * high and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def kept(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return sorted(r.doc_id for r in near_copies.keep_one(docs).collect())


def test_planted_copies_of_all_degrees(spark):
    rng = random.Random(5)
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 150, 400]))]
        for copy in range(12):
            own = list(words)
            for _ in range(len(words) * copy // 250):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            texts[base * 12 + copy] = " ".join(own)
    want = plain_groups(texts)
    assert kept(spark, texts) == sorted(set(want.values()))
    assert len(set(want.values())) < len(texts)


def test_one_large_group_beside_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MEMBERS", 7)
    rng = random.Random(6)
    core = [f"c{k}" for k in range(120)]
    texts = {k: " ".join([*core[: k % 119], f"edit{k}", *core[k % 119 + 1 :]]) for k in range(200)}
    passage = " ".join(f"licence{k}" for k in range(60))
    texts |= {1000 + k: passage + " " + " ".join(f"own{rng.randrange(10**9)}" for _ in range(60)) for k in range(60)}
    want = sorted(set(plain_groups(texts).values()))
    assert kept(spark, texts) == want == [0, *range(1000, 1060)]


def test_odd_tables(spark, odd_docs, no_docs):
    got = near_copies.keep_one(odd_docs)
    assert got.columns == odd_docs.columns
    rows = sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    # Null, empty and blank texts are one class, and so is the row without id and text; rows of equal words are one row.
    assert [r.doc_id for r in rows if not (r.text or "").split()] == [0]
    assert sorted(r.text for r in rows if r.doc_id == 5) == ["One two, other text", "One two."]
    assert [r.doc_id for r in rows] == [0, 4, 5, 5, 7, 9, 10, 11, None] and rows[-1].text == "No id here."
    assert near_copies.keep_one(no_docs).count() == 0


def test_case_blanks_and_ties(spark):
    rows = [(4, "Same WORDS here\tand there"), (2, "same words  here and there"), (2, "SAME words here and there"), (None, "same words here and there"), (9, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, second = near_copies.keep_one(docs).collect(), near_copies.keep_one(docs.repartition(5)).collect()
    assert sorted(r.doc_id for r in first) == [2, 9] and sorted(first) == sorted(second)


def test_whole_table(spark):
    docs = common.load(spark, "/root/testdata/sf0.001", "documents")
    want = plain_groups({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id for r in near_copies.keep_one(docs).collect()}
    assert got == set(want.values()) and not got & {145, 177}


def test_chains_that_no_centre_shows(spark, monkeypatch):
    # Without samples and cover the prefixes alone must find every link, also those of a chain whose ends are unlike.
    none = spark.createDataFrame([], "cls long, centre long")
    monkeypatch.setattr(near_copies, "candidates", lambda classes: none)
    rng = random.Random(8)
    passage = " ".join(f"licence{k}" for k in range(40))
    texts = {}
    for base in range(8):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 30, 90, 200]))]
        for copy in range(15):
            texts[base * 20 + copy] = " ".join(words) + " " + passage
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    assert kept(spark, texts) == sorted(set(plain_groups(texts).values()))


def test_pairs_that_share_too_little_are_not_compared(spark):
    # Every two texts share a fifth of their words, single shingles of which meet in the prefixes; two are copies.
    rng = random.Random(9)
    texts = {k: " ".join([f"shared{k // 2}_{n}" for n in range(25)] + [f"own{rng.randrange(10**9)}" for _ in range(100)]) for k in range(60)}
    texts[60] = texts[0] + " more"
    rows = [(k + 1, t, len(plain_shingles(t))) for k, t in texts.items()]
    marked = spark.createDataFrame(rows, "cls long, text string, n long")
    prefixes = near_copies.shared_prefixes(marked, F.col("cls"), F.col("text"), 0.8)
    alone = spark.createDataFrame([], "node long, root long")
    got = [tuple(r) for r in near_copies.crossing(prefixes, alone, 0.8).collect()]
    assert got == [(61, 1)]
    assert near_copies.crossing(near_copies.shared_prefixes(marked.unionByName(marked), F.col("cls"), F.col("text"), 0.8), alone, 0.8).count() == 1


def test_chosen_rows_are_not_shuffled(spark):
    rows = spark.range(0, 200_000, 1, 3).select((F.col("id") * 7).alias("row"), F.lit("x").alias("text"))
    picked = spark.range(0, 200_000, 11).select((F.col("id") * 7).alias("row"))
    got = near_copies.chosen(rows, "row", picked)
    assert got.columns == ["row", "text"]
    assert sorted(r.row for r in got.select("row").collect()) == [7 * k for k in range(0, 200_000, 11)]
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_work_on_one_large_group_of_loose_copies(spark):
    # Copies of one text, each with some words of its own: few pairs of different groups can be links, and no pairs are listed.
    rng = random.Random(12)
    base = [f"c{k}" for k in range(150)]
    texts = {}
    for k in range(500):
        words = list(base)
        for _ in range(rng.choice([1, 3, 6, 9, 12])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
        texts[k] = " ".join(words)
    want = plain_groups(texts)
    assert kept(spark, texts) == sorted(set(want.values()))
    marked = spark.createDataFrame([(k, t, len(plain_shingles(t))) for k, t in texts.items()], "cls long, text string, n long")
    prefixes = near_copies.shared_prefixes(marked, F.col("cls"), F.col("text"), 0.8)
    alone = spark.createDataFrame([], "node long, root long")
    links = [tuple(r) for r in near_copies.crossing(prefixes, alone, 0.8).collect()]
    sets = {k: plain_shingles(t) for k, t in texts.items()}
    alike = sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    # A task returns at most one link a class (the session has 8 partitions of a shuffle).
    assert 0 < len(links) < 500 * 8 < alike


def test_tiles_that_bound_a_set(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MEET", 5)
    monkeypatch.setattr(near_copies, "EXACT", 4)
    rng = random.Random(13)
    texts = {}
    for base in range(3):
        words = [f"w{rng.randrange(500)}" for _ in range(120)]
        for copy in range(30):
            texts[base * 30 + copy] = " ".join(words)
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    none = spark.createDataFrame([], "cls long, centre long")
    monkeypatch.setattr(near_copies, "candidates", lambda classes: none)
    assert kept(spark, texts) == sorted(set(plain_groups(texts).values()))


def test_parity_bits_never_differ_in_more_places_than_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 9000, np.int64).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 5, 300, 600, 1500, 3000, 9000, 9000)]
    sets.append(np.unique(np.concatenate([sets[5][:2900], pool[:50]])))
    tables, n = near_copies.folded([near_copies.parity(x) for x in sets]), np.array([x.size for x in sets])
    for least in (0.3, 0.8, 0.95):
        for i in range(len(sets)):
            for j in range(len(sets)):
                shared = np.intersect1d(sets[i], sets[j]).size
                if shared >= least * (n[i] + n[j] - shared):
                    assert near_copies.possible(tables, n, np.array([i]), np.array([j]), least)[0]
    assert not near_copies.possible(tables, n, np.array([6]), np.array([7]), 0.9)[0]
