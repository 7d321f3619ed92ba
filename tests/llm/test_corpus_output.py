"""Archives, fill-in-middle and importance resampling: brute force, exact round trips, odd rows."""

import glob
import gzip
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.odd_tables import no_docs, odd_docs  # noqa: F401
from tests.llm.test_exact import by_id, plain_words
from tracklab.llm import common, fim, queries, resampling, warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, record_id string, digest string, payload int"


@pytest.fixture(scope="module")
def pages(spark):
    long_html = "<p>é日𝒳 " * 40_000
    texts = [None, "", "short", "a" * 99, "b" * 100, "é" * 50, "b" * 100, "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n" * 9, "\r\n\r\n" * 60, long_html, long_html, "b" * 100, "a" * 99, "\r\n" * 200]
    urls = ["http://h.org/a?b=c d", None, "", "not a url", "http://[bad/", "http://ä.de/ü\r\nX: 1", *[f"https://h.org/{k}" for k in range(20)]]
    rows = [(100 - k, urls[k], t, "r", "d", k) for k, t in enumerate(texts)]
    rows += [(95, "x", "é" * 50, None, None, None)] * 2 + [(None, "y", "b" * 100, "r", "d", 1), (None, None, None, None, None, None), (None, "z", "only null ids " * 20, "", "", 0), (None, "z", "only null ids " * 20, "", "", 0)]
    return spark.createDataFrame(rows, PAGES)


def plain_origin(rows):
    firsts = {}
    for r in rows:
        if r.page_id is not None:
            firsts[r.html or ""] = min(firsts.get(r.html or "", r.page_id), r.page_id)
    out = []
    for r in rows:
        data = (r.html or "").encode()
        first = firsts.get(r.html or "")
        again = len(data) >= 100 and first is not None and (r.page_id is None or r.page_id > first)
        out.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def read_back(spark, folder):
    got = warc.assemble(common.written(warc.read_records(spark, folder), "records"))
    own = F.col("metadata")[0]["fields"]
    return got, sorted((tuple(r) for r in got.select(own["page-id"].try_cast("long"), "head.payload_bytes", "head.payload_digest", "head.type", own["refers-to-page"].cast("long")).collect()), key=str)


@pytest.mark.parametrize("chunk, chunks", [(1, 3), (warc.CHUNK, warc.CHUNKS)])
def test_archives_round_trip(spark, pages, chunk, chunks):
    rows = pages.collect()
    folder = warc.write_archives(pages, chunk=chunk, chunks=chunks)
    got, seen = read_back(spark, folder)
    assert seen == plain_origin(rows)
    assert sum(r[3] == "revisit" for r in seen) == 4
    made = got.collect()
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 and r.head.intact in (True, None) for r in made)
    assert len({r.capture_id for r in made}) == len(rows)
    whole = {r.payload_digest: r.payload for r in warc.read_records(spark, folder, payloads=True).where("type = 'response'").collect()}
    assert {hashlib.sha256(p).hexdigest() for p in whole.values()} == set(whole) == {hashlib.sha256((r.html or "").encode()).hexdigest() for r in rows}
    files = glob.glob(folder.removeprefix("file:") + "/*.gz")
    assert chunk > 1 or len(files) > 5
    for f in files:  # whole records, each closed by two line ends
        data = gzip.open(f).read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: re") and data.endswith(b"\r\n\r\n")
    where = {r.head.target_uri for r in made}
    assert "http://h.org/a?b=c%20d" in where and not any(c in u for u in where for c in "\r\n ü")


def test_archive_query(spark):
    rows = common.load(spark, SF, "pages").collect()
    assert sorted((tuple(r) for r in queries.op11_warc_transactions(spark, SF).collect()), key=str) == plain_origin(rows)


def test_archives_of_nothing(spark, pages):
    got, seen = read_back(spark, warc.write_archives(pages.where("false")))
    assert seen == [] and got.count() == 0


def test_damaged_archive_is_refused():
    record = "WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    assert len(list(warc.parse(gzip.compress(record) + gzip.compress(record * 2)))) == 3
    for bad in (record[:-6], record[:20], b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(gzip.compress(bad)))


def test_assembly_follows_requests(spark):
    row = lambda i, kind, to: (i, kind, to, None, None, None, None, None, None, None)
    rows = [row("a", "response", None), row("b", "request", "a"), row("c", "metadata", "b"), row("d", "metadata", "a"), row("e", "request", "gone"), row("f", "metadata", None), row("g", "revisit", None), row("h", "metadata", "e"), row("i", "request", None)]
    got = {r.capture_id: (r.head and r.head.type, [x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got == {"a": ("response", ["b"], ["c", "d"]), "gone": (None, ["e"], ["h"]), "f": (None, [], ["f"]), "g": ("revisit", [], []), "i": (None, ["i"], [])}


def test_boundary_set():
    rng = np.random.default_rng(5)
    parts = [np.arange(70_000), 131_072 + np.flatnonzero(rng.random(65_536) < 0.4), 262_144 + np.flatnonzero(rng.random(65_536) < 0.01), [400_001], 458_752 + np.arange(0, 65_536, 2)]
    offsets = np.concatenate(parts)
    held = fim.BoundarySet(offsets)
    assert [c.kind for c in held.containers] == [fim.RUNS, fim.RUNS, fim.BITMAP, fim.ARRAY, fim.ARRAY, fim.BITMAP]
    assert len(held) == offsets.size
    edges = np.cumsum([len(p) for p in parts])
    for k in {0, offsets.size - 1, 65_535, 65_536, *edges[:-1], *(edges - 1), *rng.integers(0, offsets.size, 3000).tolist()}:
        assert held.select(int(k)) == offsets[k]
    with pytest.raises(IndexError):
        held.select(offsets.size)
    assert len(fim.BoundarySet(np.zeros(0, np.int64))) == 0


def test_boundaries_of_units():
    for text in ("", " ", "a", "naïve 日本 𝒳\ttab\x0bend ", "  two  words ", "é" * 70_000, "x\ny\n\nz", "\n"):
        data = text.encode()
        units = {"char": list(text), "line": text.splitlines(True) if "\x0b" not in text else [text]}
        for unit, want in units.items():
            held = fim.boundaries(data, unit)
            cuts = [held.select(k) for k in range(len(held))]
            assert [data[a:b].decode() for a, b in zip(cuts, cuts[1:])] == want
        held = fim.boundaries(data, "word")
        cuts = [held.select(k) for k in range(len(held))]
        assert cuts[0] == 0 and cuts[-1] == len(data) and len(cuts) - 1 == max(len(data.split()), bool(data))
        assert all(len(data[a:b].split()) <= 1 for a, b in zip(cuts, cuts[1:]))


def plain_middle(text, name, seed=1):
    digest = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    h, n = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, odd_docs, no_docs):
    marked = spark.createDataFrame([(k, t) for k, t in enumerate(["a <P> b", "<S", "<P<M>", "x\n<\n\ty", "$1\\E", "日本<M", "<P" * 50] * 9)], "doc_id long, text string")
    for docs in (odd_docs, marked):
        name = common.free_name(docs, "fim")
        made = fim.with_cut(docs, name)
        rows = made.withColumn("back", fim.restored(F.col(f"{name}.output"), F.col(f"{name}.form"))).collect()
        assert len(rows) == docs.count() and made.columns == [*docs.columns, name]
        for r in rows:
            assert tuple(r[name]) == plain_middle(r.text or "", r.doc_id) and r.back == (r.text or "")
    assert fim.with_cut(no_docs).count() == 0
    for unit in ("word", "line"):
        rows = fim.with_cut(odd_docs, unit=unit, rate=100).withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
        assert all(r.back == (r.text or "") for r in rows) and sum(r.fim.form != "plain" for r in rows) >= 10


def test_fill_in_middle_query(spark):
    docs = {r.doc_id: r.text for r in common.load(spark, SF, "documents").collect()}
    got = by_id(queries.op12_fill_in_middle(spark, SF))
    assert got.keys() == docs.keys() and len({r.form for r in got.values()}) == 3
    for k, t in docs.items():
        n, form, a, m, out = plain_middle(t or "", k)
        r, sha = got[k], lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, m, sha(out), sha(t or ""))


def plain_features(text):
    w = plain_words(text)
    return [" ".join(w[k : k + n]).encode() for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain_resampling(docs, items, percent=5):
    """[(doc_id, n_features, weight, score, rank)] of (doc_id, text) rows."""
    held = [(d, t, [zlib.crc32(f) % 10_000 for f in plain_features(t)]) for d, t in docs]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for *_, b in held:
        np.add.at(s, b, 1)
    for text in items:
        np.add.at(t, [zlib.crc32(f) % 10_000 for f in plain_features(text)], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    rows = []
    for d, text, b in held:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        rows.append([d, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text)) >= 20])
    able = sorted((r for r in rows if r[-1]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:-1]) for r in rows), key=str)


def test_resampling_query(spark):
    docs = [(r.doc_id, r.text) for r in common.load(spark, SF, "documents").collect()]
    items = [r.text for r in common.load(spark, SF, "benchmark").collect()]
    assert sorted((tuple(r) for r in queries.op13_importance_resampling(spark, SF).collect()), key=str) == plain_resampling(docs, items)


def test_resampling_of_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(None,), ("One two. word1 and word2",), ("",), ("naïve 日本",)], "text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = plain_resampling(docs, [r.text for r in target.collect()], 50)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    got = resampling.resample(odd_docs, target, 50)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=str) == want
    drawn = resampling.draw(odd_docs, target, 50)
    assert drawn.columns == [*odd_docs.columns, "draw_rank"] and [r.draw_rank for r in drawn.collect()] == [1]
    assert resampling.resample(no_docs, target).count() == 0
    none = target.where("false")
    assert sorted((tuple(r) for r in resampling.resample(odd_docs, none, 50).select(columns).collect()), key=str) == plain_resampling(docs, [], 50)


def test_table_of_stretches():
    rng = np.random.default_rng(11)
    words = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in rng.integers(1, 80, 4000)]
    data = b" ".join(words)
    size = np.array([len(w) for w in words])
    end = np.cumsum(size + 1) - 1
    found = resampling.Stretches(data, end - size, end)
    assert found.keys.tolist() == [xxhash.xxh64_intdigest(w, 0) for w in words]
    for keys in (found.keys, found.keys % 7, found.keys * 0):  # equal keys of unlike stretches are told apart by their bytes
        some = resampling.Stretches(data, end - size, end)
        some.keys = keys.astype(np.uint64)
        table = resampling.Interned(some)
        seen = {}
        for w, slot in zip(words, table.slot.tolist()):
            assert seen.setdefault(w, slot) == slot
        assert len(set(seen.values())) == len(seen) == table.count.size
        assert all(table.count[s] == words.count(w) and table.bucket[s] == zlib.crc32(w) % 10_000 for w, s in seen.items())


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 15])
def test_slices_keep_every_feature(size):
    texts = ["one two three four five six seven eight nine", None, "", "a b", "a", "é b a b é b"]
    got = [[] for _ in texts]
    for part, _ in resampling.slices(pa.array(texts), size=size):
        if part is not None:
            for k, d in enumerate(part.docs):
                got[d].append(part.found.bytes(k))
    assert [sorted(g) for g in got] == [sorted(plain_features(t)) for t in texts]
