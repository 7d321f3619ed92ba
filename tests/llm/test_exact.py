"""Operators against brute-force restatements over whole tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tracklab.llm import common, decontaminate, merkle, mixing, preference, queries, secrets, simhash, token_output

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in common.load(spark, SF, "documents").collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items, window=13):
    words, hit, found = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        n = min(window, len(own))
        wanted = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1) if n else ():
            if tuple(words[k : k + n]) in wanted:
                hit.update(range(k, k + n))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_decontamination_query(spark, docs):
    items = [(r.item_id, r.text) for r in common.load(spark, SF, "benchmark").collect()]
    got = by_id(queries.op3_decontamination(spark, SF))
    assert got.keys() == docs.keys()
    for k, d in docs.items():
        n, hit, found = plain_hits(d.text, items)
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert any(r.n_hit for r in got.values())


def test_automaton_of_repeating_items(spark):
    rng = np.random.default_rng(3)
    vocab = ["a", "b", "c", "É"]
    items = [(str(k), " ".join(rng.choice(vocab, rng.integers(0, 9)))) for k in range(25)]
    texts = [" ".join(rng.choice([*vocab, "z"], rng.integers(0, 60), p=[0.3, 0.3, 0.2, 0.15, 0.05])) for _ in range(80)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for shard in (1_000, 12):
        for r in decontaminate.find_hits(frame, bench, window=4, shard_words=shard).collect():
            assert (r.hits.n_words, r.hits.n_hit, list(r.hits["items"])) == plain_hits(r.text, items, 4)
            assert sum(b - a for a, b in r.hits.spans) == r.hits.n_hit


def test_spans_are_cut_and_contaminated_documents_go(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    frame = spark.createDataFrame([(1, "Keep this, " + passage.upper() + "! And much more " + "text " * 600), (2, passage), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([("x", passage)], "item_id string, text string")
    kept = by_id(decontaminate.decontaminate(frame, bench))
    assert sorted(kept) == [1, 3] and kept[1].text.startswith("Keep this, W0")
    cut = by_id(decontaminate.decontaminate(frame, bench, max_span=13))
    assert cut[1].text.startswith("Keep this, ! And much") and cut[3].text == "clean"


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)] if n else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, threshold=3):
    """Smallest id reachable for each id, from (id, fingerprint)."""
    ids = sorted(marks)
    parent = {k: k for k in ids}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and (marks[a] ^ marks[b]).bit_count() <= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def test_simhash_query(spark, docs):
    got = by_id(queries.op5_simhash(spark, SF))
    marks = {k: plain_fingerprint(d.text) for k, d in docs.items()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in marks.items()}
    assert {k: r.component_id for k, r in got.items()} == plain_components(marks)


def test_anchors_cover_and_tiles_keep_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    marks = []
    for b in base.tolist():
        for _ in range(8):
            marks.append(b)
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                b ^= 1 << int(bit)
    marks = sorted({m if m < 1 << 63 else m - (1 << 64) for m in marks})
    frame = spark.createDataFrame([(m,) for m in marks], "fp long")
    want = plain_components({m: m % (1 << 64) for m in marks})
    for tile in (4096, 3):
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame, tile=tile)).collect()}
        got = {m: roots.get(m, m) for m in marks}
        assert {frozenset(k for k in marks if got[k] == v) for v in got.values()} == {frozenset(k for k in marks if want[k] == v) for v in want.values()}


def test_one_large_group_of_near_copies(spark):
    """A star of 700 fingerprints one or two bits from a centre, more than one tile."""
    centre = 0x0123456789ABCDEF
    marks = {centre} | {centre ^ 1 << a for a in range(63)} | {centre ^ 1 << a ^ 1 << b for a in range(40) for b in range(a)}
    frame = spark.createDataFrame([(m,) for m in sorted(marks)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, tile=64)).collect()}
    assert {roots.get(m, m) for m in marks} == {min(marks)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {1001: 1000}


def test_token_query_round_trip(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = by_id(queries.op6_token_files(spark, SF)), 0
    for k in sorted(docs):
        ids = [*whole.encode(docs[k].text or "", add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize(
    "text",
    ["a  b", "foo's bar's", "x\ny, (z), don't; »q», a!b 12,3 ²³, ½. é, ", "\n lead", "tail ", "日本語 。text, ok", "a\tb c", "it's 'quoted' we'll", "<|endoftext|> a", "x…y z… .. ,., \x1cq", "A.\nB.\n\nC", "ǅ, ⅷ! ٣, a_b, _a_,", "ª, º. 𝒳, x́", "' ' ''"],
)
def test_pieces_give_the_ids_of_the_whole_text(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    own = token_output.encoder(path)
    for _ in range(3):  # from no memo, from the first meeting, from the memo
        assert np.frombuffer(own.encode(text), own.code).tolist() == want


@pytest.mark.parametrize("text", ["a\tb\n", " a\tb", "a b\tc", "10\u00a0km away\n", "a \tb", "\n", " ", "a\x85b\n\nc\u3000d", "x\r\ny "])
def test_white_space_of_two_kinds_in_one_text(text):
    test_pieces_give_the_ids_of_the_whole_text(text)


def test_random_white_space(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, own, rng = Tokenizer.from_file(path), token_output.encoder(path), np.random.default_rng(6)
    texts = ["".join(rng.choice([" ", "\n", "\t", "\u00a0", "a", "b1", "É,", "'s", "."], rng.integers(1, 9), p=[0.2, 0.1, 0.05, 0.05, 0.2, 0.1, 0.1, 0.1, 0.1])) for _ in range(3000)]
    got = token_output.token_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    assert {r.doc_id: r.ids_crc32 for r in got.collect()} == {
        k: zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in enumerate(texts)
    }
    assert all(np.frombuffer(own.encode(t), own.code).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("n,limit", [(1, 16), (2, 16), (3, 2), (40, 6), (700, 12)])
def test_code_is_complete_limited_and_decodes(n, limit):
    rng = np.random.default_rng(n)
    counts = np.maximum(1, (1e6 / np.arange(1, n + 1) ** 2).astype(np.int64))
    symbols = np.sort(rng.choice(5000, n, replace=False)).astype(np.int64)
    lengths = token_output.code_lengths(counts, limit)
    assert lengths.max() <= limit and math.isclose(sum(2.0**-k for k in lengths), 1.0 if n > 1 else 0.5)
    code = token_output.Code(symbols, lengths)
    sizes = np.array([1, 513, 512, 7, 2000])
    flat = rng.choice(symbols, sizes.sum()).astype(np.uint32)
    data, first, at, starts = token_output.pack(flat, sizes, *code.encode_tables())
    marks = np.concatenate([at[a:b : token_output.CHECKPOINT] for a, b in zip(starts[:-1], starts[1:])])
    size = np.concatenate([np.append(np.full((s - 1) // 512, 512), (s - 1) % 512 + 1) for s in sizes])
    assert np.array_equal(token_output.unpack(np.frombuffer(data + b"\0" * 4, np.uint8), marks, size, code.decode_tables(), code.bits), flat)


def test_unlimited_code_is_as_short_as_huffman():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 21, 40])
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((token_output.code_lengths(counts, 16) * counts).sum()) == cost


def plain_tree(text):
    return [[hashlib.md5(p.encode()).hexdigest() for p in re.findall(r"[^.!?]{1,120}[.!?]?|[.!?]", s)] for s in text.split("\n")]


def plain_mark(text):
    sections = plain_tree(text)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    return md5("".join(md5("".join(s)) for s in sections)) + ":" + ";".join(",".join(x[:8] for x in s) for s in sections)


def plain_likeness(a, b):
    x, y = (set(re.split("[;,]", m[33:])) - {""} for m in (a, b))
    return 1.0 if a[:32] == b[:32] else 2.0 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def check_merkle(got, rows):
    """rows: (doc_id, text) in descending id."""
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_mark(text), plain_mark(edited))
        assert r.near_edited == plain_likeness(plain_mark(text), plain_mark(edited))
        assert r.near_next == plain_likeness(plain_mark(text), plain_mark(after))


def test_merkle_query(spark, docs):
    check_merkle(by_id(queries.op4_merkle_fingerprints(spark, SF)), sorted(((k, d.text) for k, d in docs.items()), reverse=True))


def test_merkle_order_over_few_and_gapped_ids(spark, tmp_path):
    for ids in ([5], [9, 2], [1, 10**12, 7, -3, 40]):
        rows = [(k, f"text of {k}.\nline é𝒳 {k * 7}. tail") for k in ids]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / f"{len(ids)}/documents.parquet"))
        check_merkle(by_id(queries.op4_merkle_fingerprints(spark, str(tmp_path / f"{len(ids)}"))), sorted(rows, reverse=True))


def test_differing_sections_locate_an_edit(spark):
    rows = [("a. b.\nc.\nd.", "a. b.\nx.\nd."), ("a", "a"), ("a", "a\nb")]
    frame = spark.createDataFrame(rows, "x string, y string").select(*[merkle.fingerprint(merkle.tree(c)).alias(c.upper()) for c in ("x", "y")])
    assert [list(r[0]) for r in frame.select(merkle.changed_sections(frame.X, frame.Y)).collect()] == [[1], [], [1]]


def plain_spans(text):
    own = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX}
    base = []
    for kind, pattern in own.items():
        pattern = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(kind, pattern)
        for m in re.finditer(pattern, text, re.A):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                base.append((m.start(), secrets.KINDS.index(kind), m.end()))
    weak = [(m.start(), secrets.KINDS.index(k), m.end()) for k, p in (("ident", secrets.IDENT), ("bare", secrets.BARE), ("endpoint", secrets.ENDPOINT)) for m in re.finditer(p, text, re.A)]

    def near(s, *kinds):
        return any(abs(s[0] - o[0]) <= secrets.REACH and secrets.KINDS[o[1]] in kinds for o in [*base, *weak])

    kept = []
    for s in weak:
        kind = secrets.KINDS[s[1]]
        secret, who, where = near(s, "assign", "bare", "hex"), near(s, "ident", "access"), near(s, "endpoint")
        if kind == "bare" and (near(s, "access") or who and where) or kind == "ident" and secret and where or kind == "endpoint" and secret and who:
            kept.append(s)
    return sorted(base), sorted([*base, *kept])


def check_secrets(got, texts):
    line = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for k, text in texts.items():
        base, spans = plain_spans(text or "")
        r = got[k]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == n for s in base) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest() and r.spans == line(spans), (k, r.spans, line(spans))


def test_secret_query(spark, docs):
    check_secrets(by_id(queries.op7_secret_scan(spark, SF)), {k: d.text for k, d in docs.items()})


def test_secret_linking(spark, tmp_path):
    bare, url = "aB3dE5gH7jK9mN1pQ3sT5", "https://db.example.org/x"
    texts = [
        f"user=alice {bare} {url}", f"{bare} alone", f"login: bob\n{url}", f"é𝒳 AKIA{'Z9' * 10} then {bare}", "secret=token: abcdefg", "PassWord\"  = 'hunter22' host=db1.internal user: carol",
        f"user=alice {'x ' * 150}{bare} {url}", "AKIAAKIA" + "Q" * 14, "0" * 23 + "g" + "a" * 24, "", None, f"token=abc user=alice {url} {bare}", "apikey:=abcdef api_key = x.y/z+==", f"user=alice {bare} {url}",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(queries.op7_secret_scan(spark, str(tmp_path)))
    check_secrets(got, dict(enumerate(texts)))
    assert "bare" in got[0].spans and got[1].spans == "" and got[2].spans == "" and "bare" in got[3].spans and "endpoint" in got[5].spans


def test_secrets_with_long_parts(spark, tmp_path):
    bare, token, name, tail = "aB3" * 100, "t0K" * 80, "n" * 100, "p" * 400
    gap = lambda n: "." * (n - 2)
    cases = [
        (f"user=deploy token={token} https://host", [("ident", 0, 11), ("assign", 12, 258), ("bare", 12, 258), ("endpoint", 259, 271)]),
        (f"user=deploy {bare} https://host", [("ident", 0, 11), ("bare", 12, 312), ("endpoint", 313, 325)]),
        (f"user={name} token=abcdefg https://{tail}", [("ident", 0, 105), ("assign", 106, 119), ("endpoint", 120, 528)]),
        (f"token=abcdefg login=bob host={tail}", [("assign", 0, 13), ("ident", 14, 23), ("endpoint", 24, 429)]),
        (f"user=bob host={tail} {gap(200)} {bare[:30]}", [("endpoint", 9, 414)]),
        (f"user=bob host={tail} {gap(201)} {bare[:30]}", []),
        (f"AKIA{'Q' * 300} {gap(200)} {bare[:30]}", [("access", 0, 304), ("bare", 504, 534)]),
        (f"AKIA{'Q' * 300} {gap(201)} {bare[:30]}", [("access", 0, 304)]),
        (f"{bare} {gap(200)} AKIA{'Q' * 16}", [("bare", 0, 300), ("access", 500, 520)]),
        (f"{bare} {gap(201)} AKIA{'Q' * 16}", [("access", 501, 521)]),
    ]
    spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(queries.op7_secret_scan(spark, str(tmp_path)))
    for k, (_, spans) in enumerate(cases):
        assert got[k].spans == ",".join(":".join(map(str, s)) for s in spans), (k, got[k].spans)


def test_linking_of_random_parts(spark):
    rng, reach = np.random.default_rng(7), 20
    kind = {k: n for n, k in enumerate(secrets.KINDS)}
    parts = {(int(key), int(start), int(rank), int(start + size)) for key, start, rank, size in zip(rng.integers(0, 150, 900), rng.integers(0, 300, 900), rng.integers(0, 6, 900), rng.choice([1, 5, 60, 150], 900))}
    close = {s: [o for o in parts if o[0] == s[0] and o[1] <= s[3] + reach and o[3] >= s[1] - reach] for s in parts}
    near = lambda s, *kinds: any(o[2] in [kind[k] for k in kinds] for o in close[s])
    whole = {s for s in parts if s[2] in (kind["assign"], kind["bare"], kind["hex"]) and near(s, "ident", "access") and near(s, "endpoint")}
    want = set()
    for s in parts:
        secret, who, where = near(s, "assign", "bare", "hex"), near(s, "ident", "access"), near(s, "endpoint")
        if {kind["bare"]: near(s, "access") or who and where, kind["ident"]: secret and where or whole & {*close[s]}, kind["endpoint"]: secret and who or whole & {*close[s]}}.get(s[2]):
            want.add(s)
    got = secrets.linked(spark.createDataFrame(sorted(parts), "key int, start int, rank int, end int"), reach).collect()
    assert 0 < len(want) < len(parts) and sorted(tuple(r) for r in got) == sorted(want)


def plain_mix(rows, entropy, repeats, budget=None):
    """copies per id from (id, source, text)."""
    size = lambda t: len(re.findall("[^ \t\n\x0b\f\r]+", t or "")) + 1
    key = lambda s: "-" if s is None else "+" + s
    tokens = {}
    for _, s, t in rows:
        tokens[key(s)] = tokens.get(key(s), 0) + size(t)
    n, total = len(tokens), sum(tokens.values())

    def weights(a):
        p = {s: t**a for s, t in tokens.items()}
        return {s: x / sum(p.values()) for s, x in p.items()}

    def above(a):
        w = weights(a)
        b = total * budget if budget else max(t / w[s] for s, t in tokens.items())
        return -sum(x * math.log(x) for x in w.values()) < entropy * math.log(n) and max(w[s] * b / t for s, t in tokens.items()) <= repeats

    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if above(mid) else (mid, hi)
    w = weights(hi)
    b = total * budget if budget else max(t / w[s] for s, t in tokens.items())
    copies = {}
    for s, t in tokens.items():
        quota = round(w[s] * b)
        full, rest = divmod(quota, t)
        place = lambda k: hashlib.md5(f"mix|{full}|{-1 if k is None else k}".encode()).hexdigest()  # noqa: E731, B023
        held, taken = 0, set()
        order = sorted({(place(k), k) for k, own, _ in rows if key(own) == s}, key=lambda x: x[0])
        for h, k in order:
            held += sum(size(x) for i, own, x in rows if key(own) == s and i == k)
            if held > rest:
                break
            taken.add(k)
        copies |= {(s, k): full + (k in taken) for _, k in order}
    return w, copies


@pytest.mark.parametrize("entropy,repeats,budget", [(0.9, 4.0, None), (0.99, 2.0, None), (0.97, 3.0, 1.0), (0.9999, 50.0, 2.5)])
def test_mixing(spark, entropy, repeats, budget):
    rng = np.random.default_rng(1)
    source = ["big"] * 300 + ["mid"] * 60 + ["small"] * 12 + [None] * 9
    rows = [(k, s, " ".join(["w"] * int(rng.integers(0, 40))) if k % 11 else None) for k, s in enumerate(source)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.plan(frame, entropy, repeats, budget)
    w, copies = plain_mix(rows, entropy, repeats, budget)
    assert {r.key: pytest.approx(r.weight, abs=1e-9) for r in plan.collect()} == w
    got = {(("-" if r.source is None else "+" + r.source), r.doc_id): r.mix.copies for r in mixing.with_copies(frame, plan).collect()}
    assert got == copies
    assert mixing.realise(frame, plan).count() == sum(copies.values())
    if budget is None:
        assert min(copies.values()) >= 1


def plain_pairs(turns):
    order = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    convs = {}
    for c, turn, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((turn, role, text))
    convs = {c: [(r, x) for _, r, x in sorted(v, key=order)] for c, v in convs.items()}
    render = lambda t: f"<|{t[0] or ''}|>\n{t[1] or ''}<|end|>\n"
    groups = {}
    for c in sorted(convs):
        groups.setdefault((convs[c][0][0] or "", convs[c][0][1] or ""), []).append(c)
    out = {}
    for g in groups.values():
        for c in g:
            lead, own = g[0], convs[c]
            if c != lead:
                chars = lambda k: sum(len(x or "") for r, x in convs[k] if r == "assistant")
                a, b = (lead, c) if chars(lead) >= chars(c) else (c, lead)
                left, right = convs[a], convs[b]
            else:
                a = b = c
                left = own
                said = [k for k, (r, _) in enumerate(own) if r == "assistant"]
                if not said:
                    right = own[:-1]
                elif own[said[0]][1] == own[said[-1]][1]:
                    right = own[: said[-1]]
                else:
                    right = [*own[: said[-1]], ("assistant", own[said[0]][1])]
            n = 0
            while n < min(len(left), len(right)) and left[n] == right[n]:
                n += 1

            def spans(rest):
                at, found = 0, []
                for t in rest:
                    end = at + len(render(t))
                    if t[0] == "assistant":
                        found.append(f"{at + len(t[0]) + 5}:{end - 1}")
                    at = end
                return ",".join(found)

            out[c] = (a, b, n, "".join(map(render, left[:n])), "".join(map(render, left[n:])), "".join(map(render, right[n:])), spans(left[n:]), spans(right[n:]), n == len(left) == len(right))
    return out


def check_pairs(df, turns):
    names = ["chosen_id", "rejected_id", "n_common", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask", "identical"]
    assert {r.pair_id: tuple(r[c] for c in names) for r in df.collect()} == plain_pairs(turns)


def test_preference_query(spark):
    turns = [tuple(r) for r in common.load(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    check_pairs(queries.op10_preference_format(spark, SF), turns)


def test_preference_with_shared_openings_and_nulls(spark, tmp_path):
    turns = [(c, 0, "user", "hi" if c % 3 else "ho") for c in range(12)] + [(c, 1, "assistant", "yes" * (c % 4)) for c in range(12)] + [(c, 2, "user", None) for c in range(6)]
    turns += [(c, 3, "assistant", "bye 𝒳é") for c in range(4)] + [(20, None, None, None), (21, 0, "system", ""), (21, 0, "system", ""), (None, 0, "user", "lost"), (22, 0, "assistant", "only")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    check_pairs(queries.op10_preference_format(spark, str(tmp_path)), turns)
    assert preference.END.startswith("<|end|>")


def test_matches_of_one_text_take_linear_time(spark):
    import time

    def timed(n):
        text = " é\n".join(f"{k:024x}" for k in range(n)) + " token=abcdefgh"
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        found = secrets.scan(frame).first()["secrets"].base
        return time.perf_counter() - start, [(s.start, s.rank, s.end) for s in found], text

    timed(100)
    half, _, _ = timed(20_000)
    full, found, text = timed(40_000)
    assert full < 10 and full < 3 * half + 1
    assert sorted(found) == [s for s in plain_spans(text)[1] if s[1] < 3]
