"""SQL twins of the training-data queries, where SQL can express them.

Fingerprints by XXH64 with a seed (op5), library tokens (op6), look-around patterns (op7) and trained models (op2, op8, op9)
have none; tests restate them by brute force or measure them on held-out labels. The pipeline holds such stages.
"""

from tracklab.llm import fim, merkle, mixing, resampling, warc

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
it AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM k)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g FROM
  (SELECT doc_id, w, k, unnest(range(greatest(0, len(w) - k + 1))) AS i FROM d, (SELECT DISTINCT k FROM it))),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN it USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _mark(text: str) -> str:
    tree = f"list_transform(string_split({text}, chr(10)), lambda s: list_transform(regexp_extract_all(s, '{merkle._CUT}'), lambda p: md5(p)))"
    return f"""(SELECT md5(coalesce(array_to_string(list_transform(tree, lambda s: md5(coalesce(array_to_string(s, ''), ''))), ''), '')) || ':'
      || array_to_string(list_transform(tree, lambda s: coalesce(array_to_string(list_transform(s, lambda x: x[1:8]), ','), '')), ';') FROM (SELECT {tree} AS tree))"""


def _leaves(mark: str) -> str:
    return f"list_distinct(list_filter(string_split(replace({mark}[34:], ';', ','), ','), lambda x: x <> ''))"


def _likeness(a: str, b: str) -> str:
    x, y = _leaves(a), _leaves(b)
    return f"CASE WHEN {a}[1:32] = {b}[1:32] THEN 1.0e0 WHEN len({x}) + len({y}) = 0 THEN 0.0e0 ELSE 2.0e0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(text, '') AS own FROM documents),
e AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx FROM d WINDOW w AS (ORDER BY doc_id DESC)),
f AS (SELECT doc_id, t, nx, substring(t, 1, length(t) - length(t) // 2) || substring(nx, 1, length(t) // 2) AS edited FROM e),
g AS (SELECT doc_id, t, edited, {_mark('t')} AS a, {_mark('edited')} AS b, {_mark('nx')} AS c FROM f)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
  {_likeness('a', 'b')} AS near_edited, {_likeness('a', 'c')} AS near_next,
  coalesce(array_to_string(list_filter(range(greatest(len(string_split(a[34:], ';')), len(string_split(b[34:], ';')))),
    lambda k: string_split(a[34:], ';')[k + 1] IS DISTINCT FROM string_split(b[34:], ';')[k + 1]), ','), '') AS edited_sections
FROM g"""

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) + 1 AS n FROM documents),
s AS (SELECT key, sum(n)::BIGINT AS tokens FROM d GROUP BY key),
l AS (SELECT list(ln(tokens::DOUBLE)) AS l, max(ln(tokens::DOUBLE)) AS top FROM s),
bisect AS (
  SELECT 0 AS step, 0.0e0 AS lo, 1.0e0 AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN above THEN lo ELSE (lo + hi) / 2 END, CASE WHEN above THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT *, ln(z) - wx / z < {mixing.ENTROPY} * ln(n::DOUBLE) AND exp(most - least) <= {mixing.REPEATS} AS above FROM (
    SELECT step, lo, hi, len(l) AS n, list_sum(list_transform(x, lambda v: exp(v))) AS z, list_sum(list_transform(x, lambda v: exp(v) * v)) AS wx,
      list_max(list_transform(list_zip(x, l), lambda v: v[1] - v[2])) AS most, list_min(list_transform(list_zip(x, l), lambda v: v[1] - v[2])) AS least
    FROM (SELECT step, lo, hi, l, list_transform(l, lambda v: (lo + hi) / 2 * (v - top)) AS x FROM bisect, l WHERE step < {mixing.BITS * mixing.PASSES})))),
p AS (SELECT key, tokens, exp(hi * ln(tokens::DOUBLE)) AS p FROM s, (SELECT hi FROM bisect ORDER BY step DESC LIMIT 1)),
q AS (SELECT key, tokens, p / z AS weight, CAST(round(p / z * (most * z)) AS BIGINT) AS quota FROM p, (SELECT sum(p) AS z, max(tokens / p) AS most FROM p)),
u AS (SELECT key, tokens, weight, quota // tokens AS f, quota % tokens AS rest FROM q),
h AS (SELECT doc_id, source, weight, f, rest, n, md5('{mixing.SEED}|' || f || '|' || coalesce(doc_id, -1)) AS place, key FROM d JOIN u USING (key)),
t AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS taken FROM h)
SELECT doc_id, source, round(weight, 9) AS weight, f AS full_epochs, taken AS partial, f + taken::BIGINT AS copies, place FROM t"""

_RENDER = "'<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)"


def _rendered(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: {_RENDER}), ''), '')"


def _mask(turns: str) -> str:
    size = f"list_transform({turns}, lambda t: length({_RENDER}))"
    return f"""coalesce(array_to_string(list_filter(list_transform(range(1, len({turns}) + 1), lambda k: CASE WHEN {turns}[k].role = 'assistant' THEN
      (coalesce(list_sum({size}[1 : k - 1]), 0) + length({turns}[k].role) + 5)::BIGINT || ':' || (coalesce(list_sum({size}[1 : k]), 0) - 1)::BIGINT END), lambda x: x IS NOT NULL), ','), '')"""


def _chars(turns: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter({turns}, lambda t: t.role = 'assistant'), lambda t: length(coalesce(t.text, '')))), 0)"


OP10 = f"""
WITH c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
o AS (SELECT *, md5(coalesce(turns[1].role, '') || '|' || coalesce(turns[1].text, '')) AS opening,
  list_filter(range(1, len(turns) + 1), lambda k: turns[k].role = 'assistant') AS said FROM c),
m AS (SELECT o.*, l.conv_id AS lead_id, l.turns AS lead_turns FROM o JOIN (SELECT opening, min(conv_id) AS conv_id, any_value(turns ORDER BY conv_id) AS turns FROM o GROUP BY opening) l USING (opening)),
v AS (SELECT *, lead_id <> conv_id AS other, {_chars('lead_turns')} >= {_chars('turns')} AS lead_wins,
  CASE WHEN len(said) = 0 THEN turns[1 : len(turns) - 1]
    WHEN turns[said[1]].text IS NOT DISTINCT FROM turns[said[-1]].text THEN turns[1 : said[-1] - 1]
    ELSE list_append(turns[1 : said[-1] - 1], {{'role': 'assistant', 'text': turns[said[1]].text}}) END AS stale FROM m),
p AS (SELECT conv_id AS pair_id, CASE WHEN other AND lead_wins THEN lead_id ELSE conv_id END AS chosen_id, CASE WHEN other AND NOT lead_wins THEN lead_id ELSE conv_id END AS rejected_id,
  CASE WHEN other AND lead_wins THEN lead_turns ELSE turns END AS c, CASE WHEN other AND lead_wins THEN turns WHEN other THEN lead_turns ELSE stale END AS r FROM v),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda k: c[k] IS DISTINCT FROM r[k])) - 1, least(len(c), len(r))) AS n FROM p),
x AS (SELECT pair_id, chosen_id, rejected_id, n, c[1 : n] AS p, c[n + 1 :] AS c, r[n + 1 :] AS r FROM n)
SELECT pair_id, chosen_id, rejected_id, n::BIGINT AS n_common, {_rendered('p')} AS prompt, {_rendered('c')} AS chosen, {_rendered('r')} AS rejected,
  {_mask('c')} AS chosen_mask, {_mask('r')} AS rejected_mask, len(c) = 0 AND len(r) = 0 AS identical FROM x"""

OP11 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d),
r AS (SELECT *, payload_bytes >= {warc.LEAST_REVISIT} AND first_id IS NOT NULL AND coalesce(page_id > first_id, TRUE) AS again FROM f)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to FROM r"""

_DRAW = "CAST('0x' || x[{0} : {1}] AS BIGINT)"
_P, _S, _M = fim.MARKS

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {_DRAW.format(1, 8)} AS h1, {_DRAW.format(9, 16)} AS h2, {_DRAW.format(17, 24)} AS h3, {_DRAW.format(25, 32)} AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '{_P}') OR contains(t, '{_S}') OR contains(t, '{_M}') OR h3 % 100 >= {fim.RATE} THEN 'plain' WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{_P}' || p || '{_S}' || z || '{_M}' || m ELSE '{_S}' || z || '{_P}' || p || '{_M}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s"""

#: CRC32 by its table of 256 remainders, which is built from the polynomial by eight steps a byte.
OP13 = f"""
WITH tab AS (SELECT list(r ORDER BY b) AS tab FROM (SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS r FROM range(256) AS bytes(b))),
texts AS (SELECT TRUE AS own, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT FALSE, NULL, {_WORDS} FROM benchmark),
numbered AS (SELECT row_number() OVER () AS row, * FROM texts),
runs AS (SELECT row, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM numbered),
kinds AS (SELECT f, lower(hex(encode(f))) AS x, row_number() OVER () AS kind FROM (SELECT DISTINCT f FROM runs)),
coded AS (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {resampling.BUCKETS} AS bucket FROM kinds, tab),
b AS (SELECT row, own, bucket, count(*) AS n FROM runs JOIN coded USING (f) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM b GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + {resampling.BUCKETS}) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + {resampling.BUCKETS})))) AS BIGINT) AS gain FROM c),
v AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM b JOIN g USING (bucket) WHERE own GROUP BY row),
z AS (SELECT row, doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM numbered LEFT JOIN v USING (row) WHERE own),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, words >= {resampling.LEAST_WORDS} AS able FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, 5 * count(*) FILTER (able) OVER () // 100 AS drawn FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END AS rank FROM o"""

ORACLES: dict[str, str] = {
    "op1_source_mixing": OP1,
    "op3_decontamination": OP3,
    "op4_merkle_fingerprints": OP4,
    "op10_preference_format": OP10,
    "op11_warc_transactions": OP11,
    "op12_fill_in_middle": OP12,
    "op13_importance_resampling": OP13,
}
