"""DuckDB SQL of those operator queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda w: w <> '')"

SQL["op2_ngram_quality"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM lines GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), chr(1)) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
many AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT win.doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN many USING (doc_id, k)) GROUP BY 1),
hx AS (SELECT doc_id, hex(encode(text)) AS h FROM d),
g AS (SELECT doc_id, CAST(('0x' || substr(h, 2 * i + 1, 6)) AS BIGINT) AS b FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 2)) AS i FROM hx WHERE length(h) >= 6)),
gb AS (SELECT doc_id, CAST((CAST(b AS HUGEINT) * 11400714819323198485 % 18446744073709551616) // 281474976710656 AS BIGINT) AS bucket, count(*) AS n FROM g GROUP BY ALL),
raw AS (SELECT bucket, sum(n) AS r, coalesce(sum(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN n END), 0) AS t FROM gb GROUP BY 1),
tot AS (SELECT sum(r) AS rs, sum(t) AS ts, count(*) AS v FROM raw),
ratio AS (SELECT bucket, CASE WHEN ts = 0 THEN 0 ELSE ln((t + 1.0) / (ts + v)) - ln((r + 1.0) / (rs + v)) END AS x FROM raw, tot),
sc AS (SELECT doc_id, sum(n * x) / sum(n) AS score FROM gb JOIN ratio USING (bucket) GROUP BY 1),
a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(score, 0.0) AS score
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN sc USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= -0.7 AS kept, round(score, 6) AS score FROM f"""

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"


def _found(name: str, pattern: str, keep: str) -> str:
    """Spans of one pattern: pieces between matches give the running lengths."""
    return f"""
{name}_m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM d WHERE regexp_matches(text, '{pattern}')),
{name} AS (SELECT doc_id, s, s + length(v) AS e, v FROM (SELECT doc_id, m[i] AS v,
  CAST(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM {name}_m)) WHERE {keep})"""


_VALUE = f"length(regexp_extract(v, '{_ASSIGN}', 1)) >= 6"
SQL["op3_entropy_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),{_found('assign', _ASSIGN, _VALUE)},{_found('access', 'AKIA[A-Z0-9]+', 'length(v) >= 20')},{_found('hex', '[0-9a-f]+', 'length(v) >= 24')},
{_found('cand', _CANDIDATE, 'true').strip()},
base AS (SELECT doc_id, s, 0 AS k, e FROM assign UNION ALL SELECT doc_id, s, 1, e FROM access UNION ALL SELECT doc_id, s, 2, e FROM hex),
shape AS (SELECT doc_id, s, e, v, CASE WHEN NOT regexp_matches(v, '[0-9]') THEN 4.0 WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN 2.9 WHEN regexp_full_match(v, '[A-Za-z0-9]+') THEN 3.7 ELSE 3.8 END AS need FROM cand
  WHERE NOT regexp_full_match(v, '[0-9_+/=-]+') AND NOT regexp_full_match(v, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')
  AND NOT regexp_matches(v, '^(sha1|sha256|sha384|sha512|md5)[-_=]') AND NOT regexp_matches(v, '(?i)example|sample|placeholder|x{{6,}}')),
wins AS (SELECT doc_id, s, e, need, i, unnest(string_split(substr(v, i, 20), '')) AS c FROM (SELECT *, unnest(range(1, length(v) - 18)) AS i FROM shape)),
ent AS (SELECT doc_id, s, e, need, i, log2(20.0) - sum(n * log2(n)) / 20 AS h FROM (SELECT doc_id, s, e, need, i, c, count(*) AS n FROM wins GROUP BY ALL) GROUP BY ALL),
hot AS (SELECT doc_id, s, 3 AS k, e FROM ent GROUP BY doc_id, s, e, need HAVING max(h) >= need),
added AS (SELECT h.* FROM hot h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.s <= h.s AND h.e <= b.e)),
listed AS (SELECT doc_id, string_agg(CASE WHEN k < 3 THEN ['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || e END, ',' ORDER BY s, k, e) AS base,
  string_agg(['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans,
  count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_entropy
FROM d LEFT JOIN listed USING (doc_id)"""

SQL["op4_bayes_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), chr(1)) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS common FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 75 * (a.n + b.n - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

_JUMP = """
{name}(doc_id, key, b, j) AS (SELECT doc_id, key, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM k
  UNION ALL SELECT doc_id, nk, j, CAST(floor((j + 1) * (2147483648.0 / (CAST(nk // 8589934592 AS DOUBLE) + 1.0))) AS BIGINT) FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS nk FROM {name} WHERE j < {shards})),
{name}_s AS (SELECT doc_id, CAST(max(b) AS INTEGER) AS shard FROM {name} GROUP BY 1)"""
SQL["op8_jump_hash"] = f"""
WITH RECURSIVE k AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 16)) AS UBIGINT) AS HUGEINT) AS key FROM documents),
{_JUMP.format(name='a', shards=40).strip()},{_JUMP.format(name='g', shards=41)},
poly(i, n, c) AS (SELECT unnest(range(256)), 0, CAST(unnest(range(256)) AS BIGINT) UNION ALL SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM poly WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE n = 8),
hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents),
crc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM hx, tab),
j AS (SELECT crc.doc_id, CAST(size AS BIGINT) AS size, text_crc32, a_s.shard, g_s.shard AS grown_shard, CAST(('0x' || substr(md5(concat_ws(':', CAST(crc.doc_id AS VARCHAR), size, text_crc32)), 17, 8)) AS BIGINT) % greatest(256, (SELECT count(*) FROM documents) // 4000000) AS cell FROM crc JOIN a_s USING (doc_id) JOIN g_s USING (doc_id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM j"""

_ITEM_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]'), lambda w: w <> '')"
SQL["op11_fm_index"] = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hit AS (SELECT doc_id, i, win.size, item_id FROM (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS k FROM place) p JOIN win ON p.size = win.size AND p.k = win.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""
