"""DuckDB SQL with the rows of those queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# crc32 byte by byte from its table, built in SQL from the polynomial; jump hash with 128-bit products modulo 2^64
OP1 = """
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8
), tbl AS (SELECT list(CAST(c AS BIGINT) ORDER BY b) AS t FROM bits WHERE k = 8),
docs AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
    CAST(xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(regexp_extract_all(lower(hex(encode(coalesce(text, '')))), '..'),
      lambda x: CAST(16 * (strpos('0123456789abcdef', x[1]) - 1) + strpos('0123456789abcdef', x[2]) - 1 AS BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM documents, tbl
), jump(doc_id, key, b, j) AS (
  SELECT DISTINCT doc_id, CAST(CASE WHEN doc_id IS NULL THEN 0 WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE doc_id END AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents
  UNION ALL
  SELECT doc_id, k, j, CAST(trunc(CAST(j + 1 AS DOUBLE) * (2147483648.0::DOUBLE / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, j, (key * CAST(2862933555777941757 AS HUGEINT) + 1) % CAST('18446744073709551616' AS HUGEINT) AS k FROM jump WHERE j < 40)
), found AS (SELECT doc_id, b AS shard, CASE WHEN j = 40 THEN 40 ELSE b END AS grown_shard FROM jump WHERE j >= 40),
mix AS (SELECT doc_id, min(key) AS key FROM jump WHERE b = -1 GROUP BY doc_id)
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, CAST(f.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY f.shard ORDER BY (((m.key * CAST(2862933555777941757 AS HUGEINT) + 1) % 4294967296) // 65536 + d.text_crc32) % 65536, d.doc_id NULLS FIRST, d.text_crc32, d.size) - 1 AS slot,
  CAST(f.grown_shard AS INTEGER) AS grown_shard
FROM docs d JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id JOIN mix m ON d.doc_id IS NOT DISTINCT FROM m.doc_id
"""

# full sets and all pairs that share a shingle; components by the smallest id reachable
OP5 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(s.doc_id, m.low), s.doc_id) AS component_id, s.doc_id = coalesce(least(s.doc_id, m.low), s.doc_id) AS kept
FROM sets s LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON s.doc_id = m.a
"""

_FLAT = "trim(replace(replace(line, chr(9), ' '), chr(13), ' '), ' ')"
# the template tree with the operator's parameters: depth 3, ten documents, 0.7 of constant tokens
OP7 = f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
rows AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r FROM docs),
split AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows),
lines AS (SELECT r, pos, regexp_replace({_FLAT}, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM split WHERE {_FLAT} <> ''),
cut AS (SELECT r, pos, m, string_split(m, ' ') AS t FROM lines),
leafed AS (SELECT r, pos, m, t, [CAST(len(t) AS VARCHAR)] || t[1:3] AS leaf FROM cut),
forms AS (SELECT leaf, m, any_value(t) AS t, count(DISTINCT r) AS docs FROM leafed GROUP BY leaf, m),
tokens AS (SELECT leaf, m, docs, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM forms),
seen AS (SELECT leaf, i, token, sum(docs) AS support FROM tokens GROUP BY leaf, i, token),
shaped AS (
  SELECT k.leaf, k.m, list(CASE WHEN s.support >= 10 THEN k.token ELSE '<*>' END ORDER BY k.i) AS template
  FROM tokens k JOIN seen s ON k.leaf = s.leaf AND k.i = s.i AND k.token = s.token GROUP BY k.leaf, k.m
), fit AS (SELECT * FROM shaped WHERE len(list_filter(template, lambda x: x <> '<*>')) >= 0.7 * len(template)),
placed AS (SELECT l.r, l.pos, f.leaf, f.template FROM leafed l JOIN fit f ON l.leaf = f.leaf AND l.m = f.m),
often AS (SELECT leaf, template, min(r) AS keeper FROM placed GROUP BY leaf, template HAVING count(DISTINCT r) >= 10),
gone AS (SELECT p.r, list(DISTINCT p.pos) AS drops FROM placed p JOIN often o ON p.leaf = o.leaf AND p.template = o.template WHERE p.r <> o.keeper GROUP BY p.r),
done AS (
  SELECT r.doc_id, r.text, CAST(len(coalesce(g.drops, [])) AS BIGINT) AS n_dropped,
    array_to_string(list_transform(list_filter(range(1, len(string_split(r.text, chr(10))) + 1), lambda i: NOT list_contains(coalesce(g.drops, []), i)), lambda i: string_split(r.text, chr(10))[i]), chr(10)) AS rest
  FROM rows r LEFT JOIN gone g ON r.r = g.r
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(len(string_split(d.text, chr(10))) AS BIGINT) END AS n_lines, coalesce(x.n_dropped, 0) AS n_dropped, x.rest AS text
FROM documents d LEFT JOIN done x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text
"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id, e.vec_id <= coalesce(m.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON e.vec_id = m.a
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP10 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS x FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM docs, sizes, unnest(range(1, len(w) - k + 2)) t(i)),
hits AS (SELECT p.r, p.i, p.k, w.item FROM places p JOIN windows w ON p.k = w.k AND p.x = w.x),
covered AS (SELECT r, count(DISTINCT j) AS n FROM hits, unnest(range(i, i + k)) t(j) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n, list_sort(list_distinct(list(item))) AS items FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(array_to_string(coalesce(f.items, []), ',')) AS items_sha256,
  coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c ON d.r = c.r LEFT JOIN found f ON d.r = f.r
"""
