"""DuckDB SQL for the queries that SQL can express, written from the definitions, not the methods."""

OP1 = r"""
WITH d AS (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w
      FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT doc_id, unnest(w) x, unnest(range(len(w))) pos FROM d),
bp AS (SELECT item_id, least(20, len(w)) n_of, unnest(w) x, unnest(range(len(w))) pos FROM b),
shifts AS (
  SELECT doc_id, item_id, dp.pos - bp.pos AS shift FROM dp JOIN bp USING (x)
  GROUP BY ALL HAVING count(*) >= 0.8 * any_value(n_of)),
agree AS (
  SELECT doc_id, item_id, least(20, len(b.w)) n_of, len(b.w) n,
    list_transform(range(len(b.w)), lambda j: CASE WHEN shift + j >= 0 AND d.w[shift + j + 1] = b.w[j + 1] THEN 1 ELSE 0 END) a
  FROM shifts JOIN d USING (doc_id) JOIN b USING (item_id)),
places AS (SELECT *, unnest(range(n - n_of + 1)) place FROM agree),
best AS (SELECT doc_id, item_id, list_sum(a[place + 1 : place + n_of]) matches, n_of, place FROM places),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matches DESC, place) rn
           FROM best WHERE matches >= 0.8 * n_of)
SELECT doc_id, item_id, CAST(matches AS BIGINT) AS matches, CAST(n_of AS BIGINT) AS "of", CAST(place AS BIGINT) AS item_start
FROM ranked WHERE rn = 1
"""

OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(id, seen) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.seen)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) n FROM links GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT id, min(seen) component_id FROM reach GROUP BY id) c ON c.id = e.vec_id
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END s FROM w),
x AS (SELECT doc_id, len(s) n, hash(unnest(s)) k FROM s),
rare AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1),
pairs AS (
  SELECT a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) i FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id
  WHERE a.k IN (FROM rare) AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 85 * (na + nb - i)),
reach(id, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.seen)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT id, min(seen) component_id FROM reach GROUP BY id) c ON c.id = s.doc_id
"""

#: {source} is the table of documents that is deduplicated; ends in cut(doc_id, n_lines, n_deleted, text).
LINE_DEDUP = r"""
d AS (SELECT doc_id, string_split(text, chr(10)) ls FROM {source} WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) s, unnest(range(len(ls))) line FROM d),
c AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line) upto
  FROM (SELECT *, len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) words FROM l)),
spans AS (
  SELECT a.doc_id, a.line start, b.line stop FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.line >= a.line
  WHERE b.upto - a.upto + a.words >= 50),
runs AS (
  SELECT doc_id, start, min(stop) stop FROM spans GROUP BY ALL UNION
  SELECT doc_id, max(start), stop FROM spans GROUP BY ALL),
named AS (
  SELECT r.doc_id, start, stop, row_number() OVER (PARTITION BY ls[start + 1 : stop + 1] ORDER BY r.doc_id, start) rn
  FROM runs r JOIN d USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(range(start, stop + 1)) line FROM named WHERE rn > 1)),
cut AS (
  SELECT doc_id, count(*) n_lines, count(g.line) n_deleted,
    coalesce(string_agg(s, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text
  FROM l LEFT JOIN gone g USING (doc_id, line) GROUP BY doc_id)
"""

OP10 = (
    "WITH "
    + LINE_DEDUP.format(source="documents")
    + """
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, cut.text
FROM documents d LEFT JOIN cut USING (doc_id)
"""
)

OP11 = r"""
WITH w AS (SELECT doc_id, row_number() OVER () r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
x AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) i FROM w WHERE len(w) >= 35)),
again AS (SELECT t FROM x GROUP BY t HAVING count(*) > 1),
starts AS (SELECT r, i FROM x WHERE t IN (FROM again)),
gone AS (SELECT DISTINCT r, i + unnest(range(35)) k FROM starts),
g AS (SELECT r, count(*) n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY k) t FROM (SELECT r, unnest(w) x, unnest(range(1, len(w) + 1)) k FROM w) ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
t AS (SELECT r, lang, source, unnest(w) term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
whole AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) n FROM groups g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w) p FROM whole WINDOW w AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w) q FROM kept WINDOW w AS (PARTITION BY lang)),
pairs AS (SELECT a.lang, a.source, b.source item, coalesce(v, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) v FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP13 = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda x: CAST(x AS BIGINT))), lambda a, b:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) t FROM range(256) r(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) word FROM benchmark),
known AS (SELECT DISTINCT word, hex(encode(word)) h FROM (SELECT unnest(w) word FROM d UNION ALL SELECT word FROM b)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
    lambda a, x: xor(t[CAST(xor(a, x) & 255 AS BIGINT) + 1], a >> 8)), 4294967295::BIGINT) % 10000 AS bucket FROM known, crc),
dw AS (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(w) word FROM d) JOIN hashed USING (word)),
s AS (SELECT bucket, count(*) n FROM dw GROUP BY 1),
t AS (SELECT bucket, count(*) n FROM b JOIN hashed USING (word) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) s, (SELECT coalesce(sum(n), 0) FROM t) t),
gain AS (SELECT r.bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (sums.s + 10000)::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * (sums.t + 10000)::DOUBLE))) AS BIGINT) g
  FROM range(10000) r(bucket), sums LEFT JOIN s ON s.bucket = r.bucket LEFT JOIN t ON t.bucket = r.bucket),
weights AS (SELECT doc_id, count(*) n, CAST(sum(g) AS BIGINT) weight FROM dw JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, len(w) n_words, coalesce(n, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || left(sha256('2024:' || d.doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) k FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN k END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLE_SQL = {
    "op1_decontaminate": OP1,
    "op6_embedding_near_dup": OP6,
    "op7_jaccard_join": OP7,
    "op10_line_dedup": OP10,
    "op11_substring_dedup": OP11,
    "op12_source_divergence": OP12,
    "op13_importance_resampling": OP13,
}
