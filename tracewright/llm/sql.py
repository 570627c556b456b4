"""DuckDB SQL of the operators whose result it can express."""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, n, b * 4096 AS base, substr(h, b * 8192 + 1, 8192 + 98) AS part FROM (SELECT doc_id, h, n, unnest(range(n // 4096 + 1)) AS b FROM d)),
p AS (SELECT doc_id, base + i AS pos, substr(part, 2 * i + 1, 100) AS w FROM (SELECT doc_id, base, part, unnest(range(least(4096, len(part) // 2 - 49))) AS i FROM c)),
m AS (SELECT w, min(doc_id) AS first FROM p GROUP BY w HAVING min(doc_id) < max(doc_id)),
f AS (SELECT p.doc_id, p.pos, p.pos - lag(p.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS step FROM p JOIN m ON p.w = m.w AND p.doc_id > m.first),
g AS (SELECT doc_id, pos, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM f),
s AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 50 AS b FROM g GROUP BY ALL),
k AS (SELECT s.doc_id, span, a, b, substr(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS kept FROM s JOIN d USING (doc_id) WINDOW o AS (PARTITION BY s.doc_id ORDER BY a)),
r AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY a) AS kept, max(b) AS last FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
d2 AS (SELECT *, row_number() OVER () AS row_no FROM d),
t AS (SELECT row_no, lang, source, unnest(ts) AS term FROM d2),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
full_p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS cnt,
    1 + (1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // (gn.n + 5 * v.v) AS p,
    1 + (1000000000 * CAST(kept.total + 5 AS HUGEINT)) // (v.n + 5 * v.v) AS q
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM full_p WHERE cnt > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM all_rows QUALIFY part = 'pair' OR rank <= 50
"""

OP12_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
s AS (
  SELECT doc_id, j, count(*) OVER ahead AS n, array_to_string(list(word) OVER ahead, ' ') AS seq FROM each
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, j, row_number() OVER (PARTITION BY seq ORDER BY doc_id, j) AS nth FROM s WHERE n = 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + 20)) AS j FROM f WHERE nth > 1),
kept AS (
  SELECT doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone.j IS NULL) AS left_over
  FROM each LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
bits AS (
  SELECT *, list_reduce(list_prepend(4294967295, flatten(list_transform(regexp_extract_all(doc_id || ':' || run, '.'),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS inverse
  FROM runs),
h AS (SELECT *, xor(inverse, 4294967295) AS h FROM bits),
cut AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
dels AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS del FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
holes AS (SELECT word, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS hole FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT d.word, w.word FROM dels d JOIN words w ON d.del = w.word
  UNION SELECT w.word, d.word FROM dels d JOIN words w ON d.del = w.word),
best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS top, max(w.n) AS top_n FROM near JOIN words w ON w.word = near.b GROUP BY a),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * words.n THEN top END AS form, CASE WHEN top_n >= 5 * words.n THEN top_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN chain ON chain.word = f.word JOIN forms e ON e.word = chain.at AND e.form IS NULL
"""
