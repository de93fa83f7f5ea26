"""DuckDB SQL for the operators of this package that SQL can express."""



def components_sql(width: int, percent: int, more: str = "") -> str:
    """Components of documents linked by the Jaccard similarity of their shingles."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= {width} THEN list_distinct(list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM s
  UNION
  SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id{more}
FROM s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = s.doc_id
"""


OP4_SQL = components_sql(5, 75)
OP12_SQL = components_sql(3, 85, ", s.doc_id = m.c AS kept")

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
  FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

OP1_SQL = """
WITH part AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
line AS (
  SELECT doc_id, i AS pos, ls[i] AS line, list_distinct(list_filter(string_split_regex(lower(ls[i]), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) AS ts
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM part)),
tok AS (SELECT doc_id, pos, len(ts) AS n, unnest(ts) AS t FROM line),
freq AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
ranked AS (
  SELECT doc_id, pos, n, t, row_number() OVER (PARTITION BY doc_id, pos ORDER BY c, t) AS i
  FROM tok JOIN freq USING (t)),
lead AS (SELECT * FROM ranked WHERE i <= n - CAST(ceil(0.75 * n) AS BIGINT) + 1),
pair AS (
  SELECT DISTINCT x.doc_id AS xd, x.pos AS xp, x.n AS xn, y.doc_id AS yd, y.pos AS yp, y.n AS yn
  FROM lead x JOIN lead y ON x.t = y.t AND (y.doc_id, y.pos) < (x.doc_id, x.pos)
  WHERE 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)),
gone AS (
  SELECT DISTINCT p.xd AS doc_id, p.xp AS pos
  FROM pair p JOIN line a ON a.doc_id = p.xd AND a.pos = p.xp JOIN line b ON b.doc_id = p.yd AND b.pos = p.yp
  WHERE 4 * len(list_intersect(a.ts, b.ts)) >= 3 * (p.xn + p.yn - len(list_intersect(a.ts, b.ts)))),
kept AS (
  SELECT l.doc_id, count(g.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT p.doc_id, k.text, CAST(coalesce(len(p.ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed
FROM part p LEFT JOIN kept k USING (doc_id)
"""

OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
  FROM documents),
t AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v.v) AS p
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (max(total) + 5 * max(v)) AS q
  FROM p JOIN (SELECT lang, sum(n) AS total FROM gn GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS "rank" FROM f)
SELECT lang, source, part, item, value, "rank" FROM r WHERE part = 'pair' OR "rank" <= 50
"""

OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS "rank"
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, "rank", negative_id, positive_score, negative_score FROM n WHERE "rank" <= 3
"""
