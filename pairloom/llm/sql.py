"""SQL of the operators that SQL can express; it runs on the same tables in DuckDB."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHITE = r"[^\x20\x09-\x0D]+"

OP9 = f"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({LOWER.format("text")}, '{ALNUM}') AS w
  FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(13, len(w)) AS size FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM sized)),
docs AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS w FROM documents),
starts AS (
  SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM docs, (SELECT DISTINCT size FROM sized) WHERE len(w) >= size)),
found AS (SELECT s.doc_id, s.p, s.size, x.item_id FROM starts s JOIN windows x ON s.win = x.win AND s.size = x.size),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS q FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP3 = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT vec_id, label, v, len(v) AS n, sqrt(list_dot_product(v, v)) AS norm FROM good),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.label = b.label AND a.n = b.n AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id, vec_id AS r FROM sized UNION SELECT l.a, r.r FROM reach r JOIN links l ON l.b = r.vec_id),
least AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY 1),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, e.vec_id) AS component_id, e.vec_id = coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

OP7 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '{WHITE}') AS w FROM documents),
starts AS (SELECT rid, doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM docs WHERE len(w) >= 20),
windows AS (SELECT rid, doc_id, p, array_to_string(w[p : p + 19], ' ') AS win FROM starts),
first AS (SELECT win, min((coalesce(doc_id, 9223372036854775807), p)) AS f FROM windows GROUP BY 1),
again AS (SELECT rid, p FROM windows JOIN first USING (win) WHERE (coalesce(doc_id, 9223372036854775807), p) <> f),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 20)) AS q FROM again),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM docs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY q) AS t FROM words ANTI JOIN gone USING (rid, q) GROUP BY 1),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)
"""
