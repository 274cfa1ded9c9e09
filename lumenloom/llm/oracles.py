"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

#: %(k)s words a shingle, %(percent)s %% in common; %(more)s stands behind the result's columns.
_LINKED = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(ws) < %(k)s THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + %(k)s - 1], ' ') END AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - %(k)s + 2, 2))) AS i FROM w WHERE len(ws) > 0)
  )
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= %(percent)s * (x.n + y.n - c)
), ends AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), r(id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, ends.v FROM r JOIN ends ON ends.u = r.reach
), c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id%(more)s
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""
OP1 = _LINKED % {"k": 5, "percent": 75, "more": ", d.doc_id = c.component_id AS kept"}
OP12 = _LINKED % {"k": 3, "percent": 90, "more": ""}

OP10 = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM u) u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fit USING (page_id)
"""
