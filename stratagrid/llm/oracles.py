"""DuckDB SQL of the near-duplicate and repeat queries, which states their contracts without any of their methods."""

from __future__ import annotations

#: Components of ``{links}(a, b)``, symmetric, over ``{nodes}(id)``: ``reach_of(id, component)``.
_REACH = """reach AS (SELECT id, id AS other FROM {nodes} UNION SELECT r.id, l.b FROM reach r JOIN {links} l ON l.a = r.other),
reach_of AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""

OP1_SQL = (
    r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS m FROM s GROUP BY doc_id),
nodes AS (SELECT min(doc_id) AS id, any_value(n) AS n, m FROM c GROUP BY m),
own AS (SELECT id, n, g FROM nodes JOIN s ON s.doc_id = nodes.id),
pairs AS (SELECT x.id AS a, y.id AS b FROM own x JOIN own y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
"""
    + _REACH.format(nodes="nodes", links="links")
    + """
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN nodes ON nodes.m = c.m LEFT JOIN reach_of ON reach_of.id = nodes.id
"""
)

OP6_SQL = (
    """
WITH RECURSIVE e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.label = y.label AND len(x.v) = len(y.v) AND x.id <> y.id WHERE list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.98),
"""
    + _REACH.format(nodes="e", links="links")
    + """
SELECT e.id AS vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component AS component_id, component = e.id AS kept
FROM e JOIN reach_of USING (id) LEFT JOIN (SELECT a AS id, count(*) AS n FROM links GROUP BY a) k USING (id)
"""
)

OP7_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d WHERE octet_length(b) >= 100)),
f AS (SELECT h, min({'d': doc_id, 'i': i}) AS first FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (h) WHERE NOT (first.d = doc_id AND first.i = i)),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r) GROUP BY doc_id, k),
gone AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
cuts AS (SELECT doc_id, lag(hi, 1, 1) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS z FROM (SELECT * FROM runs UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) + 1 FROM d)),
kept AS (SELECT d.doc_id, string_agg(hex(b[a:z - 1]), '' ORDER BY a) AS x FROM d JOIN cuts USING (doc_id) WHERE z > a GROUP BY d.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
