"""DuckDB SQL for the queries that SQL can express on the small tables."""

from __future__ import annotations

_SUFFIX = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM t WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY 1),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM w JOIN f USING (s) WHERE doc_id > first),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
p AS (SELECT r.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS before, h FROM r JOIN t USING (doc_id)),
k AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p GROUP BY 1)
SELECT t.doc_id, t.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(concat(coalesce(kept, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""

_JACCARD = """WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(m.m, t.doc_id)) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) m ON m.a = t.doc_id"""

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31) AS INTEGER), 1) FOR k IN range(32)], '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS intact FROM d"""

ORACLES: dict[str, str] = {"op4_suffix_array_dedup": _SUFFIX, "op5_ngram_jaccard_join": _JACCARD, "op10_warc_boundary_chain": _WARC}
