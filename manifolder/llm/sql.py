"""DuckDB SQL of the operators that SQL can express, over the same tables as the queries."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STUPID_BACKOFF = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
  FROM documents),
t AS (SELECT r, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, i, c, lag(c) OVER o AS b, lag(c, 2) OVER o AS a FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT c, count(*) AS n FROM g GROUP BY c),
c2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
c3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (
  SELECT g.r,
    CASE WHEN g.a IS NOT NULL AND c3.n >= 1 THEN ln(c3.n / x2.n)
         ELSE (CASE WHEN g.a IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END)
            + CASE WHEN g.b IS NOT NULL AND c2.n >= 1 THEN ln(c2.n / x1.n)
                   ELSE (CASE WHEN g.b IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END) + ln(c1.n / (SELECT count(*) FROM g)) END
    END AS v
  FROM g JOIN c1 USING (c) LEFT JOIN c2 USING (b, c) LEFT JOIN c3 USING (a, b, c)
  LEFT JOIN c1 x1 ON x1.c = g.b LEFT JOIN c2 x2 ON x2.b = g.a AND x2.c = g.b)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cost, 0)::BIGINT AS cost_micronats,
  CASE WHEN len(w) > 0 THEN (cost // len(w))::BIGINT END AS cost_per_word
FROM d LEFT JOIN (SELECT r, sum(-floor(v * 1e6 + 0.5)::BIGINT) AS cost FROM s GROUP BY r) USING (r)
"""

URL_RULES = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule, rhost, rpath, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN best USING (page_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (k // 4 * 5 + 1)::INT, 5))::INTEGER >> (15 - k % 4 * 5)::INT) & 31)::INT + 1, 1) FOR k IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (html)
"""

MIXING_TARGETS = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((nth - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM p),
f AS (SELECT *, 3 * source_size / weight AS fills FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY fills, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY fills, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce((SELECT max(level) FROM l WHERE level <= fills), 0) * weight) AS target FROM l)
SELECT doc_id, size, source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
