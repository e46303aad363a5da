"""DuckDB SQL for the queries that SQL can express, written from their definitions.

The others are compared with brute-force versions in ``tests/llm``: packing,
records and token counts need tokenizer libraries, the toxicity and personal
data queries train models.
"""

from __future__ import annotations

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS a
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.a, c.a), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_NGRAM = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n_x, any_value(b.n) AS n_y, count(*) AS shared
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL
), linked AS (SELECT x, y FROM pairs WHERE 100 * shared >= 90 * (n_x + n_y - shared)),
edges AS (SELECT x, y FROM linked UNION SELECT y, x FROM linked),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id
GROUP BY s.doc_id, len(s.s)
"""

# The recurrence of the distribution function is the definition of the draw, so it is followed term by term.
_MIXING = """
WITH RECURSIVE n AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source),
total AS (SELECT sum(pow(n, 0.5)) AS w, sum(n) AS size FROM n),
rates AS (SELECT source, pow(n, 0.5) / w * size / n AS rate FROM n, total),
parts AS (SELECT source, CAST(greatest(1, ceil(rate / 8.0)) AS INTEGER) AS parts, rate FROM rates),
means AS (SELECT source, parts, rate / parts AS mean FROM parts),
cdf AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1)
  FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 30)
), lists AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, l.parts + 1), lambda j: len(list_filter(l.cdf, lambda c: c <=
    ('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || CAST(j AS VARCHAR)), 1, 13))::BIGINT
    / 4503599627370496.0)))) AS copies
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(0, CAST(copies AS BIGINT))) AS BIGINT) AS copy
FROM drawn
"""

_URLS = r"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parsed)
), rules(rule, verdict) AS (VALUES
  ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
  ('net/es/', 'block'), ('net/fr/', 'block')
), split AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, instr(rule, '/')) AS rule_path FROM rules
), matched AS (
  SELECT p.page_id, p.host, p.path, max_by(s.rule, length(s.rule)) AS rule, max_by(s.verdict, length(s.rule)) AS ruled
  FROM parts p LEFT JOIN split s
    ON (p.host = s.rule_host OR ends_with(p.host, '.' || s.rule_host)) AND starts_with(p.path, s.rule_path)
  GROUP BY p.page_id, p.host, p.path
), hosts AS (
  SELECT host, list_aggregate(split(host, '.')[-2:], 'string_agg', '.') AS domain, split(host, '.')[-1] AS suffix,
    CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS bad, CAST(count(ruled) AS DOUBLE) AS n
  FROM matched GROUP BY host HAVING count(ruled) > 0
), top AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS prior FROM hosts),
s0 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n, any_value(prior) AS prior FROM hosts, top GROUP BY suffix),
s1 AS (SELECT sum(n * pow(bad / n - prior, 2)) AS a, sum(prior * (1 - prior)) AS e, sum(n * prior * (1 - prior)) AS w FROM s0),
s2 AS (SELECT least(greatest(CASE WHEN w > e THEN (a - e) / (w - e) ELSE 0.5 END, 0.01), 0.99) AS share FROM s1),
s3 AS (SELECT suffix, (bad + prior * ((1 - share) / share)) / (n + (1 - share) / share) AS mean, n + (1 - share) / share AS m FROM s0, s2),
d0 AS (SELECT domain, h.suffix, sum(bad) AS bad, sum(h.n) AS n, any_value(mean) AS prior FROM hosts h JOIN s3 USING (suffix) GROUP BY domain, h.suffix),
d1 AS (SELECT sum(n * pow(bad / n - prior, 2)) AS a, sum(prior * (1 - prior)) AS e, sum(n * prior * (1 - prior)) AS w FROM d0),
d2 AS (SELECT least(greatest(CASE WHEN w > e THEN (a - e) / (w - e) ELSE 0.5 END, 0.01), 0.99) AS share FROM d1),
d3 AS (SELECT domain, (bad + prior * ((1 - share) / share)) / (n + (1 - share) / share) AS mean, n + (1 - share) / share AS m FROM d0, d2),
h0 AS (SELECT host, h.domain, bad, h.n, mean AS prior FROM hosts h JOIN d3 USING (domain)),
h1 AS (SELECT sum(n * pow(bad / n - prior, 2)) AS a, sum(prior * (1 - prior)) AS e, sum(n * prior * (1 - prior)) AS w FROM h0),
h2 AS (SELECT least(greatest(CASE WHEN w > e THEN (a - e) / (w - e) ELSE 0.5 END, 0.01), 0.99) AS share FROM h1),
h3 AS (SELECT host, (bad + prior * ((1 - share) / share)) / (n + (1 - share) / share) AS mean, n + (1 - share) / share AS m FROM h0, h2),
lows AS (
  SELECT m.page_id, m.host, m.path, m.rule, m.ruled, coalesce(
    h3.mean - 1.645 * sqrt(h3.mean * (1 - h3.mean) / (h3.m + 1)),
    d3.mean - 1.645 * sqrt(d3.mean * (1 - d3.mean) / (d3.m + 1)),
    s3.mean - 1.645 * sqrt(s3.mean * (1 - s3.mean) / (s3.m + 1))) AS low
  FROM matched m
  LEFT JOIN h3 ON m.host = h3.host
  LEFT JOIN d3 ON list_aggregate(split(m.host, '.')[-2:], 'string_agg', '.') = d3.domain
  LEFT JOIN s3 ON split(m.host, '.')[-1] = s3.suffix
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM lows
"""

_EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
  SELECT p.vec_id AS x, q.vec_id AS y FROM v p JOIN v q ON p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.a, q.a) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.y FROM reach r JOIN linked l ON r.b = l.x
), n AS (SELECT x, count(*) AS n FROM linked GROUP BY x)
SELECT e.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id LEFT JOIN n ON n.x = e.vec_id
GROUP BY e.vec_id
"""

_COLLOCATIONS = r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS p
  FROM words, range(1, 6) AS r(k) WHERE len(w) >= k
), f AS (SELECT lang, k, p, count(*) AS f FROM runs GROUP BY ALL),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
cand AS (SELECT lang, k, p, f AS a FROM f WHERE k >= 2 AND f >= 100),
inside AS (
  SELECT lang, p[i : i + m - 1] AS p, max(a) AS longer
  FROM cand, range(2, 5) AS s(m), range(1, 5) AS o(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), left_over AS (
  SELECT c.* FROM cand c LEFT JOIN inside i ON c.lang = i.lang AND c.p = i.p
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a
), cuts AS (
  SELECT c.lang, c.p, c.a, j AS cut, x.f AS l, y.f AS r, n,
    1000 * CAST(c.a AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM left_over c JOIN range(1, 5) AS q(j) ON j < k
  JOIN f x ON x.lang = c.lang AND x.k = j AND x.p = c.p[1 : j]
  JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.p = c.p[j + 1 : c.k]
  JOIN total t ON t.lang = c.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS nth FROM cuts
), ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM best WHERE nth = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_top_k": _TOP_K,
    "op2_ngram_jaccard": _NGRAM,
    "op4_mixing": _MIXING,
    "op8_url_reputation": _URLS,
    "op9_embedding_dedup": _EMBEDDINGS,
    "op13_collocations": _COLLOCATIONS,
}
