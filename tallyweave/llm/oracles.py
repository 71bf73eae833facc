"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tallyweave.llm import url_filters

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in url_filters.PAGE_RULES)
_SPAM = " OR ".join(f"regexp_matches(host, '(^|[.-]){w}([.-]|$)')" for w in url_filters.SPAM_WORDS)

OP1 = rf"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UP}', '{LOW}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rhost, rpath, action) AS (VALUES {_RULES}),
listed AS (
  SELECT *, (SELECT rhost || rpath FROM rules
             WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
             ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN (SELECT action FROM rules WHERE rhost || rpath = rule)
            WHEN {_SPAM} THEN 'block' ELSE 'allow' END AS verdict
FROM listed"""

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source_size, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size,
         least(cap, coalesce(max(CASE WHEN cap / weight >= level THEN level END) OVER () * weight, cap)) AS target
  FROM levels),
rates AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rates"""

_WORDS = rf"regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4 = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
grams AS (
  SELECT item, least(10, len(w)) AS size, w[i:i + least(10, len(w)) - 1] AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
spots AS (
  SELECT r, i, size, w[i:i + size - 1] AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs), (SELECT DISTINCT size FROM grams)),
hits AS (SELECT r, i, spots.size, item FROM spots JOIN grams ON spots.gram = grams.gram AND spots.size = grams.size),
covered AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS spot FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""

_TERMS = rf"regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
sizes AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS every FROM docs WHERE len(terms) > 0),
held AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM docs) GROUP BY r, doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, sizes GROUP BY term),
impacts AS (
  SELECT r, doc_id, held.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // every))) AS impact
  FROM held JOIN weights ON held.term = weights.term, sizes),
items AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark),
asked AS (SELECT i, item_id, unnest(terms) AS term FROM items),
scores AS (
  SELECT i, item_id, r, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts ON asked.term = impacts.term
  GROUP BY i, item_id, r, doc_id HAVING sum(impact) > 0)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM scores)
WHERE rank <= 20"""

ORACLES = {"op11_ranked_search": OP11, "op1_url_filters": OP1, "op3_source_mixing": OP3, "op4_decontamination": OP4}
