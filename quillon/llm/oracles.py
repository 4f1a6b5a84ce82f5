"""DuckDB SQL for those queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) AS span FROM i WHERE len(w) > 0),
marks AS (SELECT DISTINCT item, span, array_to_string(w[k:k + span - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - span + 2)) AS k FROM sized)),
spans AS (SELECT DISTINCT span FROM sized),
wins AS (SELECT doc_id, span, k, array_to_string(w[k:k + span - 1], ' ') AS win FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS k FROM d, spans WHERE len(w) >= span)),
hits AS (SELECT DISTINCT doc_id, span, k, item FROM wins JOIN marks USING (span, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + span)) AS p FROM (SELECT DISTINCT doc_id, span, k FROM hits)) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
kinds AS (SELECT min(doc_id) AS rep, list(doc_id) AS docs, list_sort(g) AS g FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
e AS (SELECT rep, unnest(g) AS x FROM kinds),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN kinds x ON x.rep = a JOIN kinds y ON y.rep = b WHERE 100 * n >= 90 * (len(x.g) + len(y.g) - n)),
sides AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reached AS (SELECT rep AS a, rep AS b FROM kinds UNION SELECT reached.a, sides.b FROM reached JOIN sides ON reached.b = sides.a),
least AS (SELECT a AS rep, min(b) AS component_id FROM reached GROUP BY 1),
members AS (SELECT unnest(docs) AS doc_id, component_id FROM kinds JOIN least USING (rep))
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN members USING (doc_id)
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source AS host, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
threes AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, x) AS n FROM threes) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM again) GROUP BY 1),
parts AS (SELECT doc_id, host, generate_subscripts(lines, 1) AS line, unnest(lines) AS raw FROM (SELECT doc_id, host, string_split(text, chr(10)) AS lines FROM d)),
lines AS (SELECT doc_id, host, line, raw, array_to_string(ws, ' ') AS x, len(ws) AS words FROM (SELECT *, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPACED}) AS ws FROM parts) WHERE len(ws) > 0),
doubled AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lines GROUP BY 1),
candidates AS (SELECT host, x FROM lines GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 20),
marked AS (SELECT lines.*, candidates.x IS NOT NULL AS candidate FROM lines LEFT JOIN candidates ON lines.x = candidates.x AND lines.host IS NOT DISTINCT FROM candidates.host),
rests AS (SELECT doc_id, sum(words) FILTER (candidate) AS held, coalesce(sum(words) FILTER (NOT candidate), 0) AS rest, list_sort(list(x) FILTER (candidate)) AS taken, list_sort(list(x) FILTER (NOT candidate)) AS others FROM marked GROUP BY 1),
beside AS (SELECT doc_id, held >= 8 * rest AS copied, CASE WHEN held >= 8 * rest THEN taken ELSE others END AS other FROM rests WHERE held > 0),
bad AS (SELECT host, x FROM (SELECT DISTINCT host, x, copied, other FROM marked JOIN beside USING (doc_id) WHERE candidate) GROUP BY 1, 2 HAVING count(*) >= 20),
gone AS (SELECT doc_id, sum(words) AS n FROM marked JOIN bad ON marked.x = bad.x AND marked.host IS NOT DISTINCT FROM bad.host GROUP BY 1),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(doubled.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN doubled USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0.5 * n_words AND n_words - n_removed_words < 50) AS kept FROM failed
"""

ALL = {"op1_decontamination": DECONTAMINATION, "op5_ngram_join": NGRAM_JOIN, "op7_quality_rules": QUALITY_RULES}
