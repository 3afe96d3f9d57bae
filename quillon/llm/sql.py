"""DuckDB SQL for the corpus queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from quillon.llm.quality_rules import ALPHA, DELTA, SIGNALS

TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), fit AS (
  SELECT * FROM v WHERE len(v) = (SELECT len(v) FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
), scored AS (
  SELECT q.uid, q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM fit q JOIN fit x ON q.uid <> x.uid WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored) WHERE rank <= 20
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.node WHERE reach.seen < links.b
), least AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON node = doc_id
"""

_VALUES = {
    "symbols": "n_symbols / words",
    "uppercase": "upper / chars",
    "marks": "marks / chars",
    "digits": "digits / chars",
    "duplicate_lines": "n_dup_lines / greatest(lines, 1)",
    "repeats": "n_repeat_words / words",
    "long_words": "word_chars / words",
    "short_words": "n_words / chars",
}
_BINS = ", ".join(f"greatest(0, least({k}, ceil(({_VALUES[name]} - {low}::DOUBLE) / {step}::DOUBLE)))::INTEGER" for name, (low, step, k) in SIGNALS.items())
_RATE = ALPHA / len(SIGNALS)

QUALITY_RULES = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN 'null' ELSE '=' || lang END AS st, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda a: a <> '') AS ws,
         list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
         regexp_replace(x, '[\p{{Ll}}\p{{Lo}}\p{{Lm}}\p{{M}}\x20\x09-\x0D]+', '', 'g') AS rest FROM t
), windows AS (
  SELECT rid, i, ws[i:i + 2] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS k FROM windows) WHERE k >= 2
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), counted AS (
  SELECT w.rid, doc_id, st, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(rest) - length(regexp_replace(rest, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(ls) AS lines,
         length(rest) - length(regexp_replace(rest, '\p{{Lu}}+', '', 'g')) AS upper, length(rest) - length(regexp_replace(rest, '\p{{Nd}}+', '', 'g')) AS digits,
         length(regexp_replace(rest, '[\p{{Lu}}\p{{N}}]+', '', 'g')) AS marks, greatest(len(ws), 1) AS words, greatest(length(array_to_string(ws, '')), 1) AS chars
  FROM w LEFT JOIN covered USING (rid)
), binned AS (
  SELECT *, [{_BINS}] AS bins FROM counted
), known AS (
  SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id
), cells AS (
  SELECT st, sig, bin, count_if(q = 1) AS good, count_if(q = 0) AS bad
  FROM (SELECT st, q, unnest(bins) AS bin, unnest(range(len(bins))) AS sig FROM binned JOIN known USING (doc_id)) GROUP BY ALL
), summed AS (
  SELECT st, sig, bin, sum(good) OVER (PARTITION BY st, sig) AS n, sum(good) OVER above AS wrong, sum(bad) OVER above AS hit
  FROM cells WINDOW above AS (PARTITION BY st, sig ORDER BY bin DESC)
), strata AS (
  SELECT st, max(n)::BIGINT AS n, count(*) OVER () * {len(SIGNALS)} AS tests FROM summed GROUP BY st
), tail AS (
  SELECT st, i, tests, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RATE}::DOUBLE) + (n - i) * ln(1 - {_RATE}::DOUBLE))) OVER (PARTITION BY st ORDER BY i) AS p
  FROM (SELECT *, unnest(range(0, floor(n * {_RATE}::DOUBLE)::BIGINT + 1)) AS i FROM strata WHERE n > 0)
), allowed AS (
  SELECT st, max(i) AS most FROM tail WHERE p <= {DELTA}::DOUBLE / tests GROUP BY st
), best AS (
  SELECT st, sig, max({{'gain': hit - wrong, 'bin': bin}}).bin AS bin FROM summed JOIN allowed USING (st) WHERE bin > 0 AND wrong <= most AND hit > wrong GROUP BY ALL
), rejected AS (
  SELECT rid, string_agg({list(SIGNALS)!r}[sig + 1], ',' ORDER BY sig) AS rejected_by
  FROM (SELECT rid, st, unnest(bins) AS bin, unnest(range(len(bins))) AS sig FROM binned) d JOIN best USING (st, sig) WHERE d.bin >= best.bin GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM binned LEFT JOIN rejected USING (rid)
"""
