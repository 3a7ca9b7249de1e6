"""SQL that the queries are checked against, where SQL can express them."""

from __future__ import annotations

from commitgauge.llm.filter_audit import CAPITALS_PERCENT, DISTINCT_PERCENT, FEWEST_WORDS, SYMBOLS as AUDIT_SYMBOLS
from commitgauge.llm.quality_rules import BOILERPLATE, LINE_END, MARKS, SEPARATORS, SYMBOLS
from commitgauge.llm.token_counts import VERSIONS

WORD = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PHRASES = " OR ".join(f"contains(lower(x), {_text(p)})" for p in BOILERPLATE)
_MENU = ", ".join(map(_text, SEPARATORS))

QUALITY = f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
sized AS (
  SELECT *, list_transform(lines, lambda x: {{'x': x, 'w': regexp_extract_all(x, '{WORD}')}}) AS sized FROM split),
judged AS (
  SELECT *, list_transform(sized, lambda s: len(s.w) > 0 AND (
      NOT regexp_matches(s.x, {_text(LINE_END)})
      OR len(regexp_extract_all(s.x, {_text(MARKS)})) * 10 > len(s.w) * 3
      OR (len(list_filter(s.w, lambda y: y IN ({_MENU}))) * 5 >= len(s.w)
          AND len(list_filter(s.w, lambda y: y IN ({_MENU}))) > 0)
      OR {_PHRASES.replace("(x)", "(s.x)")})) AS fails
  FROM sized),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
covered AS (
  SELECT doc_id, sum(step) AS n FROM (
    SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 5)) AS step
    FROM twice WHERE n > 1)
  GROUP BY doc_id),
base AS (
  SELECT judged.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, {_text(SYMBOLS)})) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(sized, lambda s: len(s.w) > 0))
              - len(list_distinct(list_transform(list_filter(sized, lambda s: len(s.w) > 0), lambda s: s.x))) AS BIGINT)
           AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(list_sum(list_transform(list_filter(range(1, len(lines) + 1), lambda i: fails[i]),
              lambda i: len(sized[i].w))), 0) AS BIGINT) AS words_lost,
         CASE WHEN list_contains(fails, true)
              THEN array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT fails[i]),
                                                  lambda i: lines[i]), chr(10))
              ELSE t END AS clean_text
  FROM judged LEFT JOIN covered ON judged.doc_id = covered.doc_id),
marked AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_lost,
       NOT base_failed AND words_lost <= 0.3::DOUBLE * n_words AS kept, md5(clean_text) AS clean_md5
FROM marked"""

MIXING = f"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'none')) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS weight
  FROM docs GROUP BY source),
walked AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE >= ratio AS capped,
         sum(source_size) OVER () AS everything
  FROM (SELECT *, (3 * source_size)::DOUBLE / weight AS ratio FROM sources)),
filled AS (
  SELECT *, CASE WHEN capped THEN (3 * source_size)::DOUBLE
                 ELSE weight * ((everything - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0))::DOUBLE
                                / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::DOUBLE) END AS target
  FROM walked),
whole AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN capped THEN 3
                 ELSE CAST(floor(target / source_size) AS BIGINT) END AS times
  FROM filled),
placed AS (
  SELECT docs.*, source_size, target, times,
         CASE WHEN capped THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) - times * source_size END AS part,
         coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY h, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs JOIN whole ON docs.source IS NOT DISTINCT FROM whole.source)
SELECT doc_id, size, source, source_size, target,
       CAST(times * size + greatest(0, least(size, part - before)) AS BIGINT) AS taken
FROM placed"""

TOKENS = f"""
WITH kept AS (
  SELECT * FROM documents
  WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text) OR text IS NULL),
counted AS (
  SELECT source, lang, unnest(['words-1', 'words-2']) AS tokenizer,
         unnest([CASE WHEN lang = 'de' THEN len(regexp_extract_all(coalesce(text, ''), '{VERSIONS["words-2"]}'))
                      ELSE len(regexp_extract_all(coalesce(text, ''), '{VERSIONS["words-1"]}')) END,
                 len(regexp_extract_all(coalesce(text, ''), '{VERSIONS["words-2"]}'))]) AS n
  FROM kept)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM counted GROUP BY source, lang, tokenizer"""

FILTER_AUDIT = f"""
WITH letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT o, s AS step, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) t(s)),
docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
flags AS (
  SELECT x.doc_id, part,
         len(w) < {FEWEST_WORDS} AS a, 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) AS b,
         100 * len(regexp_extract_all(t, '[A-Z]')) > {CAPITALS_PERCENT} * length(t) AS c,
         regexp_matches(t, '{AUDIT_SYMBOLS}') AS d,
         EXISTS (SELECT 1 FROM docs y WHERE y.t = x.t AND y.doc_id < x.doc_id) AS e,
         x.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
         x.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM docs x),
judged AS (
  SELECT part, o, step, f, good, toxic,
         CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
         (contains(before, 'A') AND a) OR (contains(before, 'B') AND b) OR (contains(before, 'C') AND c)
           OR (contains(before, 'D') AND d) OR (contains(before, 'E') AND e) AS earlier,
         (a::INT + b::INT + c::INT + d::INT + e::INT) AS n_fails
  FROM flags, steps),
counted AS (
  SELECT part, o, step, f,
         count(*) FILTER (WHERE NOT fails AND NOT earlier) AS kept,
         count(*) FILTER (WHERE fails AND NOT earlier) AS removed,
         count(*) FILTER (WHERE fails AND earlier) AS redundant,
         count(*) FILTER (WHERE fails AND n_fails = 1) AS unique_fails,
         count(*) FILTER (WHERE fails AND NOT earlier AND good) AS good_lost,
         count(*) FILTER (WHERE fails AND NOT earlier AND toxic) AS toxic_lost
  FROM judged GROUP BY part, o, step, f)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted"""

ORACLES: dict[str, str] = {
    "op12_filter_audit": FILTER_AUDIT,
    "op2_quality_rules": QUALITY,
    "op4_mixing": MIXING,
    "op5_token_counts": TOKENS,
}
