"""Queries of the decontamination and quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askweave.llm.common import read_table
from askweave.llm.decontamination import leaks
from askweave.llm.quality import DOUBT, GRID, RISK, judged


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("doc_key")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op4_decontaminate": op4_decontaminate, "op6_quality_rules": op6_quality_rules}

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> '')"
_SHINGLES = "unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))"
SQL = {
    "op4_decontaminate": f"""
WITH items AS (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
docs AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
found AS (SELECT doc_id, item_id, count(*) AS n_found FROM docs JOIN items USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, n_found, CAST(n_found AS DOUBLE) / n AS containment
FROM found JOIN sizes USING (item_id) WHERE n_found >= ceil(0.8 * n - 1e-9)""",
}

_RATE = RISK / len(GRID)
_SCORES = {
    "symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)", "long_words": "word_chars / greatest(n_words, 1)", "short_words": "-word_chars / greatest(n_words, 1)",
}
_CUTS = ", ".join(f"('{rule}', CAST({c} AS DOUBLE))" for rule, cuts in GRID.items() for c in cuts)
_SCORE_ROWS = " UNION ALL ".join(f"SELECT r, doc_id, lang, failed, '{rule}' AS rule, {score} AS score FROM m" for rule, score in _SCORES.items())
SQL["op6_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM rep GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM d),
m AS (SELECT r, doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(x) AS n_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS failed FROM d JOIN l USING (r) LEFT JOIN cov USING (r)),
sc AS ({_SCORE_ROWS}),
cuts(rule, cutoff) AS (VALUES {_CUTS}),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
ct AS (SELECT lang, rule, cutoff, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 1 AND score > cutoff) AS bad_cut, count(*) FILTER (quality = 0 AND score > cutoff) AS hit
  FROM sc JOIN lab USING (doc_id) JOIN cuts USING (rule) WHERE NOT failed GROUP BY ALL),
pv AS (SELECT *, CASE WHEN bad_cut > good * {_RATE} THEN 1.0 ELSE list_sum(list_transform(range(0, bad_cut + 1), lambda j: exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1)
  + j * ln({_RATE}) + (good - j) * ln(1 - {_RATE})))) END AS p FROM ct),
ch AS (SELECT lang, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY hit - bad_cut DESC, cutoff DESC) AS best FROM pv
  WHERE p <= {DOUBT} / (SELECT count(*) FROM ct) AND hit > bad_cut) WHERE best = 1),
out AS (SELECT DISTINCT r FROM sc JOIN ch ON sc.rule = ch.rule AND sc.lang IS NOT DISTINCT FROM ch.lang WHERE score > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND r NOT IN (SELECT r FROM out) AS kept FROM m"""
