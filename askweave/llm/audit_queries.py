"""Queries of the divergence audit, the importance resampling and the vector deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askweave.llm import divergence, resampling, vector_dedup
from askweave.llm.common import read_table


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(read_table(spark, sf_dir, "documents"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_source_divergence": op11_source_divergence, "op12_importance_resample": op12_importance_resample, "op13_vector_dedup": op13_vector_dedup}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHARE = "CAST(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * {kept}) AS BIGINT)"


def _share(n: str, total: str) -> str:
    return _SHARE.format(n=n, total=total, kept="v.kept")


SQL = {
    "op11_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept_terms AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept_terms USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS kept FROM kept_terms GROUP BY lang),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN c USING (lang, source) GROUP BY lang, source),
lang_sizes AS (SELECT lang, sum(total) AS total FROM sizes GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_share("coalesce(c.n, 0)", "s.total")} AS p
  FROM groups g JOIN kept_terms k USING (lang) JOIN v USING (lang) JOIN sizes s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, {_share("c.n", "s.total")} AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) c JOIN v USING (lang) JOIN lang_sizes s USING (lang)),
diffs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN diffs ON diffs.lang = a.lang AND diffs.source = a.source AND diffs.item = b.source),
high AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM high))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op13_vector_dedup": """
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM raw WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(r, to_r) AS (SELECT r, r FROM raw UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.to_r),
least AS (SELECT reach.r, min(x.vec_id) AS component_id FROM reach JOIN raw x ON x.r = reach.to_r GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM raw JOIN least USING (r) LEFT JOIN n USING (r)""",
}

_FEATURES = f"""w AS (SELECT r, doc_id, src, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS r, doc_id, text, 0 AS src FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, 1 FROM benchmark)),
f AS (SELECT r, src, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM w)"""
SQL["op12_importance_resample"] = f"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
{_FEATURES},
names AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT x FROM f), bits),
g AS (SELECT r, src, bucket FROM f JOIN names USING (x)),
s AS (SELECT i AS bucket, count(*) FILTER (src = 0) AS s, count(*) FILTER (src = 1) AS t FROM range(10000) AS n(i) LEFT JOIN g ON g.bucket = i GROUP BY i),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((sum(t) OVER ())::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s),
m AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM g JOIN gains USING (bucket) WHERE src = 0 GROUP BY r),
sc AS (SELECT w.r, doc_id, len(w.w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN m USING (r) WHERE src = 0),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS fit FROM sc WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * fit // 100 THEN rank END AS rank FROM sc LEFT JOIN k USING (r)"""
