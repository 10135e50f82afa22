"""DuckDB twins of the evaluation queries."""

from askweave.functions import fixed
from oracles import sqltext as S
from oracles.retrieval_sql import base, bm25_scores, hits

PRED = f"""
  pr AS (SELECT u.conv_id * 1000 + u.turn AS id, u.conv_id, u.turn, u.text AS question, a.text AS context, string_split({S.squeeze('a.text')}, ' ') AS w
         FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
  pred AS (SELECT id, question, context, w, conv_id % 5 <> 0 AS is_answerable,
             CASE WHEN conv_id % 5 <> 0 THEN array_to_string(w[1 + (conv_id + turn) % len(w):6 + (conv_id + turn) % len(w)], ' ') ELSE '' END AS gold_answer,
             CASE WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE array_to_string(w[1 + ((conv_id + turn) % len(w) + conv_id % 3) % len(w):((conv_id + turn) % len(w) + conv_id % 3) % len(w) + 5 + conv_id % 2], ' ') END AS predicted_answer,
             ((length(context) * 7 + turn) % 83 - 41) / 4.0 AS score_margin FROM pr)"""


def f1(g: str, p: str) -> str:
    common = (f"coalesce(list_sum(list_transform(list_intersect({g}, {p}), lambda x: least(len(list_filter({g}, lambda y: y = x)), "
              f"len(list_filter({p}, lambda y: y = x))))), 0)")
    return (f"CASE WHEN len({g}) = 0 AND len({p}) = 0 THEN 1.0 WHEN len({g}) = 0 OR len({p}) = 0 THEN 0.0 "
            f"ELSE 2.0 * {common} / (len({g}) + len({p})) END")


def scored(source: str, columns: str, gold: str = "gold_answer", predicted: str = "predicted_answer") -> str:
    """Rows of ``source`` with em, f1, lengths and emptiness."""
    return f"""(SELECT {columns}, CAST(g = p AS INTEGER) AS em, {f1('g', 'p')} AS f1, len(g) AS gold_words, len(p) AS predicted_words, empty
      FROM (SELECT *, {S.split_words('ng')} AS g, {S.split_words('np')} AS p FROM (SELECT *, {S.normalize_answer(gold)} AS ng,
            {S.normalize_answer(predicted)} AS np, {S.strip(f"coalesce({predicted}, '')")} = '' AS empty FROM {source})))"""


SC = PRED + ", s AS " + scored("pred", "*").replace("SELECT *, CAST(g", "SELECT id, question, context, is_answerable, gold_answer, predicted_answer, score_margin, CAST(g")

ERR = """CASE WHEN NOT is_answerable AND empty THEN 'CORRECT_NO_ANSWER' WHEN NOT is_answerable THEN 'UNANSWERABLE_FALSE_POSITIVE'
  WHEN empty THEN 'ANSWERABLE_PREDICTED_EMPTY' WHEN em = 1 THEN 'CORRECT' WHEN f1 <= 0 THEN 'WRONG_SPAN'
  WHEN predicted_words < gold_words THEN 'SPAN_TOO_SHORT' WHEN predicted_words > gold_words THEN 'SPAN_TOO_LONG' ELSE 'PARTIAL_SPAN' END"""


def pct(value: str, cond: str = "true") -> str:
    return f"round(coalesce(100.0 * avg(CASE WHEN {cond} THEN {value} END), 0.0), 6)"


E = "CAST(empty AS INTEGER)"
REPORT = f"""count(*) AS overall_count, {pct('em')} AS overall_em, {pct('f1')} AS overall_f1,
  count(*) FILTER (is_answerable) AS answerable_count, {pct('em', 'is_answerable')} AS answerable_em, {pct('f1', 'is_answerable')} AS answerable_f1,
  count(*) FILTER (is_answerable AND empty) AS answerable_predicted_empty, {pct(E, 'is_answerable')} AS answerable_predicted_empty_rate,
  count(*) FILTER (NOT is_answerable) AS unanswerable_count, {pct(E, 'NOT is_answerable')} AS unanswerable_accuracy,
  count(*) FILTER (empty) AS predicted_no_answer, {pct(E)} AS predicted_no_answer_rate,
  count(*) FILTER (NOT is_answerable AND NOT empty) AS false_positive, count(*) FILTER (is_answerable AND empty) AS false_negative"""


def length_class(n: str) -> str:
    return (f"CASE WHEN {n} = 0 THEN '0' WHEN {n} <= 4 THEN '1-4' WHEN {n} <= 8 THEN '5-8' WHEN {n} <= 16 THEN '9-16' "
            f"WHEN {n} <= 32 THEN '17-32' ELSE '33+' END")


def gold(q: str, d: str) -> str:
    """CTE ``gold(query_id, doc_id, strategy)`` by brute force over all pairs."""
    return f"""
  gq AS (SELECT query_id, {S.strip('context')} AS c FROM ({q})), gd AS (SELECT doc_id, {S.strip('text')} AS t FROM ({d})),
  ex AS (SELECT query_id, max(doc_id) AS doc_id FROM gq JOIN gd ON c = t GROUP BY query_id),
  l1 AS (SELECT * FROM gq WHERE query_id NOT IN (SELECT query_id FROM ex)),
  su AS (SELECT query_id, min(doc_id) AS doc_id FROM l1, gd WHERE contains(t, c) OR contains(c, t) GROUP BY query_id),
  l2 AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(c), '{S.WS}+'), lambda x: x <> '')) AS w FROM l1
         WHERE query_id NOT IN (SELECT query_id FROM su)),
  gw AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(t), '{S.WS}+'), lambda x: x <> '')) AS w FROM gd),
  ov AS (SELECT query_id, doc_id, common / (n + m - common) AS o FROM (SELECT query_id, doc_id, len(list_intersect(l2.w, gw.w)) AS common, len(l2.w) AS n, len(gw.w) AS m
         FROM l2, gw WHERE len(l2.w) > 0 AND len(gw.w) >= len(l2.w) * 0.8 - 1e-9 AND len(gw.w) * 0.8 - 1e-9 <= len(l2.w))),
  ja AS (SELECT query_id, doc_id, o FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, doc_id) AS r FROM ov WHERE o >= 0.8) WHERE r = 1),
  gold AS (SELECT query_id, doc_id, 'exact' AS strategy FROM ex UNION ALL SELECT query_id, doc_id, 'substring' FROM su
           UNION ALL SELECT query_id, doc_id, 'jaccard' FROM ja)"""


_ITEMS = "SELECT item_id AS query_id, text AS context FROM benchmark"
_DOCS = "SELECT doc_id, text FROM documents"
_FIRST = "first AS (SELECT h.item_id AS query_id, min(rank) AS r FROM h JOIN gold g ON g.query_id = h.item_id AND g.doc_id = h.doc_id GROUP BY 1)"
_RECALLS = ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in fixed.RECALL_KS)


def _metrics(denominator: str) -> str:
    return f"""WITH {base()}, {bm25_scores()}, h AS (SELECT * FROM {hits(50)}), {gold(_ITEMS, _DOCS)}, {_FIRST}
      SELECT count(*) AS evaluated, {_RECALLS}, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr FROM ({denominator}) q LEFT JOIN first USING (query_id)"""


def sweep(rows: str, thresholds: str, by: str = "") -> str:
    """Metrics for every threshold by pairing rows with thresholds."""
    group = f"{by}, " if by else ""

    def rate(num, den):
        return f"CASE WHEN sum({den}) > 0 THEN 100.0 * sum({num}) / sum({den}) ELSE 0.0 END"

    names = ("overall_em", "overall_f1", "answerable_em", "answerable_f1", "unanswerable_accuracy", "predicted_no_answer_rate",
             "answerable_predicted_empty_rate")
    rounded = ", ".join(f"round({n}, 6) AS {n}" for n in names)
    return f"""(SELECT {group}threshold, {rounded}, round(100.0 - unanswerable_accuracy, 6) AS false_positive_rate, round(answerable_predicted_empty_rate, 6) AS false_negative_rate,
      round(0.5 * answerable_f1 + 0.5 * unanswerable_accuracy, 6) AS balanced_score, round(0.7 * answerable_f1 + 0.3 * unanswerable_accuracy, 6) AS reader_priority_score
      FROM (SELECT {group}threshold, {rate('e', '1')} AS overall_em, {rate('f', '1')} AS overall_f1, {rate('y * e', 'y')} AS answerable_em, {rate('y * f', 'y')} AS answerable_f1,
             {rate('(1 - y) * m', '1 - y')} AS unanswerable_accuracy, {rate('m', '1')} AS predicted_no_answer_rate, {rate('y * m', 'y')} AS answerable_predicted_empty_rate
            FROM ({rows}), {thresholds} GROUP BY {group}threshold))"""


_THRESHOLDS = f"""th AS (SELECT DISTINCT CAST(round(CAST(t AS DOUBLE), 6) AS DOUBLE) AS threshold FROM (
   SELECT unnest(list_transform(range(-20, 21), lambda i: i / 2.0)) AS t UNION ALL SELECT unnest(list_transform(range(-20, 21), lambda i: i / 10.0))
   UNION ALL SELECT unnest(quantile_cont(CAST(score_margin AS DOUBLE), {[0.02 + (0.98 - 0.02) * i / 48 for i in range(49)]})) FROM s))"""
_SWEEP_ROWS = """SELECT CAST(is_answerable AS INTEGER) AS y, threshold, CASE WHEN score_margin >= threshold THEN em ELSE CAST(gold_words = 0 AS INTEGER) END AS e,
   CASE WHEN score_margin >= threshold THEN f1 ELSE CAST(gold_words = 0 AS DOUBLE) END AS f, CASE WHEN score_margin >= threshold THEN CAST(empty AS INTEGER) ELSE 1 END AS m FROM s, th"""
_SWEEP = f"WITH {SC}, {_THRESHOLDS}, sw AS " + sweep(_SWEEP_ROWS, "(SELECT 1)")

_SCORE = lambda a, b: f"((id * {a} + j * {b}) % 101) / 101.0"
_FLAG = lambda a, m: f"((id + j * {a}) % {m} <> 0)"
CAND = f"""
  cand AS (SELECT id, id * 10 + j AS candidate_id, is_answerable, gold_answer, array_to_string(w[1 + (id + j) % len(w):6 + (id + j) % len(w)], ' ') AS text, array_to_string(w[1 + (id + j) % len(w):7 + (id + j) % len(w)], ' ') AS raw_text,
    CASE WHEN j = 2 THEN '' ELSE array_to_string(w[1 + (id + j) % len(w):5 + (id + j) % len(w)], ' ') END AS display_text, CASE WHEN j = 3 THEN 'phrase_fallback' ELSE 'neural_span' END AS method,
    {_SCORE(31, 17)} AS reader_score, {_SCORE(7, 13)} AS retrieval_score, {_SCORE(3, 41)} AS answer_type_score, {_SCORE(11, 5)} AS relation_score,
    {_SCORE(19, 29)} AS boundary_score, {_SCORE(23, 3)} AS completeness_score, {_SCORE(5, 7)} AS cause_pattern_score, {_SCORE(13, 11)} AS subject_match_score,
    {_SCORE(17, 23)} AS target_relation_score, {_SCORE(29, 19)} AS ranking_score, CASE WHEN {_FLAG(1, 9)} THEN 1.0 ELSE 0.0 END AS evidence_score,
    CASE WHEN j = 3 THEN 0.9 ELSE 1.0 END AS fallback_penalty, CASE WHEN (id + j) % 2 = 0 THEN 'CAUSE' ELSE 'PURPOSE' END AS relation_type,
    {_FLAG(1, 11)} AS valid_span, {_FLAG(2, 9)} AS ev, {_FLAG(3, 7)} AS ty, {_FLAG(5, 13)} AS re, {_FLAG(7, 8)} AS co, {_FLAG(3, 5)} AS passes_reader_threshold,
    (id + j) % 3 = 0 AS require_subject_match FROM pred, (SELECT unnest(range(0, 4)) AS j))"""

_CONFIGS = " UNION ALL ".join(f"SELECT '{n}' AS config, {r} AS wr, {d} AS wd, {t} AS wt, {x} AS wx" for n, r, d, t, x in fixed.GRID_WEIGHTS)
_GRID = f"""WITH {PRED}, {CAND},
  cs AS {scored('cand', '*', predicted='text').replace('SELECT *, CAST(g', 'SELECT * EXCLUDE (ng, np, g, p, empty), CAST(g')},
  cfg AS ({_CONFIGS}), pen AS (SELECT unnest([0.6, 0.8, 0.9, 1.0]) AS penalty), th AS (SELECT round(i / 40.0, 3) AS threshold FROM (SELECT unnest(range(12, 37)) AS i)),
  sc AS (SELECT cs.*, config, penalty, round(wr * retrieval_score + wd * (reader_score * CASE WHEN method = 'phrase_fallback' THEN penalty ELSE fallback_penalty END
         * (0.5 + 0.5 * boundary_score) * (0.5 + 0.5 * completeness_score)) + wt * answer_type_score + wx * relation_score, 9) AS score,
         relation_type = 'CAUSE' AND cause_pattern_score >= 0.85 AND subject_match_score >= 0.75 AND target_relation_score >= 0.55 AND relation_score >= 0.80 AS strong
         FROM cs, cfg, pen WHERE text <> '' AND valid_span AND ev AND ty AND re AND co),
  se AS (SELECT config, penalty, threshold, id, em, f1, empty FROM (SELECT *, row_number() OVER (PARTITION BY config, penalty, threshold, id
         ORDER BY score DESC, evidence_score DESC, candidate_id) AS r FROM sc, th WHERE score >= threshold OR strong) WHERE r = 1),
  al AS (SELECT p.id, CAST(is_answerable AS INTEGER) AS y, CAST({S.normalize_answer('gold_answer')} = '' AS INTEGER) AS ng, config, penalty, threshold FROM pred p, cfg, pen, th),
  gr AS """ + sweep("SELECT config, penalty, al.threshold, y, coalesce(em, ng) AS e, coalesce(f1, ng) AS f, coalesce(CAST(empty AS INTEGER), 1) AS m "
                    "FROM al LEFT JOIN se USING (config, penalty, threshold, id)", "(SELECT 1)", "config, penalty")

_GATES = [("reader_only", "g1", "raw"), ("reader_plus_refinement", "g2", "shown"), ("reader_refinement_subject", "g3", "shown"),
          ("reader_refinement_subject_relation", "g4", "shown")]
_ABLATION = f"""WITH {PRED}, {CAND},
  qs AS (SELECT id, gold_answer, is_answerable, predicted_answer, ['CAUSE', 'TIME', 'ENTITY', 'GENERAL'][id % 4 + 1] AS bucket FROM pred),
  c1 AS (SELECT c.*, bucket, coalesce(nullif(raw_text, ''), text) AS raw, coalesce(nullif(display_text, ''), text) AS shown,
         method = 'neural_span' AND valid_span AND passes_reader_threshold AS g1 FROM cand c JOIN (SELECT id, bucket FROM qs) USING (id)),
  c2 AS (SELECT *, g1 AND co AS g2, g1 AND co AND (NOT require_subject_match OR subject_match_score >= 0.5) AS g3 FROM c1),
  c3 AS (SELECT *, g3 AND (bucket NOT IN {S.strs(fixed.HOLDOUT_STRICT_BUCKETS)} OR re) AS g4 FROM c2),
  pk AS ({" UNION ALL ".join(f"SELECT id, '{v}' AS variant, {t} AS predicted_answer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY reader_score DESC, ranking_score DESC, candidate_id) AS r FROM c3 WHERE {g}) WHERE r = 1" for v, g, t in _GATES)}),
  vs AS (SELECT unnest(['reader_only', 'reader_plus_refinement', 'reader_refinement_subject', 'reader_refinement_subject_relation']) AS variant),
  lo AS (SELECT q.id, gold_answer, is_answerable, bucket, vs.variant, coalesce(pk.predicted_answer, '') AS predicted_answer FROM qs q CROSS JOIN vs LEFT JOIN pk ON pk.id = q.id AND pk.variant = vs.variant
         UNION ALL SELECT id, gold_answer, is_answerable, bucket, 'full_pipeline', predicted_answer FROM qs),
  s AS {scored('lo', 'variant, bucket, is_answerable')},
  r AS (SELECT variant, 'ALL' AS bucket, {REPORT} FROM s GROUP BY variant UNION ALL SELECT variant, bucket, {REPORT} FROM s GROUP BY variant, bucket)
  SELECT variant, bucket, overall_count, overall_em, overall_f1, answerable_f1, unanswerable_accuracy, false_positive, false_negative FROM r"""


def stable(seed: str, *parts: str) -> str:
    body = ", ".join(f"chr(0), CAST({p} AS VARCHAR)" for p in parts)
    return f"sha256(concat('{seed}', {body}))"


_ROWS = "rws AS (SELECT doc_id AS id, md5(text) AS question, n_chars % 3 <> 0 AS is_answerable, lang AS bucket FROM documents)"
_BEST = "ORDER BY {m} DESC, answerable_f1 DESC, unanswerable_accuracy DESC, overall_f1 DESC, threshold LIMIT 1"

SQL = {
    "gold_mapping": f"WITH {gold(_ITEMS, _DOCS)} SELECT query_id AS item_id, doc_id, strategy FROM gold",
    "gold_documents": f"WITH {gold('SELECT doc_id AS query_id, text AS context FROM documents', 'SELECT item_id AS doc_id, text FROM benchmark')} SELECT query_id AS doc_id, doc_id AS item_id, strategy FROM gold",
    "near_documents": f"""WITH u AS (SELECT min(doc_id) AS doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '{S.WS}+'), lambda x: x <> '')) AS w FROM documents GROUP BY text),
        p AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS n, len(b.w) AS m FROM u a JOIN u b
              ON a.doc_id <> b.doc_id AND len(b.w) >= len(a.w) * 0.8 - 1e-9 AND len(b.w) * 0.8 - 1e-9 <= len(a.w) AND len(a.w) > 0),
        o AS (SELECT left_id, right_id, c / (n + m - c) AS overlap FROM p WHERE c / (n + m - c) >= 0.8)
        SELECT left_id, right_id, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY overlap DESC, right_id) AS r FROM o) WHERE r = 1""",
    "recall_mrr": _metrics("SELECT DISTINCT query_id FROM gold"),
    "recall_mrr_all": _metrics("SELECT item_id AS query_id FROM benchmark"),
    "recall_by_class": f"""WITH {base()}, {bm25_scores()}, h AS (SELECT * FROM {hits(10)}), {gold(_ITEMS, _DOCS)}, {_FIRST}
        SELECT class, count(r) AS hits, count(*) AS total, round(count(r) / count(*), 6) AS recall FROM (SELECT DISTINCT query_id FROM gold)
        JOIN (SELECT item_id AS query_id, {length_class(S.count_words('text'))} AS class FROM benchmark) USING (query_id) LEFT JOIN first USING (query_id) GROUP BY class""",
    "dense_recall": """WITH p AS (SELECT a.vec_id AS q, b.vec_id AS v, a.label AS ql, b.label AS dl,
          round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS s FROM embeddings a, embeddings b),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, v) AS rank FROM p),
        f AS (SELECT q, min(rank) AS r FROM r WHERE rank <= 11 AND s > 0 AND q <> v AND ql = dl GROUP BY q)
        SELECT label, count(*) AS n, round(avg(CASE WHEN r <= 6 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr
        FROM embeddings LEFT JOIN f ON q = vec_id GROUP BY label""",
    "em_f1_rows": f"""WITH {SC} SELECT id, em, round(f1, 6) AS f1, {ERR} AS error_type,
        CASE WHEN em = 1 AND {S.strip('gold_answer')} <> '' THEN 'Khớp chính xác' WHEN em = 1 THEN 'Đúng khi không trả lời'
          WHEN {S.strip('gold_answer')} <> '' AND {S.strip('predicted_answer')} = '' THEN 'Không trả lời'
          WHEN {S.strip('gold_answer')} = '' AND {S.strip('predicted_answer')} <> '' THEN 'Trả lời khi câu không có đáp án' ELSE 'Không khớp đáp án chuẩn' END AS note FROM s""",
    "em_f1_report": f"WITH {SC} SELECT {REPORT} FROM s",
    "set_overlap": f"""WITH {PRED}, t AS (SELECT id, {S.split_words('g0')} AS g, {S.split_words('p0')} AS p FROM (SELECT id, {S.normalize_answer('gold_answer')} AS g0, {S.normalize_answer('predicted_answer')} AS p0 FROM pred))
        SELECT id, round(CASE WHEN len(g) = 0 OR len(p) = 0 THEN CASE WHEN len(g) = len(p) THEN 1.0 ELSE 0.0 END ELSE 2.0 * len(list_intersect(g, p)) / (len(g) + len(p)) END, 6) AS set_f1,
          round(CASE WHEN len(g) + len(p) = 0 THEN 0.0 ELSE len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))) END, 6) AS jaccard FROM t""",
    "error_taxonomy": f"WITH {SC} SELECT {ERR} AS error_type, count(*) AS count FROM s GROUP BY 1",
    "length_hist": f"WITH {SC} SELECT {length_class('predicted_words')} AS length_class, count(*) AS count FROM s GROUP BY 1",
    "ratio_buckets": f"""WITH {SC}, x AS (SELECT predicted_words / gold_words AS r FROM s WHERE is_answerable AND gold_words > 0)
        SELECT CASE WHEN r < 0.5 THEN 'SEVERE_UNDER_SPAN' WHEN r < 0.8 THEN 'UNDER_SPAN' WHEN r <= 1.25 THEN 'ROUGHLY_CORRECT' WHEN r <= 2.0 THEN 'OVER_SPAN' ELSE 'SEVERE_OVER_SPAN' END AS span_class,
          count(*) AS count FROM x GROUP BY 1""",
    "refinement_outcomes": f"""WITH {PRED}, {CAND}, a AS {scored('cand', 'candidate_id, raw_text, text', predicted='raw_text')}, b AS {scored('cand', 'candidate_id', predicted='text')}
        SELECT CASE WHEN b.f1 > a.f1 + 1e-12 THEN 'IMPROVED' WHEN b.f1 + 1e-12 < a.f1 THEN 'WORSENED' WHEN raw_text <> text THEN 'BOUNDARY_FIXED' ELSE 'UNCHANGED' END AS outcome,
          count(*) AS count FROM a JOIN b USING (candidate_id) GROUP BY 1""",
    "threshold_sweep": _SWEEP + " SELECT * FROM sw",
    "threshold_best": _SWEEP + " SELECT threshold, overall_f1, answerable_f1, reader_priority_score FROM sw ORDER BY reader_priority_score DESC, answerable_f1 DESC, overall_f1 DESC, threshold LIMIT 1",
    "objectives": _SWEEP + " " + " UNION ALL ".join(
        f"(SELECT '{o}' AS objective, threshold, overall_f1, answerable_f1, unanswerable_accuracy FROM sw {_BEST.format(m=m)})" for o, m in (
            ("maximize_overall_f1", "overall_f1"), ("maximize_answerable_f1", "answerable_f1"),
            ("reader_priority_0.7_answerable_f1_0.3_unanswerable_accuracy", "reader_priority_score"))),
    "score_distribution": f"""WITH {PRED}, l AS (SELECT is_answerable, 'score_margin' AS metric, CAST(score_margin AS DOUBLE) AS v FROM pred UNION ALL
          SELECT is_answerable, 'confidence', 1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, score_margin / 10.0)))) FROM pred)
        SELECT is_answerable, metric, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25,
          round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90 FROM l GROUP BY ALL""",
    "percentile_nearest": """WITH a AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
        SELECT event_type, round(v[CAST(round_even((len(v) - 1) * 0.5, 0) AS BIGINT) + 1], 6) AS p50, round(v[CAST(round_even((len(v) - 1) * 0.95, 0) AS BIGINT) + 1], 6) AS p95 FROM a""",
    "percentile_linear": "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "grid_search": _GRID + " SELECT config, CAST(penalty AS DOUBLE) AS penalty, CAST(threshold AS DOUBLE) AS threshold, overall_em, overall_f1, answerable_f1, unanswerable_accuracy, reader_priority_score FROM gr",
    "grid_winners": _GRID + """, mk AS (SELECT *, max(answerable_f1) OVER (PARTITION BY config) AS best FROM gr),
        a AS (SELECT *, 'unconstrained' AS selection, row_number() OVER (PARTITION BY config ORDER BY reader_priority_score DESC, overall_f1 DESC, unanswerable_accuracy DESC, penalty, threshold) AS r FROM mk
              UNION ALL SELECT *, 'constrained', row_number() OVER (PARTITION BY config ORDER BY reader_priority_score DESC, overall_f1 DESC, unanswerable_accuracy DESC, penalty, threshold) FROM mk WHERE answerable_f1 >= best - 1.0)
        SELECT config, selection, CAST(penalty AS DOUBLE) AS penalty, CAST(threshold AS DOUBLE) AS threshold, overall_f1, reader_priority_score FROM a WHERE r = 1""",
    "ablation": _ABLATION,
    "quota_sample": f"""WITH {_ROWS}, k AS (SELECT *, {stable('seed-1', 'id', 'question')} AS key FROM rws),
        a AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS n FROM k WHERE is_answerable),
        sa AS (SELECT id, question, bucket, bucket AS stratum FROM a WHERE n <= CASE bucket WHEN 'en' THEN 30 WHEN 'de' THEN 10 WHEN 'fr' THEN 8 WHEN 'es' THEN 8 ELSE 0 END),
        b AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS n FROM k WHERE NOT is_answerable),
        sb AS (SELECT id, question, bucket, 'NO_ANSWER' AS stratum FROM b ORDER BY n, bucket LIMIT 12)
        SELECT id, bucket, stratum, {stable('seed-1:final', 'id', 'question')} AS order_key FROM (SELECT * FROM sa UNION ALL SELECT * FROM sb)""",
    "round_robin": f"""WITH {_ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY bucket, is_answerable ORDER BY {stable('seed-2', 'id')}) AS turn FROM rws),
        p AS (SELECT *, row_number() OVER (ORDER BY turn, bucket, is_answerable) AS position FROM k)
        SELECT id, bucket, is_answerable, CAST(turn AS INTEGER) AS turn, CAST(position AS INTEGER) AS position FROM p WHERE position <= 50""",
    "rebalance": f"""WITH a AS (SELECT doc_id, toxic = 1 AS flag, {stable('seed-3', 'doc_id')} AS key FROM labels)
        SELECT doc_id, flag FROM a WHERE flag UNION ALL
        SELECT doc_id, flag FROM (SELECT *, row_number() OVER (ORDER BY key) AS r FROM a WHERE NOT flag) WHERE r <= 2 * (SELECT count(*) FROM a WHERE flag)""",
    "ranking_counts": f"""WITH {PRED}, {CAND}, b AS (SELECT id, text, raw_text, ranking_score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ranking_score DESC, candidate_id) AS r
          FROM cand WHERE passes_reader_threshold) WHERE r = 1),
        x AS (SELECT is_answerable, {S.normalize_answer('gold_answer')} AS g, coalesce(b.text, '') AS p, {S.normalize_answer("coalesce(b.text, '')")} AS np,
          {S.normalize_answer('context')} AS c, {S.normalize_answer("coalesce(b.raw_text, '')")} AS s, b.raw_text IS NOT NULL AS has, coalesce(b.ranking_score, 0.0) AS score FROM pred LEFT JOIN b USING (id)),
        y AS (SELECT *, g <> '' AND has AND contains(s, g) AS holds, p <> '' AS answered FROM x),
        z AS (SELECT count(*) AS total, count(*) FILTER (is_answerable AND g <> '' AND contains(c, g)) AS gold_passage_available, count(*) FILTER (is_answerable AND holds) AS gold_passage_selected,
          count(*) FILTER (is_answerable AND has AND NOT holds) AS wrong_passage_selected, count(*) FILTER (NOT is_answerable AND NOT answered) AS no_answer_correctly_emitted,
          count(*) FILTER (NOT is_answerable AND answered) AS false_positive_answer_emitted, count(*) FILTER (answered AND g <> np AND score >= 0.7) AS high_score_wrong_answer FROM y)
        SELECT *, round(100.0 * high_score_wrong_answer / total, 6) AS high_score_wrong_answer_rate FROM z""",
}
