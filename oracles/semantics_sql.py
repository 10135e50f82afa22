"""DuckDB twins of the question, gate and span queries."""

from askweave.functions import fixed
from oracles import sqltext as S
from oracles.evaluation_sql import CAND, PRED

_FRAMES = [
    ("Vì sao ", " phát triển mạnh?"), ("", " sinh vào năm nào?"), ("", " nằm ở đâu?"), ("", " là ai?"), ("", " là gì?"),
    ("", " được xây dựng để làm gì?"), ("So với ", " thì có gì khác nhau?"), ("Đặc điểm của ", " ra sao?"),
    ("", " có bao nhiêu người?"), ("Điều gì dẫn tới việc ", " suy giảm?"), ("Tên gọi khác của ", " là gì?"),
    ("", " diễn ra ở đâu?"), ("", " qua đời năm nào?"), ("", " bằng cách nào?"), ("Nguyên nhân nào khiến ", " nổi tiếng?"), ("", ""),
]
_HEADS = "[" + ", ".join(S.q(h) for h, _ in _FRAMES) + "]"
_TAILS = "[" + ", ".join(S.q(t) for _, t in _FRAMES) + "]"
FRAMED = f"""fq AS (SELECT conv_id * 1000 + turn AS id, {_HEADS}[(conv_id + turn) % 16 + 1] || {S.squeeze('text')}
    || {_TAILS}[(conv_id + turn) % 16 + 1] AS question FROM conversations WHERE role = 'user'), fw AS (SELECT id, {S.fold_words('question')} AS f FROM fq)"""

LINES = f"""ch AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) - 1 AS i FROM documents),
  cl AS (SELECT *, regexp_matches(c, '{S.WS}') AS blank, sum(CASE WHEN c = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM ch)"""


def has(pattern: str) -> str:
    return f"regexp_matches(f, {S.q(pattern)})"


_TYPES = "CASE WHEN " + has(fixed.CAUSE_TYPE_PATTERN) + " THEN 'GENERAL' ELSE coalesce(nullif(concat_ws(',', " + ", ".join(
    f"CASE WHEN {has('|'.join(ps))} THEN '{t}' END" for t, ps in fixed.TYPE_PATTERNS.items()) + "), ''), 'GENERAL') END"
_COARSE = "CASE " + " ".join(
    f"WHEN {has(p)}" + (" OR types LIKE '%DEFINITION%'" if r == "DEFINITION" else "") + f" THEN '{r}'" for r, p in fixed.COARSE_RELATIONS) + " ELSE 'FACTOID' END"
_WEAK = "CASE " + " ".join(f"WHEN {has(p)} THEN '{b}'" for b, p in fixed.WEAK_BUCKETS) + " ELSE 'GENERAL' END"
_DANGLING = r"(?:^|[\s,;:])(?:" + "|".join(fixed.DANGLING_CONNECTORS) + r")\s*$"


def completeness(x: str) -> str:
    t = S.strip(x)
    return (f"CASE WHEN {t} = '' THEN 0.0 ELSE least(CASE WHEN length({t}) - length(replace({t}, '(', '')) <> length({t}) - length(replace({t}, ')', '')) THEN 0.15 ELSE 1.0 END, "
            f"CASE WHEN regexp_matches({S.fold_keep(t)}, '{_DANGLING}') THEN 0.10 ELSE 1.0 END) END")


_REL = [p[0] for p in fixed.RELATION_POLICIES]
_POL = ", ".join(f"('{n}', {s}, {r}, {a}, {b}, {y})" for n, s, r, a, b, y in fixed.RELATION_POLICIES)
_MET = ", ".join(f"('{m}', {p}, {t}, '{f}')" for m, p, t, f in fixed.METHOD_POLICIES)
_SIGNAL = "reader_score * {pen} * (0.5 + 0.5 * boundary_score) * (0.5 + 0.5 * completeness_score)"
GATES = f"""WITH {PRED}, {CAND},
  g0 AS (SELECT * EXCLUDE (method, relation_type), candidate_id AS c, {[*_REL, 'OTHER']}[id % {len(_REL) + 1} + 1] AS rel, id // 2 AS question_id, id AS passage_id,
    CASE WHEN candidate_id % 3 = 0 THEN 'sentence_fallback' WHEN candidate_id % 3 = 1 THEN 'phrase_fallback' ELSE 'neural_span' END AS method,
    CASE WHEN candidate_id % 8 = 0 THEN 'TIME_SUBJECT_MISMATCH' WHEN candidate_id % 8 = 1 THEN 'RELATION_MISMATCH' END AS rr FROM cand),
  pol(prel, rs, rrq, ms, mr, byp) AS (VALUES {_POL}), met(m, penalty, mt, tf) AS (VALUES {_MET}),
  g1 AS (SELECT *, coalesce(rs, true) AS s_req, coalesce(rrq, true) AS r_req, coalesce(ms, 0.5) AS s_min, coalesce(mr, 0.5) AS r_min, coalesce(byp, false) AS bypass
         FROM g0 LEFT JOIN pol ON prel = rel LEFT JOIN met ON m = method),
  g2 AS (SELECT *, round(0.3 * retrieval_score + 0.6 * {_SIGNAL.format(pen='penalty')} + 0.1 * answer_type_score, 6) AS ranking,
    valid_span AS gate_span, boundary_score >= 0.2 AS gate_boundary, c % 6 <> 0 AND completeness_score >= 0.5 AS gate_completeness, c % 7 <> 0 AND evidence_score >= 0.5 AS gate_evidence,
    NOT s_req OR (c % 5 <> 0 AND subject_match_score >= s_min) AS gate_subject, true AS gate_relation, answer_type_score >= greatest(0.5, mt) AS gate_answer_type,
    c % 4 <> 0 AND relation_score >= r_min AS rel_ok FROM g1),
  g3 AS (SELECT * EXCLUDE (ranking_score), ranking AS ranking_score, ranking >= 0.6 OR (bypass AND gate_evidence AND gate_subject AND gate_relation AND gate_answer_type) AS gate_ranking FROM g2),
  ga AS (SELECT *, CASE WHEN NOT gate_span THEN 'NO_VALID_SPAN' WHEN NOT gate_boundary THEN 'SPAN_BOUNDARY_INCOMPLETE'
      WHEN NOT gate_completeness THEN CASE WHEN c % 12 = 0 THEN 'DANGLING_CONNECTOR' ELSE 'INCOMPLETE_RELATION' END WHEN NOT gate_evidence THEN 'EVIDENCE_UNSUPPORTED'
      WHEN NOT gate_subject THEN CASE WHEN rr LIKE '%SUBJECT_MISMATCH%' THEN rr ELSE 'SUBJECT_MISMATCH' END WHEN NOT gate_answer_type THEN tf
      WHEN NOT gate_ranking THEN 'LOW_RANKING_SCORE' END AS rejection_reason, CASE WHEN NOT rel_ok THEN coalesce(rr, 'RELATION_UNSUPPORTED') END AS relation_warning FROM g3)"""
_PRIO = "CASE " + " ".join(f"WHEN rejection_reason IN {S.strs(n)} THEN {p}" for p, n in fixed.DEBUG_PRIORITY) + " ELSE 0 END"

FEATURES = """fe AS (SELECT vec_id AS feature, vec_id // 2 AS sample, CAST(embedding[1:32] AS DOUBLE[]) AS sl, CAST(embedding[33:64] AS DOUBLE[]) AS el FROM embeddings),
  a AS (SELECT * FROM (SELECT feature, sample, i, v, row_number() OVER (PARTITION BY feature ORDER BY v DESC, i DESC) AS r FROM (SELECT feature, sample, unnest(sl) AS v, unnest(range(0, 32)) AS i FROM fe)) WHERE r <= 20),
  b AS (SELECT * FROM (SELECT feature, i, v, row_number() OVER (PARTITION BY feature ORDER BY v DESC, i DESC) AS r FROM (SELECT feature, unnest(el) AS v, unnest(range(0, 32)) AS i FROM fe)) WHERE r <= 20),
  sp AS (SELECT a.feature, a.sample, a.i * 5 AS s, b.i * 5 + 4 AS e, max(a.v + b.v) AS score FROM a JOIN b ON a.feature = b.feature AND b.i >= a.i AND b.i - a.i + 1 <= 8 AND a.i >= 4 AND b.i >= 4 GROUP BY ALL)"""


def _best(key: str, limit: int, source: str = "sp") -> str:
    return (f"SELECT {key}, s AS start_char, e AS end_char, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY score DESC, s, e) AS r FROM (SELECT {key}, s, e, max(score) AS score FROM {source} GROUP BY ALL)) WHERE r <= {limit}")


LOCATION = f"""WITH {PRED}, {CAND}, {FRAMED}, lc AS (SELECT id, candidate_id, ranking_score, relation_score, passes_reader_threshold,
    CASE WHEN candidate_id % 5 < 3 THEN 'sentence_fallback' ELSE 'neural_span' END AS m,
    CASE candidate_id % 5 WHEN 0 THEN 'whole_sentence' WHEN 1 THEN 'location_pattern' END AS fm FROM cand),
  lb AS (SELECT * FROM lc WHERE passes_reader_threshold AND ranking_score > 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ranking_score DESC, candidate_id) = 1),
  la AS (SELECT pred.id, is_answerable AS yes, coalesce(predicted_answer, '') <> '' AS said, lb.m, coalesce(lb.fm, 'whole_sentence') = 'whole_sentence' AS whole, lb.relation_score AS rel,
    lb.m IS NOT NULL AS chosen, {S.normalize_answer("CASE WHEN is_answerable THEN gold_answer ELSE '' END")} = {S.normalize_answer('predicted_answer')} AS ok,
    EXISTS (SELECT 1 FROM lc WHERE lc.id = pred.id AND lc.m = 'sentence_fallback' AND coalesce(lc.fm, 'whole_sentence') = 'whole_sentence') AS broad
    FROM pred JOIN fw USING (id) LEFT JOIN lb USING (id) WHERE string_split({_TYPES}, ',')[1] = 'LOCATION')"""

SQL = {
    "question_types": f"WITH {FRAMED}, t AS (SELECT *, {_TYPES} AS types FROM fw) SELECT id, types, {_COARSE} AS coarse_relation, {_WEAK} AS weak_bucket FROM t",
    "answer_completeness": f"WITH {PRED} SELECT id, CAST({completeness('predicted_answer')} AS DOUBLE) AS score, CAST({completeness('context')} AS DOUBLE) AS context_score FROM pred",
    "gate_chain": GATES + " SELECT candidate_id, ranking_score, " + ", ".join(f"gate_{g}" for g in fixed.GATE_ORDER) + ", rejection_reason, relation_warning FROM ga",
    "select_answer": GATES + """ SELECT question_id, candidate_id, ranking_score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ranking_score DESC, evidence_score DESC,
        reader_score DESC, candidate_id) AS r FROM ga WHERE rejection_reason IS NULL) WHERE r = 1""",
    "representatives": GATES + f""" SELECT question_id, passage_id, candidate_id, rejection_reason FROM (SELECT *, row_number() OVER (PARTITION BY question_id, passage_id
        ORDER BY rejection_reason IS NULL DESC, {_PRIO} DESC, ranking_score DESC, evidence_score DESC, reader_score DESC, candidate_id) AS r FROM ga) WHERE r = 1""",
    "merged_spans": GATES + """ SELECT question_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, candidate_id % 3 ORDER BY ranking_score DESC, reader_score DESC, candidate_id) AS r FROM ga) WHERE r = 1""",
    "ranking_combine": f"""WITH {PRED}, {CAND} SELECT candidate_id, round(0.3 * retrieval_score + 0.6 * {_SIGNAL.format(pen='fallback_penalty')} + 0.1 * answer_type_score, 6) AS score,
        round(0.4 * retrieval_score + 0.3 * reader_score + 0.2 * answer_type_score + 0.1 * relation_score, 6) AS plain FROM cand""",
    "span_decode": f"WITH {FEATURES} " + _best("feature", 5),
    "no_answer_margin": f"""WITH {FEATURES}, n AS (SELECT sample, min(sl[1] + el[1]) AS nul FROM fe GROUP BY sample), t AS (SELECT sample, max(score) AS best FROM sp GROUP BY sample)
        SELECT sample, round(nul, 6) AS null_score, round(coalesce(best - nul, CAST('-inf' AS DOUBLE)), 6) AS score_margin, best IS NOT NULL AND best - nul >= 0.5 AS has_answer,
          round(CASE WHEN best IS NULL THEN 0.0 ELSE 1.0 / (1.0 + exp(-(best - nul - 0.5) / 10.0)) END, 6) AS confidence FROM n LEFT JOIN t USING (sample)""",
    "window_slices": f"""WITH w AS (SELECT doc_id, len(string_split({S.squeeze('text')}, ' ')) AS n, 256 - doc_id % 20 - 4 AS room FROM documents),
        x AS (SELECT doc_id, n, room, unnest(range(0, CASE WHEN n <= room THEN 1 ELSE CAST(1 + ceil((n - room) / (room - 80)) AS BIGINT) END)) AS k FROM w)
        SELECT doc_id, CAST(k AS INTEGER) AS "window", CAST(k * (room - 80) AS INTEGER) AS window_start, CAST(least(k * (room - 80) + room, n) AS INTEGER) AS window_end FROM x""",
    "span_integrity": f"""WITH {PRED}, i AS (SELECT id % 3 AS split, context AS c, gold_answer AS a, CASE WHEN is_answerable THEN CASE WHEN id % 4 = 0 THEN 0 ELSE instr(context, gold_answer) - 1 + id % 2 END END AS s FROM pred),
        f AS (SELECT *, coalesce(s, -1) >= 0 AND a <> '' AS y, substr(c, s + 1, length(a)) = a AS ex, instr(c, a) - 1 AS fo FROM i)
        SELECT split, count(*) AS total_rows, count(*) FILTER (y) AS answerable, count(*) FILTER (y AND ex) AS valid, count(*) FILTER (y AND s + length(a) > length(c)) AS outside_context,
          count(*) FILTER (y AND NOT ex AND fo < 0) AS not_in_context, count(*) FILTER (y AND NOT ex AND fo >= 0) AS shifted, count(*) FILTER (y AND fo >= 0) AS first_match, count(*) FILTER (y AND fo = s) AS first_match_exact,
          CASE WHEN count(*) FILTER (y) > 0 THEN round(100.0 * count(*) FILTER (y AND ex) / count(*) FILTER (y), 6) ELSE 0.0 END AS accuracy FROM f GROUP BY split""",
    "window_merge": f"WITH {FEATURES} " + _best("sample", 3),
    "fallback_errors": GATES + """, fr AS (SELECT question_id, question_id % 5 <> 0 AS is_answerable, question_id % 7 = 0 AS has_answer, ty AS gold_in_passage,
          method = 'sentence_fallback' AS fb, CASE WHEN c % 9 = 0 THEN 'temporal_expression_pattern' ELSE 'whole_sentence' END = 'whole_sentence' AS whole, rejection_reason,
          c % 4 = 0 AS gold_in_fallback, c % 8 = 0 AS neural_exact FROM ga),
        fq AS (SELECT question_id, bool_or(fb) AND coalesce(bool_and(whole) FILTER (fb), true) AS a, bool_or(fb AND coalesce(rejection_reason, '') = 'INSUFFICIENT_FALLBACK_EVIDENCE') AS b,
          bool_or(fb AND whole) AS w, bool_or(gold_in_fallback AND NOT neural_exact) AS d FROM fr WHERE is_answerable AND NOT has_answer AND gold_in_passage GROUP BY question_id)
        SELECT error, count(*) AS "count" FROM (SELECT 'FALLBACK_PHRASE_NOT_EXTRACTED' AS error FROM fq WHERE a UNION ALL SELECT 'FALLBACK_TYPE_GATE_FALSE_NEGATIVE' FROM fq WHERE b
          UNION ALL SELECT 'FALLBACK_WHOLE_SENTENCE_TOO_BROAD' FROM fq WHERE w UNION ALL SELECT 'NEURAL_SPAN_WRONG_FALLBACK_CORRECT' FROM fq WHERE d) GROUP BY error""",
    "char_span_tokens": f"""WITH {PRED}, tk AS (SELECT id, context, regexp_extract_all(context, '[^\\s\\p{{Z}}]+[\\s\\p{{Z}}]*') AS ws FROM pred),
        ps AS (SELECT id, ws, CAST(unnest(range(1, len(ws) + 1)) AS INTEGER) AS i FROM tk),
        pl AS (SELECT id, i, coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0) AS s, length(regexp_replace(ws[i], '[\\s\\p{{Z}}]+$', '')) AS n FROM ps),
        ld AS (SELECT id, length(context) - length(regexp_replace(context, '^[\\s\\p{{Z}}]+', '')) AS lead FROM pred),
        o AS (SELECT pl.id, i, s + lead AS s, s + lead + n AS e FROM pl JOIN ld USING (id)),
        g AS (SELECT id, count(*) AS n_tokens, min(s) AS lo, max(e) AS hi, count(*) FILTER (s <= id % 40) - 1 AS st, count(*) FILTER (e < id % 40 + 25) AS en FROM o GROUP BY id)
        SELECT id, CAST(n_tokens AS INTEGER) AS n_tokens, CAST(CASE WHEN id % 40 >= lo AND id % 40 + 25 <= hi THEN st ELSE 0 END AS INTEGER) AS start_token,
          CAST(CASE WHEN id % 40 >= lo AND id % 40 + 25 <= hi THEN en ELSE 0 END AS INTEGER) AS end_token FROM g""",
    "line_alignment": f"""WITH {LINES}, sp AS (SELECT doc_id, line, min(i) AS s, max(i) + 1 AS e FROM cl WHERE NOT blank GROUP BY ALL),
        md AS (SELECT doc_id, regexp_replace({S.squeeze('text')}, '([^ ]+) ([^ ]+)', '\\1_\\2', 'g') AS model FROM documents),
        mc AS (SELECT doc_id, unnest(regexp_extract_all(model, '(?s).')) AS c, generate_subscripts(regexp_extract_all(model, '(?s).'), 1) - 1 AS i FROM md),
        rk AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cl WHERE NOT blank AND c <> '_'),
        mk AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mc WHERE NOT regexp_matches(c, '{S.WS}') AND c <> '_'),
        b AS (SELECT rk.doc_id, line, min(rk.i) AS bs, max(rk.i) + 1 AS be, min(mk.i) AS ms, max(mk.i) + 1 AS me FROM rk LEFT JOIN mk USING (doc_id, k) GROUP BY ALL)
        SELECT doc_id, true AS aligned, CAST(s AS INTEGER) AS raw_start, CAST(e AS INTEGER) AS raw_end, CAST(coalesce(ms, -1) AS INTEGER) AS model_start,
          CAST(coalesce(me, -1) AS INTEGER) AS model_end, CAST(coalesce(bs, -1) AS INTEGER) AS back_start, CAST(coalesce(be, -1) AS INTEGER) AS back_end
        FROM sp LEFT JOIN b USING (doc_id, line)""",
    "window_integrity": f"""WITH {LINES}, cp AS (SELECT *, lag(blank, 1, true) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM cl),
        tk AS (SELECT *, sum(CASE WHEN before AND NOT blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS tok FROM cp),
        n AS (SELECT doc_id, max(tok) + 1 AS total FROM tk GROUP BY 1),
        sp AS (SELECT doc_id, line, min(i) AS s, max(i) + 1 AS e, min(tok) AS first, max(tok) AS last, arg_max(c, i) IN ('.', '!', '?') AND max(i) > min(i) AS cut FROM tk WHERE NOT blank GROUP BY ALL),
        w AS (SELECT *, least(CASE WHEN total <= 240 THEN 0 ELSE CAST(ceil((total - 240) / 160.0) AS BIGINT) END, CAST(first AS BIGINT) // 160) AS latest FROM sp JOIN n USING (doc_id)),
        v AS (SELECT *, last - first + 1 AS size, last < least(latest * 160 + 240, total) AS held FROM w)
        SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(CASE WHEN cut THEN e - 1 ELSE e END AS INTEGER) AS "end", CAST(size AS INTEGER) AS n_tokens, held AS covered,
          CASE WHEN held AND NOT cut THEN NULL WHEN size > 240 THEN 'ANSWER_EXCEEDS_WINDOW' WHEN size > 80 THEN 'ANSWER_LONGER_THAN_STRIDE'
            WHEN held THEN 'TOKENIZER_BOUNDARY' ELSE 'CHUNK_OR_TOKENIZER_MAPPING' END AS reason FROM v""",
    "location_errors": LOCATION + """ SELECT id AS question_id, 'LOCATION_PROPER_NOUN_FALSE_POSITIVE' AS error FROM la WHERE chosen AND rel > 0.3 AND NOT ok
        UNION ALL SELECT id, 'LOCATION_RELATION_MISMATCH' FROM la WHERE chosen AND NOT coalesce(rel > 0.6, false)
        UNION ALL SELECT id, 'LOCATION_WHOLE_SENTENCE_TOO_BROAD' FROM la WHERE chosen AND whole
        UNION ALL SELECT id, 'LOCATION_PHRASE_NOT_EXTRACTED' FROM la WHERE NOT chosen AND broad UNION ALL SELECT id, 'LOCATION_FALSE_NEGATIVE' FROM la WHERE yes AND NOT said""",
    "location_counters": LOCATION + """ SELECT count(*) AS count, count(*) FILTER (ok) AS correct, count(*) FILTER (said AND NOT ok) AS wrong_location, count(*) FILTER (NOT said) AS no_answer,
        count(*) FILTER (NOT yes AND said) AS false_positive, count(*) FILTER (yes AND NOT said) AS false_negative,
        count(*) FILTER (m = 'sentence_fallback' AND whole) AS whole_sentence_accepted, count(*) FILTER (m = 'sentence_fallback' AND NOT whole) AS phrase_accepted FROM la""",
}
