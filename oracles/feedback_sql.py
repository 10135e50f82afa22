"""DuckDB twins of the feedback queries."""

from oracles import sqltext as S

LOG = """
  k0 AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
  lg0 AS (SELECT event_id AS feedback_id, ts AS timestamp, 'Question ' || (user_id % 40) AS question, 'answer ' || (k % 5) AS predicted_answer,
    CASE event_type WHEN 'click' THEN 'CORRECT' WHEN 'error' THEN 'INCORRECT' WHEN 'view' THEN 'NO_ANSWER_BUT_SHOULD_HAVE' WHEN 'purchase' THEN 'SPAN_CORRECTION' ELSE 'ANSWERED_BUT_SHOULD_NOT' END AS feedback_type,
    ['TIME', 'PERSON', 'LOCATION', ''][user_id % 4 + 1] AS question_type, ['CAUSE', 'EVENT_TIME', NULL][user_id % 3 + 1] AS semantic_relation,
    CASE WHEN k % 3 <> 0 THEN CAST(k % 20 AS VARCHAR) END AS selected_passage_id, CASE WHEN event_type = 'purchase' THEN CAST(k % 7 AS VARCHAR) END AS corrected_passage_id,
    CASE WHEN event_type = 'purchase' THEN 'span ' || (k % 3) END AS corrected_answer, CASE WHEN event_type = 'purchase' THEN k % 3 END AS cs, CASE WHEN event_type = 'purchase' THEN k % 3 + 6 END AS ce,
    CASE WHEN k % 4 <> 0 THEN [CAST(k % 7 AS VARCHAR), CAST(k % 20 AS VARCHAR)] END AS retrieved, CASE WHEN k % 6 = 0 THEN 'REASON_' || (k % 17) END AS rejection_reason,
    CASE WHEN k % 10 = 0 THEN false END AS support, ['PENDING', 'APPROVED', 'REJECTED', 'REVIEWED'][event_id % 4 + 1] AS status, value < 5 AS synthetic FROM k0),
  lg AS (SELECT *, CASE WHEN feedback_type = 'CORRECT' THEN NULL WHEN support = false THEN 'CORPUS_GAP' WHEN corrected_passage_id IS NOT NULL AND retrieved IS NULL THEN 'UNKNOWN_GAP'
    WHEN corrected_passage_id IS NOT NULL AND list_contains(retrieved, corrected_passage_id) THEN 'READER_SEMANTIC_GAP' WHEN corrected_passage_id IS NOT NULL THEN 'RETRIEVAL_GAP'
    WHEN selected_passage_id IS NOT NULL AND (feedback_type IN ('INCORRECT', 'ANSWERED_BUT_SHOULD_NOT') OR rejection_reason IS NOT NULL) THEN 'READER_SEMANTIC_GAP' ELSE 'UNKNOWN_GAP' END AS gap_type FROM lg0)"""

_PARTS = ", ".join(f"coalesce(lower(CAST({c} AS VARCHAR)), '')" for c in
                   ("question", "predicted_answer", "feedback_type", "corrected_passage_id", "corrected_answer", "cs", "ce"))
STORE = LOG + f""",
  fp AS (SELECT *, sha256(concat_ws('␟', {_PARTS})) AS fingerprint FROM lg),
  st AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY timestamp, feedback_id) AS r,
         count(*) OVER (PARTITION BY fingerprint) AS w, max(timestamp) OVER (PARTITION BY fingerprint) AS last_seen FROM fp) WHERE r = 1)"""

_NO = "feedback_type IN ('NO_ANSWER_BUT_SHOULD_HAVE', 'ANSWERED_BUT_SHOULD_NOT')"


def _w(cond: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {cond} THEN w ELSE 0 END), 0) AS BIGINT)"


def _label(c: str) -> str:
    return f"coalesce(nullif({c}, ''), 'UNKNOWN')"


def _buckets(c: str) -> str:
    ok = "feedback_type = 'CORRECT'"
    return f"""WITH {STORE}, b AS (SELECT {_label(c)} AS {c}, CAST(sum(w) AS BIGINT) AS total, {_w(ok)} AS correct,
      {_w(f"NOT ({ok}) AND NOT {_NO}")} AS incorrect, {_w(_NO)} AS no_answer FROM st GROUP BY 1)
      SELECT *, round((incorrect + no_answer) / total, 6) AS failure_rate, round((incorrect + no_answer) / total * ln(1 + total), 6) AS blind_spot_score FROM b"""


def _trend(source: str, w: str) -> str:
    def t(cond):
        return f"CAST(sum(CASE WHEN {cond} THEN {w} ELSE 0 END) AS BIGINT)"
    ok = "feedback_type = 'CORRECT'"
    return f"""SELECT strftime(timestamp, '%Y-%m-%d') AS date, CAST(sum({w}) AS BIGINT) AS total, {t(ok)} AS correct, {t(f'NOT ({ok})')} AS incorrect,
      {t(_NO)} AS no_answer FROM {source} GROUP BY 1"""


def _top(c: str, limit: str = "") -> str:
    return f"WITH {STORE} SELECT {c}, CAST(sum(w) AS BIGINT) AS count FROM st WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count DESC, {c} {limit}"


_OK = "feedback_type = 'CORRECT'"
SQL = {
    "fb_dedup": f"WITH {STORE} SELECT feedback_id, fingerprint, w AS duplicate_count, timestamp, last_seen, status FROM st",
    "fb_conflicts": f"""WITH {STORE} SELECT feedback_id, a.corrected_answer IS NOT NULL AND EXISTS (SELECT 1 FROM st b WHERE b.question = a.question AND b.corrected_passage_id = a.corrected_passage_id
        AND b.feedback_id <> a.feedback_id AND b.corrected_answer IS NOT NULL AND (b.cs <> a.cs OR b.ce <> a.ce OR b.corrected_answer <> a.corrected_answer) AND b.status <> 'REJECTED') AS conflict FROM st a""",
    "gap_classify": f"WITH {LOG} SELECT feedback_type, gap_type, count(*) AS count FROM lg GROUP BY ALL",
    "fb_summary": f"""WITH {STORE}, s AS (SELECT CAST(sum(w) AS BIGINT) AS total_feedback, count(*) AS unique_records, {_w(_OK)} AS correct, {_w(_NO)} AS no_answer_complaints,
        count(*) FILTER (status = 'PENDING') AS pending_review, {_w('NOT synthetic')} AS real_feedback FROM st)
        SELECT *, total_feedback - correct AS incorrect, total_feedback - real_feedback AS synthetic_feedback, round(correct / total_feedback, 6) AS correct_rate,
          round((total_feedback - correct) / total_feedback, 6) AS incorrect_rate, round(no_answer_complaints / total_feedback, 6) AS no_answer_complaint_rate FROM s""",
    "fb_buckets": _buckets("semantic_relation"),
    "fb_buckets_type": _buckets("question_type"),
    "fb_trend": f"WITH {STORE} " + _trend("st", "w"),
    "fb_heatmap": f"""WITH {STORE}, c AS (SELECT {_label('question_type')} AS question_type, {_label('semantic_relation')} AS relation, CAST(sum(w) AS BIGINT) AS total,
        {_w(f'NOT ({_OK})')} AS failures FROM st GROUP BY 1, 2) SELECT *, round(failures / total, 6) AS failure_rate, round(failures / total * ln(1 + total), 6) AS blind_spot_score FROM c""",
    "fb_top_reasons": _top("rejection_reason", "LIMIT 12"),
    "fb_gap_types": _top("gap_type"),
    "fb_review_latest": f"""WITH {LOG}, rv AS (SELECT event_id // 2 AS feedback_id, ts AS reviewed_at, ['APPROVED', 'REJECTED', 'REVIEWED', 'BOGUS'][user_id % 4 + 1] AS decision, event_type AS note FROM events),
        la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feedback_id ORDER BY reviewed_at DESC) AS r FROM rv WHERE decision <> 'BOGUS') WHERE r = 1)
        SELECT lg.feedback_id, coalesce(la.decision, lg.status) AS status, la.note AS review_note FROM lg LEFT JOIN la USING (feedback_id)""",
    "fb_export": f"""WITH {STORE} SELECT feedback_id, question, md5(text) AS context_md5, corrected_answer AS answer_text, cs AS answer_start, 'human_feedback' AS source
        FROM st JOIN documents ON CAST(doc_id AS VARCHAR) = corrected_passage_id WHERE status = 'APPROVED' AND corrected_answer IS NOT NULL""",
    "fb_review_view": f"""WITH {STORE} SELECT feedback_id, coalesce(corrected_passage_id, selected_passage_id) AS shown_passage_id, length(text) AS passage_chars
        FROM st LEFT JOIN documents ON CAST(doc_id AS VARCHAR) = coalesce(corrected_passage_id, selected_passage_id)""",
    "fb_validate": f"""WITH {LOG}, j AS (SELECT lg.*, t.text AS body FROM lg LEFT JOIN documents t ON corrected_answer IS NOT NULL AND CAST(t.doc_id AS VARCHAR) = corrected_passage_id),
        e AS (SELECT CASE WHEN selected_passage_id IS NOT NULL AND selected_passage_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) THEN 'no such passage: ' || selected_passage_id
          WHEN corrected_answer IS NOT NULL AND body IS NULL THEN 'no such passage: ' || corrected_passage_id
          WHEN corrected_answer IS NOT NULL AND ce > length(body) THEN 'the offsets lie outside the passage'
          WHEN corrected_answer IS NOT NULL AND lower({S.squeeze('substr(body, cs + 1, ce - cs)')}) <> corrected_answer THEN 'the answer is not the passage''s text at the offsets' ELSE 'ok' END AS result FROM j)
        SELECT result, count(*) AS count FROM e GROUP BY result""",
    "fb_trend_stream": f"WITH {LOG} " + _trend("lg", "1"),
    "fb_status_counts": f"WITH {STORE} SELECT status, count(*) AS rows, CAST(sum(w) AS BIGINT) AS submissions FROM st GROUP BY status",
}
