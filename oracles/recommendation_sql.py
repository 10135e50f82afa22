"""DuckDB twins of the recommendation queries."""

from askweave.functions import fixed
from oracles import sqltext as S
from oracles.evaluation_sql import CAND, PRED
from oracles.semantics_sql import FRAMED

_TOK = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"
_CONTENT = f"list_distinct(list_filter(string_split({S.fold_words('text')}, ' '), lambda t: length(t) > 1 AND t NOT IN {S.strs(fixed.FOLLOWUP_STOPWORDS)}))"

SQL = {
    "related_questions": f"""WITH kn AS (SELECT trim(text) AS text, min(conv_id * 1000 + turn) AS doc_id FROM conversations WHERE role = 'user' GROUP BY 1),
        dt AS (SELECT doc_id, {_TOK.format(x='text')} AS t FROM kn), dl AS (SELECT doc_id, len(t) AS dl FROM dt), st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl),
        post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM dt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
        i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st), idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
        qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK.format(x='text')}) AS term FROM benchmark) GROUP BY ALL),
        sc AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / av))), 6) AS score FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL HAVING score > 0),
        h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 13),
        seen AS (SELECT item_id, lower(trim(text)) AS k FROM benchmark UNION SELECT item_id, lower(text) FROM h JOIN kn USING (doc_id) WHERE rank = 1 AND item_id % 3 = 0),
        f AS (SELECT h.item_id, doc_id, row_number() OVER (PARTITION BY h.item_id ORDER BY rank) AS r FROM h JOIN kn USING (doc_id)
              WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.item_id = h.item_id AND s.k = lower(kn.text)))
        SELECT item_id, doc_id AS turn_id, CAST(r AS INTEGER) AS rank FROM f WHERE r <= 3""",
    "followup_rank": f"""WITH {PRED}, {CAND}, b AS (SELECT id AS question_id, candidate_id AS ordinal, reader_score AS a, relation_score AS nv, candidate_id % 3 AS grp,
          round(0.45 * reader_score + 0.25 * retrieval_score + 0.2 * relation_score, 6) AS base FROM cand),
        l AS (SELECT *, row_number() OVER (PARTITION BY question_id, grp ORDER BY base DESC, a DESC, nv DESC, ordinal) AS lead FROM b),
        s AS (SELECT *, round(base + CASE WHEN lead = 1 THEN 0.1 ELSE 0.0 END, 6) AS ranking_score FROM l),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY ranking_score DESC, a DESC, nv DESC, ordinal) AS INTEGER) AS rank FROM s)
        SELECT question_id, ordinal, ranking_score, rank FROM r WHERE rank <= 3""",
    "duplicate_questions": f"""WITH u AS (SELECT {S.fold_words('text')} AS norm, min(conv_id * 1000 + turn) AS id, min(text) AS text FROM conversations GROUP BY 1),
        w AS (SELECT id, {_CONTENT} AS w FROM u), p AS (SELECT a.id AS left, b.id AS right, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS n, len(b.w) AS m FROM w a JOIN w b ON a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0)
        SELECT "left", "right", round(c / (n + m - c), 6) AS similarity FROM p WHERE round(c / (n + m - c), 6) >= 0.6
        UNION ALL SELECT u.id, x.id, 1.0 FROM (SELECT {S.fold_words('text')} AS norm, conv_id * 1000 + turn AS id FROM conversations) x JOIN u USING (norm) WHERE norm <> '' AND x.id <> u.id""",
}

_STRIP, _WORD_STRIP = S.q(fixed.SUBJECT_STRIP.translate(str.maketrans("", "", "\t\r\n"))), S.q(fixed.SUBJECT_WORD_STRIP)


def _folded(x: str) -> str:
    return S.squeeze(S.fold_case(x))


def _folded_list(x: str) -> str:
    return f"list_transform({x}, lambda y: trim({_folded('y')}, {_WORD_STRIP}))"


def _clean(p: str, source: str, value: str) -> str:
    """Tables that end in ``p`` with a column ``p``: the cleaned subject of ``value``."""
    asking = " OR ".join(f"array_to_string({p}_f[i:i + {len(a.split()) - 1}], ' ') = {S.q(a)}" for a in fixed.ASKING_WORDS)
    content = f"list_filter({S.words(S.fold_case(p + '_s'))}, lambda t: length(t) > 1 AND t NOT IN {S.strs(fixed.FOLLOWUP_STOPWORDS)})"
    return f"""{p}1 AS (SELECT *, trim({S.squeeze(f"coalesce({value}, '')")}, {_STRIP}) AS {p}_t FROM {source}),
        {p}2 AS (SELECT *, string_split({p}_t, ' ') AS {p}_w FROM {p}1), {p}3 AS (SELECT *, {_folded_list(p + '_w')} AS {p}_f FROM {p}2),
        {p}4 AS (SELECT *, coalesce(list_min(list_filter(range(1, len({p}_w) + 1), lambda i: {asking})), len({p}_w) + 1) AS {p}_c FROM {p}3),
        {p}5 AS (SELECT *, trim(array_to_string({p}_w[1:{p}_c - 1], ' '), {_STRIP}) AS {p}_s FROM {p}4),
        {p} AS (SELECT *, CASE WHEN {p}_s <> '' AND length({p}_s) <= {fixed.SUBJECT_MOST} AND {_folded(p + '_s')} NOT IN {S.strs(fixed.WEAK_SUBJECTS)} AND len({content}) > 0 THEN {p}_s END AS {p} FROM {p}5)"""


_FORMS = " ".join(f"WHEN regexp_matches(g, {S.q(x)}) THEN regexp_extract(g, {S.q(x)}, 1)" for x in fixed.SUBJECT_PATTERNS)
SQL["subject_focus"] = f"""WITH {FRAMED}, ph AS (SELECT id, array_to_string(string_split(question, ' ')[1:1 + id % 9], ' ') AS phrase FROM fq),
    a0 AS (SELECT id, replace(['{{}} là ai?', 'Vai trò của {{}}', '{{}} sinh năm nào?', 'Vì sao {{}} xảy ra?', '{{}}'][id % 5 + 1], '{{}}', phrase) AS asked FROM ph),
    a1 AS (SELECT *, trim({_folded("asked")}, ' ?!.,;:') AS g FROM a0), a2 AS (SELECT *, CASE {_FORMS} END AS form FROM a1),
    {_clean("one", "a2", "asked")}, r0 AS (SELECT *, array_to_string(string_split(one, ' ')[4:], ' ') AS rest FROM one), {_clean("two", "r0", "rest")}, {_clean("inf", "two", "form")}
    SELECT id, CASE WHEN one IS NULL THEN NULL WHEN array_to_string({_folded_list("string_split(one, ' ')[1:3]")}, ' ') IN {S.strs(fixed.FOCUS_FRAMES)} THEN coalesce(two, one) ELSE one END AS focus,
      CASE WHEN form IS NOT NULL THEN inf END AS inferred FROM inf"""
