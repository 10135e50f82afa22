"""DuckDB twins of the text and corpus queries."""

from askweave.functions import fixed
from oracles import sqltext as S
from oracles.sqltext import q

_CLASS = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{words})(?:$|[^\\p{{L}}\\p{{N}}_])') THEN {q(name)}"
    for name, words in fixed.QUESTION_CLASSES
) + f" ELSE {q(fixed.QUESTION_CLASS_OTHER)} END"

_MAX, _OVER = fixed.CHUNK_MAX_TOKENS, fixed.CHUNK_OVERLAP_SENTENCES


def nfkc_feedback(x: str) -> str:
    return S.casefold(S.squeeze(S.nfc(f"CAST({x} AS VARCHAR)")))


_PIECES = f"""
WITH RECURSIVE paragraphs AS (
  SELECT doc_id, CAST(pos - 1 AS INTEGER) AS par, p FROM (
    SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{S.WS}*\\n+'), lambda x: {S.strip('x')}),
                                 lambda x: x <> '') AS ps FROM documents))),
sentences AS (SELECT doc_id, par, {S.split_sentences('p')} AS ss FROM paragraphs),
offsets AS (SELECT doc_id, par, len(ss) AS n, sum(len(ss)) OVER (PARTITION BY doc_id ORDER BY par) - len(ss) AS off FROM sentences),
sent AS (SELECT doc_id, par, pos, s FROM (SELECT doc_id, par, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM sentences)),
pieces0 AS (
  SELECT doc_id, par, pos, CASE WHEN {S.count_words('s')} <= {_MAX} THEN [s] ELSE (
    SELECT CASE WHEN len(cl) > 1 AND list_bool_and(list_transform(cl, lambda c: {S.count_words('c')} <= {_MAX})) THEN cl
      ELSE list_transform(range(0, len(w), {_MAX}), lambda i: array_to_string(w[i + 1:i + {_MAX}], ' ')) END
    FROM (SELECT list_filter(list_transform(string_split(regexp_replace(s, '([;:,]){S.WS}+', '\\1' || chr(31), 'g'), chr(31)),
                   lambda c: {S.strip('c')}), lambda c: c <> '') AS cl, regexp_split_to_array({S.strip('s')}, '{S.WS}+') AS w)) END AS ps
  FROM sent),
pieces1 AS (SELECT doc_id, par, pos, unnest(ps) AS piece, generate_subscripts(ps, 1) AS sub FROM pieces0),
pieces AS (SELECT doc_id, par, piece, CAST(row_number() OVER w - 1 AS INTEGER) AS i,
                  sum({S.count_words('piece')}) OVER w AS total, {S.count_words('piece')} AS words,
                  count(*) OVER (PARTITION BY doc_id, par) AS n
           FROM pieces1 WINDOW w AS (PARTITION BY doc_id, par ORDER BY pos, sub ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT a.doc_id, a.par, a.i, a.n, greatest(a.i + 1, max(CASE WHEN b.total - (a.total - a.words) <= {_MAX} THEN b.i + 1 ELSE 0 END)) AS e
         FROM pieces a JOIN pieces b ON a.doc_id = b.doc_id AND a.par = b.par AND b.i >= a.i GROUP BY a.doc_id, a.par, a.i, a.n),
chain AS (
  SELECT doc_id, par, i, e, n FROM ends WHERE i = 0
  UNION ALL
  SELECT x.doc_id, x.par, x.i, x.e, x.n FROM chain c JOIN ends x
    ON x.doc_id = c.doc_id AND x.par = c.par AND c.e < c.n AND x.i = greatest(c.i + 1, c.e - {_OVER})),
chunks AS (
  SELECT c.doc_id, c.par, c.i, c.e, o.off, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.par, c.i) AS num,
         (SELECT string_agg(p.piece, ' ' ORDER BY p.i) FROM pieces p
          WHERE p.doc_id = c.doc_id AND p.par = c.par AND p.i >= c.i AND p.i < c.e) AS body
  FROM chain c JOIN offsets o ON o.doc_id = c.doc_id AND o.par = c.par)
"""

PASSAGES_CTE = _PIECES

def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _lifespan(x: str) -> str:
    x = S.squeeze(x)
    return (f"(len(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda y: regexp_full_match(y, '1[0-9]{{3}}|20[0-9]{{2}}'))) >= 2 "
            f"AND (regexp_matches({x}, '[–—-]') OR ({_count(f'lower({x})', 'năm')} >= 2 AND contains(lower({x}), 'tháng')) "
            f"OR regexp_matches({x}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:sinh|mất|qua đời)(?:$|[^\\p{{L}}\\p{{N}}_])')))")


_EDGE = "concat(' ', chr(9), chr(13), chr(10), '-–—,:;.')"


def _title(x: str) -> str:
    x = f"regexp_replace({S.squeeze(x)}, '^#{{1,6}}\\s*', '')"
    inner = f"regexp_extract({x}, '\\s*\\(([^()]*)\\)\\s*$', 1)"
    return f"trim(CASE WHEN {_lifespan(inner)} THEN regexp_replace({x}, '\\s*\\([^()]*\\)\\s*$', '') ELSE {x} END, {_EDGE})"


def _plausible(x: str) -> str:
    return (f"({x} <> '' AND {S.count_words(x)} <= 14 AND length({x}) <= 100 AND NOT regexp_matches({x}, "
            f"'(?i)^(?:năm|ngày|tháng|sau|trước|khi|trong|tại|theo|đến|từ|có)(?:$|[^\\p{{L}}\\p{{N}}_])') "
            f"AND NOT regexp_matches({x}, ' (?:ông|bà|họ|nó)$'))")


_PAREN = "(?i)^([^()\\n]{2,100}?)\\s*\\(([^()]{1,140})\\)\\s*.*$"
_VERB = "(?i)^(.{2,100}?)\\s+(?:là|có|được|từng|thuộc|nằm|sinh|mất|giữ|đảm nhiệm)(?:$|[^\\p{L}\\p{N}_])"
_TITLES = f"""
  WITH a AS (SELECT doc_id, {S.squeeze('text')} AS c FROM documents),
  b AS (SELECT doc_id, c, substr(c, 1, 360) AS lead,
               CASE WHEN regexp_matches(c, '^(.*?[.!?…])\\s') THEN regexp_extract(c, '^(.*?[.!?…])\\s', 1) ELSE c END AS f FROM a),
  d AS (SELECT *, {_title(f"regexp_extract(lead, '{_PAREN}', 1)")} AS life, regexp_extract(lead, '{_PAREN}', 2) AS dates,
               {_title(f"regexp_extract(lead, '{_VERB}', 1)")} AS verb,
               rtrim(regexp_replace(substr(f, 1, 89), ' [^ ]*$', '')) AS sh0 FROM b),
  e AS (SELECT *, CASE WHEN {_count('sh0', chr(92) + '(')} > {_count('sh0', chr(92) + ')')} AND rtrim(regexp_replace(sh0, '\\([^(]*$', '')) <> ''
               THEN rtrim(regexp_replace(sh0, '\\([^(]*$', '')) ELSE sh0 END AS sh FROM d)
  SELECT doc_id, coalesce(CASE WHEN {_lifespan('dates')} AND {_plausible('life')} THEN life END,
      CASE WHEN {_plausible('verb')} THEN verb END,
      nullif(CASE WHEN length(f) <= 88 THEN {_title('f')} ELSE concat({_title('sh')}, '…') END, ''), CAST(doc_id AS VARCHAR)) AS title FROM e"""

SQL = {
    "source_titles": _TITLES,
    "fold_accents": f"SELECT doc_id, md5({S.fold('text')}) AS folded_md5, md5({S.fold_keep('text')}) AS kept_md5 FROM documents",
    "tokenize_stats": f"""
        SELECT doc_id, len(r) AS n_raw, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct,
               md5(array_to_string(t, ' ')) AS tokens_md5
        FROM (SELECT doc_id, {S.raw_tokens('text')} AS r, {S.tokenize('text')} AS t FROM documents)""",
    "normalize_answer": f"SELECT conv_id, turn, {S.normalize_answer('text')} AS normalized FROM conversations",
    "clean_html": f"SELECT page_id, {S.clean_html('html')} AS clean_text FROM pages",
    "sentence_split": f"""
        SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5
        FROM (SELECT doc_id, {S.split_sentences('text')} AS s FROM documents)""",
    "chunk_documents": _PIECES + f"""
        SELECT doc_id, printf('%d_P%04d', doc_id, num) AS passage_id, printf('%d_PAR%04d', doc_id, par + 1) AS paragraph_id,
               CAST(off + i AS INTEGER) AS sentence_start, CAST(off + e - 1 AS INTEGER) AS sentence_end,
               md5(body) AS text_md5, CAST({S.count_words('body')} AS INTEGER) AS n_words FROM chunks""",
    "fingerprint": f"""
        SELECT conv_id, turn, sha256(concat_ws('␟', {nfkc_feedback('conv_id')}, {nfkc_feedback('turn')},
               {nfkc_feedback('role')}, {nfkc_feedback('text')})) AS fingerprint FROM conversations""",
    "question_class_share": f"""
        WITH c AS (SELECT {_CLASS} AS question_class, count(*) AS count FROM conversations WHERE role = 'user' GROUP BY 1)
        SELECT question_class, count, round(count * 100.0 / (SELECT sum(count) FROM c), 6) AS percent FROM c""",
    "word_count_profile": f"""
        SELECT lang, count(*) AS count, round(avg(words), 6) AS mean, round(stddev_samp(words), 6) AS std, min(words) AS min,
               round(quantile_cont(words, 0.25), 6) AS p25, round(quantile_cont(words, 0.5), 6) AS p50,
               round(quantile_cont(words, 0.75), 6) AS p75, max(words) AS max
        FROM (SELECT lang, CAST({S.count_words('text')} AS INTEGER) AS words FROM documents) GROUP BY lang""",
    "distinct_corpus": """
        WITH f AS (SELECT lang, text, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY lang, text)
        SELECT doc_id, printf('doc_%05d', row_number() OVER (ORDER BY doc_id)) AS id, lang, md5(text) AS text_md5 FROM f""",
    "split_leakage": """
        WITH u AS (SELECT DISTINCT source, text FROM documents)
        SELECT a.source AS left_split, b.source AS right_split, count(*) AS shared_contents
        FROM u a JOIN u b ON a.text = b.text AND a.source < b.source GROUP BY ALL""",
    "reanchor_answers": f"""
        WITH r AS (SELECT item_id, {S.clean_html('text')} AS context, CAST(item_id % 3 * 7 - 1 AS INTEGER) AS stored FROM benchmark),
        a AS (SELECT item_id, context, stored, regexp_extract(context, '^(?:\\S+\\s+){{2}}(\\S+\\s+\\S+)', 1) AS answer FROM r)
        SELECT item_id, answer, stored, CAST(CASE WHEN answer = '' THEN stored
          WHEN stored >= 0 AND substr(context, stored + 1, length(answer)) = answer THEN stored
          WHEN instr(context, answer) > 0 THEN instr(context, answer) - 1 ELSE stored END AS INTEGER) AS answer_start FROM a""",
    "resume_anti_join": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "content_digest": """
        SELECT count(*) AS rows, bit_xor(CAST(concat('0x', substr(sha256(concat_ws('␟', coalesce(CAST(doc_id AS VARCHAR), '␀'),
          coalesce(CAST(quality AS VARCHAR), '␀'), coalesce(CAST(toxic AS VARCHAR), '␀'))), 1, 13)) AS BIGINT)) AS digest FROM labels""",
    "union_splits": """
        WITH u AS (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark
                   UNION ALL SELECT 'conversations', text FROM conversations)
        SELECT origin, count(*) AS rows, count(DISTINCT text) AS distinct_texts FROM u GROUP BY origin""",
}
