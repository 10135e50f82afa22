"""DuckDB twins of the retrieval queries."""

from askweave.functions import fixed
from oracles import sqltext as S
from oracles.text_sql import PASSAGES_CTE, SQL as TEXT_SQL

K = 10


def _rank(query: str, doc: str, score: str, direction: str = "DESC") -> str:
    return f"CAST(row_number() OVER (PARTITION BY {query} ORDER BY {score} {direction}, {doc}) AS INTEGER)"


def base(docs: str = "SELECT doc_id, text FROM documents") -> str:
    """Tokens, lengths, postings, statistics and query terms."""
    return f"""
  d0 AS ({docs}),
  dt AS (SELECT doc_id, {S.tokenize('text')} AS t FROM d0),
  dl AS (SELECT doc_id, len(t) AS dl FROM dt),
  st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl),
  dx AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM dt),
  post AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos FROM dx GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  qt0 AS (SELECT item_id, {S.tokenize('text')} AS t FROM benchmark),
  qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(t) AS term FROM qt0) GROUP BY ALL)"""


_IDF = {
    "binary": "ln(1 + (n - df + 0.5) / (df + 0.5))",
    "lucene": "ln(1 + (n - df + 0.5) / (df + 0.5))",
    "okapi": "ln(n - df + 0.5) - ln(df + 0.5)",
    "l": "ln(n + 1) - ln(df + 0.5)",
    "plus": "ln(n + 1) - ln(df)",
}
_NORM = "(1 - 0.75 + 0.75 * dl / av)"
_GAIN = {
    "binary": "2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * greatest(1, dl) / greatest(1.0, av)))",
    "okapi": f"tf * 2.5 / (tf + 1.5 * {_NORM})",
    "lucene": "tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / av))",
    "l": f"2.5 * (tf / {_NORM} + 0.5) / (1.5 + tf / {_NORM} + 0.5)",
    "plus": f"1 + tf * 2.5 / (1.5 * {_NORM} + tf)",
}


def bm25_scores(variant: str = "binary") -> str:
    """CTE ``sc(item_id, doc_id, score)`` with rounded positive scores."""
    idf = f"idf0 AS (SELECT term, {_IDF[variant]} AS idf FROM df, st)"
    if variant == "okapi":
        idf += f", idf AS (SELECT term, CASE WHEN idf < 0 THEN {fixed.OKAPI_EPSILON} * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0)"
    else:
        idf += ", idf AS (SELECT * FROM idf0)"
    if variant in ("l", "plus"):
        # Brute force over all documents: a missing term counts with tf = 0.
        return idf + f""",
  sc AS (SELECT item_id, doc_id, round(sum(qtf * idf * ({_GAIN[variant]})), 6) AS score
         FROM (SELECT q.item_id, l.doc_id, l.dl, q.qtf, i.idf, coalesce(p.tf, 0) AS tf
               FROM qt q JOIN idf i USING (term) CROSS JOIN dl l LEFT JOIN post p ON p.doc_id = l.doc_id AND p.term = q.term), st
         GROUP BY ALL HAVING score > 0)"""
    return idf + f""",
  sc AS (SELECT item_id, doc_id, round(sum(qtf * idf * ({_GAIN[variant]})), 6) AS score
         FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL HAVING score > 0)"""


def hits(k: int) -> str:
    return f"(SELECT * FROM (SELECT item_id, doc_id, score, {_rank('item_id', 'doc_id', 'score')} AS rank FROM sc) WHERE rank <= {k})"


def bm25(variant: str) -> str:
    return f"WITH {base()}, {bm25_scores(variant)} SELECT item_id, doc_id, rank, score FROM {hits(K)}"


def min_max(score: str, part: str) -> str:
    lo, hi = f"min({score}) OVER (PARTITION BY {part})", f"max({score}) OVER (PARTITION BY {part})"
    return (f"round(CASE WHEN abs({hi} - {lo}) <= 1e-9 * greatest(abs({lo}), abs({hi})) THEN CASE WHEN {hi} > 0 THEN 1.0 ELSE 0.0 END "
            f"ELSE ({score} - {lo}) / ({hi} - {lo}) END, 6)")


_TFIDF = """
  idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, st),
  dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM post JOIN idf USING (term)),
  dn AS (SELECT doc_id, sum(w * w) AS dn FROM dw GROUP BY doc_id),
  qw AS (SELECT item_id, term, (1 + ln(qtf)) * idf AS w FROM qt JOIN idf USING (term)),
  qn AS (SELECT item_id, sum(w * w) AS qn FROM qw GROUP BY item_id),
  cosine AS (SELECT item_id, doc_id, sum(qw.w * dw.w) / sqrt(any_value(qn) * any_value(dn)) AS score
             FROM qw JOIN dw USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) WHERE qn > 0 AND dn > 0 GROUP BY ALL)"""

_SPACE = f"string_split(lower({S.squeeze(S.nfc('text'))}), ' ')"
_STOP = S.strs(fixed.GRAM_STOPWORDS)
_W = "'[\\p{L}\\p{N}_]'"


def _grams(p: str, key: str, table: str) -> str:
    return f"""
  {p}t AS (SELECT {key}, list_filter({_SPACE}, lambda x: x <> '') AS t FROM {table}),
  {p}x AS (SELECT {key}, unnest(t) AS a, unnest(list_concat(t[2:], [NULL])) AS b FROM {p}t),
  {p}g AS (SELECT {key}, a AS gram FROM {p}x WHERE regexp_matches(a, {_W}) AND a NOT IN {_STOP} AND length(a) >= 2
            UNION ALL SELECT {key}, a || ' ' || b FROM {p}x WHERE b IS NOT NULL AND regexp_matches(a, {_W}) AND regexp_matches(b, {_W})
              AND NOT (a IN {_STOP} AND b IN {_STOP}))"""


_DGRAMS = _grams("d", "doc_id", "documents")
_QGRAMS = _grams("q", "item_id", "benchmark")


def lexical(method: str, k: int = K) -> str:
    score = "coalesce(b.score, 0)" if method == "bm25" else "b.score"
    base_cte = (bm25_scores("binary").replace("round(sum(qtf * idf", "(sum(qtf * idf").replace(", 6) AS score", ") AS score")
                if method == "bm25" else _TFIDF + ", sc AS (SELECT * FROM cosine)")
    seq = "list_position(list_transform(range(0, len({t}) - len(q) + 1), lambda i: {t}[i + 1:i + len(q)] = q), true) - 1"
    return f"""
  WITH {base()}, {base_cte},
  titles AS ({TEXT_SQL['source_titles']}),
  tt AS (SELECT doc_id, list_distinct({S.tokenize('title')}) AS tt FROM titles),
  qa AS (SELECT item_id, t AS qtok, list_filter(t, lambda x, i: list_position(t, x) = i) AS q FROM qt0),
  m AS (SELECT item_id, doc_id, count(*) AS matched, max(first_pos) - min(first_pos) + 1 AS span FROM qt JOIN post USING (term) GROUP BY ALL),
  lead AS (SELECT doc_id, {S.raw_tokens("coalesce(ss[1], '')")} AS r FROM (SELECT doc_id, {S.split_sentences('text')} AS ss FROM documents)),
  gr AS (SELECT item_id, list_concat(list_concat(
           list_transform(range(0, len(qtok) - 3), lambda i: array_to_string(qtok[i + 1:i + 4], ' ')),
           list_transform(range(0, len(qtok) - 2), lambda i: array_to_string(qtok[i + 1:i + 3], ' '))),
           list_transform(range(0, len(qtok) - 1), lambda i: array_to_string(qtok[i + 1:i + 2], ' '))) AS g FROM qa),
  j AS (SELECT m.*, {score} AS base, q, len(q) AS nq, r, g, array_to_string(t, ' ') AS body, len(list_intersect(q, tt)) AS titled
        FROM m JOIN qa USING (item_id) JOIN gr USING (item_id) JOIN dt USING (doc_id) JOIN tt USING (doc_id) JOIN lead USING (doc_id)
        {"LEFT" if method == "bm25" else ""} JOIN sc b USING (item_id, doc_id)),
  l1 AS (SELECT *, list_filter(r, lambda x: length(x) > 1 AND x NOT IN {S.strs(fixed.STOPWORDS)}) AS rc FROM j),
  l2 AS (SELECT *, CASE WHEN matched = nq AND nq >= 2 THEN coalesce({seq.format(t='rc')}, -1) ELSE -1 END AS at_ FROM l1),
  l3 AS (SELECT *, CASE WHEN at_ >= 0 THEN coalesce({seq.format(t='r')}, -1) ELSE -1 END AS raw FROM l2),
  l4 AS (SELECT *, CASE WHEN raw >= 0 AND list_contains(r[raw + nq + 1:], 'la') THEN raw + nq + list_position(r[raw + nq + 1:], 'la') - 1 ELSE -1 END AS la FROM l3),
  l5 AS (SELECT *, CASE WHEN at_ < 0 THEN 0.0 ELSE (CASE WHEN at_ <= 2 THEN 1.0 ELSE 0.0 END) + CASE WHEN raw >= 0 THEN greatest(0.0, 0.8 - 0.08 * raw)
      + CASE WHEN la > raw + nq AND la - raw <= 18 AND len(list_filter(r[raw + nq + 1:la], lambda x: x NOT IN {S.strs(fixed.STOPWORDS + fixed.DATE_TOKENS)}
             AND NOT regexp_full_match(x, '[0-9]+'))) = 0 THEN 2.4 ELSE 0.0 END ELSE 0.0 END END AS lead_boost FROM l4),
  fin AS (SELECT item_id, doc_id, round(base + 2.0 * matched / nq + 0.8 * titled / nq
      + CASE WHEN matched >= 2 AND span <= 40 THEN (40 - span) / 40.0 ELSE 0.0 END
      + least(1.5, 0.35 * len(list_filter(g, lambda x: contains(body, x)))) + lead_boost, 6) AS score FROM l5),
  rk AS (SELECT *, {_rank('item_id', 'doc_id', 'score')} AS rank FROM fin WHERE score > 0)
  SELECT item_id, doc_id, rank, score, {min_max('score', 'item_id')} AS score_norm FROM rk WHERE rank <= {k}"""


def dense(metric: str) -> str:
    a, b = "CAST(a.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])"
    score = {"cosine": f"list_cosine_similarity({a}, {b})", "ip": f"list_dot_product({a}, {b})",
             "l2": f"pow(list_distance({a}, {b}), 2)"}[metric]
    direction = "ASC" if metric == "l2" else "DESC"
    keep = "AND score > 0" if metric == "cosine" else ""
    return f"""
  WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, round({score}, 6) + 0.0 AS score FROM embeddings a CROSS JOIN embeddings b),
  r AS (SELECT *, {_rank('vec_id', 'neighbour', 'score', direction)} AS rank FROM s)
  SELECT vec_id, neighbour, rank, score FROM r WHERE rank <= {K} {keep}"""


def _fusion(k: int, leg: int) -> str:
    return f"""
  lex AS (SELECT item_id, doc_id, score, rank FROM ({lexical('bm25', leg)})),
  ds AS (SELECT a.vec_id AS item_id, b.vec_id AS doc_id,
                round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
         FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND b.vec_id IN (SELECT doc_id FROM documents)),
  den AS (SELECT * FROM (SELECT *, {_rank('item_id', 'doc_id', 'score')} AS rank FROM ds) WHERE rank <= {leg} AND score > 0),
  un AS (SELECT item_id, doc_id, l.rank AS ra, d.rank AS rb FROM (SELECT * FROM lex WHERE item_id IN (SELECT item_id FROM den)) l
         FULL OUTER JOIN den d USING (item_id, doc_id)),
  fu AS (SELECT *, round(1.0 / (60 + coalesce(ra, miss)) + 1.0 / (60 + coalesce(rb, miss)), 6) AS score FROM (
         SELECT *, greatest(count(ra) OVER (PARTITION BY item_id), count(rb) OVER (PARTITION BY item_id)) + 1 AS miss FROM un)),
  fr AS (SELECT item_id, doc_id, score, {_rank('item_id', 'doc_id', 'score')} AS rank FROM fu),
  hyb AS (SELECT item_id, doc_id, rank, score FROM fr WHERE rank <= {k}
          UNION ALL SELECT item_id, doc_id, rank, score FROM lex WHERE rank <= {k} AND item_id NOT IN (SELECT item_id FROM den))"""


SQL = {
    "term_freq": f"WITH {base()} SELECT term, CAST(sum(tf) AS BIGINT) AS total_tf, max(tf) AS max_tf, CAST(min(first_pos) AS INTEGER) AS earliest FROM post GROUP BY term",
    "doc_freq_idf": f"WITH {base()} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st",
    "avg_doc_len": f"WITH {base()} SELECT n AS n_docs, round(av, 6) AS avg_len FROM st",
    "ngram_df": f"WITH {_DGRAMS} SELECT gram, count(DISTINCT doc_id) AS df FROM dg GROUP BY gram",
    "bm25_binary_topk": bm25("binary"),
    "bm25_okapi_topk": bm25("okapi"),
    "bm25_l_topk": bm25("l"),
    "bm25_plus_topk": bm25("plus"),
    "bm25_lucene_topk": bm25("lucene"),
    "tfidf_cosine_topk": f"""WITH {base()}, {_TFIDF}, sc AS (SELECT item_id, doc_id, round(score, 6) AS score FROM cosine WHERE round(score, 6) > 0)
        SELECT item_id, doc_id, rank, score FROM {hits(K)}""",
    "tfidf_ngram_topk": f"""WITH {_DGRAMS}, {_QGRAMS},
        dc AS (SELECT doc_id, gram, count(*) AS tf FROM dg GROUP BY ALL), qc AS (SELECT item_id, gram, count(*) AS qtf FROM qg GROUP BY ALL),
        df AS (SELECT gram, greatest(0.0, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM dc GROUP BY gram),
        sc AS (SELECT item_id, doc_id, round(sum(ln(1 + qtf) * idf * idf * ln(1 + tf)), 6) AS score
               FROM qc JOIN dc USING (gram) JOIN df USING (gram) WHERE idf > 0 GROUP BY ALL HAVING score > 0)
        SELECT item_id, doc_id, rank, score FROM {hits(K)}""",
    "tfidf_hashed_topk": f"""WITH {_DGRAMS}, {_QGRAMS},
        dc AS (SELECT doc_id, CAST(concat('0x', substr(md5(gram), 1, 6)) AS BIGINT) % {fixed.HASH_BUCKETS} AS gram, count(*) AS tf FROM dg GROUP BY ALL), qc AS (SELECT item_id, CAST(concat('0x', substr(md5(gram), 1, 6)) AS BIGINT) % {fixed.HASH_BUCKETS} AS gram, count(*) AS qtf FROM qg GROUP BY ALL),
        df AS (SELECT gram, greatest(0.0, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM dc GROUP BY gram),
        sc AS (SELECT item_id, doc_id, round(sum(ln(1 + qtf) * idf * idf * ln(1 + tf)), 6) AS score
               FROM qc JOIN dc USING (gram) JOIN df USING (gram) WHERE idf > 0 GROUP BY ALL HAVING score > 0)
        SELECT item_id, doc_id, rank, score FROM {hits(K)}""",
    "lexical_bm25_boosted": lexical("bm25"),
    "lexical_tfidf_boosted": lexical("tfidf"),
    "passage_bm25_topk": PASSAGES_CTE + ", " + base("SELECT printf('%d_P%04d', doc_id, num) AS doc_id, body AS text FROM chunks")
        + ", " + bm25_scores("binary") + f" SELECT item_id, doc_id AS passage_id, rank, score FROM {hits(K)}",
    "minmax_topk": f"WITH {base()}, {bm25_scores()} SELECT item_id, doc_id, {min_max('score', 'item_id')} AS score_norm FROM {hits(K)}",
    "softmax_topk": f"""WITH {base()}, {bm25_scores()}, e AS (SELECT item_id, doc_id, exp(least(50.0, score - max(score) OVER (PARTITION BY item_id))) AS e FROM {hits(K)})
        SELECT item_id, doc_id, round(e / sum(e) OVER (PARTITION BY item_id), 6) AS weight FROM e""",
    "dense_cosine_topk": dense("cosine"),
    "dense_ip_topk": dense("ip"),
    "dense_l2_topk": dense("l2"),
    "rrf_hybrid": f"WITH {_fusion(K, 3 * K)} SELECT item_id, doc_id, rank, score, {min_max('score', 'item_id')} AS score_norm FROM hyb",
    "preferred_injection": f"""WITH {base()}, {bm25_scores()}, h AS (SELECT *, {min_max('score', 'item_id')} AS score_norm FROM {hits(K)}),
        w AS (SELECT item_id, doc_id AS pref FROM h WHERE rank = 4 AND item_id % 2 = 0 UNION ALL SELECT item_id, item_id FROM benchmark WHERE item_id % 2 = 1),
        f AS (SELECT w.item_id, pref AS doc_id, coalesce(max(CASE WHEN doc_id = pref THEN score END), max(score), 0.0) AS score, 1.0 AS score_norm, 0 AS o
              FROM w LEFT JOIN h ON h.item_id = w.item_id GROUP BY w.item_id, pref),
        o AS (SELECT h.item_id, doc_id, score, CASE WHEN pref IS NULL THEN score_norm ELSE least({fixed.PREFERRED_CAP}, score_norm) END AS score_norm, rank AS o, pref
              FROM h LEFT JOIN w ON w.item_id = h.item_id WHERE pref IS NULL OR doc_id <> pref),
        a AS (SELECT item_id, doc_id, score, score_norm, o, true AS has FROM f UNION ALL SELECT item_id, doc_id, score, score_norm, o, pref IS NOT NULL FROM o),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY o, doc_id) AS INTEGER) AS rank FROM a)
        SELECT item_id, doc_id, rank, score, CAST(score_norm AS DOUBLE) AS score_norm FROM r WHERE NOT has OR rank <= {K}""",
    "compare_retrievers": f"""WITH {_fusion(3, 9)}, tf AS (SELECT item_id, doc_id, rank FROM ({lexical('tfidf', 3)}))
        SELECT 'tfidf' AS method, item_id, doc_id, rank FROM tf UNION ALL SELECT 'bm25', item_id, doc_id, rank FROM lex WHERE rank <= 3
        UNION ALL SELECT 'dense', item_id, doc_id, rank FROM den WHERE rank <= 3 UNION ALL SELECT 'hybrid', item_id, doc_id, rank FROM hyb""",
    "candidate_count": "SELECT item_id, CAST(least(40, greatest(item_id % 30, 20, 2 * (item_id % 30))) AS INTEGER) AS candidates FROM benchmark",
    "stored_vectors": "SELECT kind, id, sha256('letter-shares-1' || chr(31) || coalesce(text, '')) AS key, " + ", ".join(
        f"CASE WHEN known THEN round(CAST(CAST((length(t) - length(replace(t, '{c}', ''))) / CAST(greatest(length(t), 1) AS DOUBLE) AS FLOAT) AS DOUBLE), 4) END AS share_{c}" for c in "aeinrs")
        + """ FROM (SELECT 'document' AS kind, doc_id AS id, text, coalesce(text, '') AS t, true AS known FROM documents
        UNION ALL SELECT 'item', item_id, text, coalesce(text, ''), coalesce(text, '') IN (SELECT coalesce(text, '') FROM documents) FROM benchmark)""",
}
for _kind in ("cosine", "ngram", "hashed"):  # the stored index gives the same hits
    SQL[f"tfidf_{_kind}_indexed_topk"] = SQL[f"tfidf_{_kind}_topk"]
