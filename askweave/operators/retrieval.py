"""Sparse retrieval for whole query sets: BM25 family, TF-IDF, lexical boosts, hybrids.

Scoring walks document-partitioned postings joined with the query terms.  The
query terms are broadcast only after a row-count check; beyond it the join is
shuffled by term with salted hot terms.  Per-query sums never leave the stage
of their document; only ``k`` rows per query and task are exchanged.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from askweave.functions import fixed
from askweave.functions import text as T
from askweave.operators import boosted_cells, ranking
from askweave.operators.text_index import Statistics, maybe_broadcast, parts_for, postings, query_terms, statistics, tokenized
from askweave.session import BROADCAST_BYTES, BROADCAST_ROWS, fits, materialize

VARIANTS = ("binary", "okapi", "l", "plus", "lucene")
SALTS = 64


def validate_retriever(method: str) -> str:
    if method == "pyserini":
        raise ValueError("no Lucene index is set up for pyserini")
    if method not in fixed.RETRIEVERS:
        raise ValueError(f"unknown retriever: {method}")
    return method


def validate_reader(name: str) -> str:
    if name in ("mock", "vibert"):
        raise ValueError(f"reader without an implementation: {name}")
    if name not in fixed.READERS:
        raise ValueError(f"unknown reader: {name}")
    return name


def join_terms(post: DataFrame, weights: DataFrame, small: bool) -> DataFrame:
    """Postings joined with per-query term weights.

    A small query side is broadcast.  A large one is joined by (term, salt): the
    salt is a function of the document, so the postings of a very common term
    are spread over ``SALTS`` tasks and the query side is repeated per salt.
    """
    if small:
        return post.join(F.broadcast(weights), "term")
    salted = post.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copies = weights.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(copies, ["term", "_salt"]).drop("_salt")


def _idf(n: Column, df: Column, variant: str) -> Column:
    if variant in ("binary", "lucene", "tfidf"):
        return F.log(1 + (n - df + 0.5) / (df + 0.5))
    if variant == "okapi":
        return F.log(n - df + 0.5) - F.log(df + 0.5)
    if variant == "l":
        return F.log(n + 1) - F.log(df + 0.5)
    if variant == "plus":
        return F.log(n + 1) - F.log(df)
    raise ValueError(f"unknown BM25 variant: {variant}")


def term_idf(stats: Statistics, variant: str) -> DataFrame:
    """``term, idf``.  The Okapi floor is a mean over the whole vocabulary, so ``stats`` must cover it."""
    idf = stats.frequency.select("term", _idf(F.lit(stats.n_docs), F.col("df"), variant).alias("idf"))
    if variant != "okapi":
        return idf
    floor = (idf.agg(F.avg("idf")).first()[0] or 0.0) * fixed.OKAPI_EPSILON
    return idf.select("term", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")).alias("idf"))


def _gain(variant: str, tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    """Contribution of one matched term, without idf."""
    if variant == "binary":
        norm = 1 - b + b * F.greatest(length, F.lit(1)) / F.greatest(average, F.lit(1.0))
        return (k1 + 1) / (1 + k1 * norm)
    norm = 1 - b + b * length / average
    if variant == "okapi":
        return tf * (k1 + 1) / (tf + k1 * norm)
    if variant == "lucene":
        return tf / (tf + k1 * norm)
    delta = fixed.BM25_DELTA[variant]
    if variant == "l":
        # Difference to the constant every document gets for the term.
        ctd = tf / norm
        return (k1 + 1) * ((ctd + delta) / (k1 + ctd + delta) - delta / (k1 + delta))
    return tf * (k1 + 1) / (k1 * norm + tf)


def _base_gain(variant: str, k1: float) -> float:
    """What a document without the term gets for it, in units of idf."""
    if variant == "l":
        delta = fixed.BM25_DELTA["l"]
        return (k1 + 1) * delta / (k1 + delta)
    return fixed.BM25_DELTA["plus"] if variant == "plus" else 0.0


def bm25_pairs(post: DataFrame, stats: Statistics, weights: DataFrame, small: bool, variant: str = "binary",
               k1: float | None = None, b: float | None = None) -> DataFrame:
    """``query_id, doc_id, score`` for all documents sharing a term with the query."""
    k1 = k1 if k1 is not None else (fixed.LUCENE_K1 if variant == "lucene" else fixed.BM25_K1)
    b = b if b is not None else (fixed.LUCENE_B if variant == "lucene" else fixed.BM25_B)
    gain = _gain(variant, F.col("tf"), F.col("len"), F.lit(stats.avg_len), k1, b)
    joined = join_terms(post.withColumn("gain", gain), weights, small)
    return joined.groupBy("doc_id", "query_id").agg(F.sum(F.col("weight") * F.col("gain")).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, variant: str = "binary", doc_id: str = "doc_id",
         doc_text: str = "text", query_id: str = "query_id", query_text: str = "question",
         tokenizer=T.tokenize, parts: int | None = None) -> DataFrame:
    """Ranked hits ``query_id, doc_id, score, rank`` with positive scores only."""
    tok = tokenized(docs, doc_id, doc_text, tokenizer=tokenizer, parts=parts)
    terms = query_terms(queries, query_id, query_text, tokenizer)
    return bm25_over(tok, postings(tok, _wanted(terms, fits(terms))), terms, k, variant)


def _wanted(terms: DataFrame, small: bool) -> DataFrame | None:
    """The terms of the queries, to drop others before they are counted; none where they do not fit a broadcast."""
    return terms.select("term").distinct() if small else None


def bm25_over(tok: DataFrame, post: DataFrame, terms: DataFrame, k: int, variant: str = "binary",
              stats: Statistics | None = None) -> DataFrame:
    """Like :func:`bm25` for prepared postings; pass stored ``stats`` to skip counting."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown BM25 variant: {variant}")
    small = fits(terms)
    if stats is None:
        stats = statistics(tok, None if variant == "okapi" else terms)
    weights = terms.join(term_idf(stats, variant), "term").select(
        "query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")
    )
    pairs = bm25_pairs(post, stats, weights, small, variant)
    base = _base_gain(variant, fixed.BM25_K1)
    if base:
        pairs = _with_constant_part(tok, weights, pairs, base, k, small)
    return ranking.top_k(pairs.where(F.col("score") > 0), k)


def _with_constant_part(tok: DataFrame, weights: DataFrame, pairs: DataFrame, base: float, k: int, small: bool) -> DataFrame:
    """Variants that credit every document for every known term.

    Matched documents always outrank unmatched ones, so unmatched documents can
    enter a top-k only in id order; the ``k`` smallest ids cover every case.
    """
    constant = weights.groupBy("query_id").agg((F.sum("weight") * base).alias("constant"))
    smallest = [r["doc_id"] for r in tok.select("doc_id").orderBy("doc_id").limit(k).collect()]
    full = pairs.join(F.broadcast(constant) if small else constant, "query_id").select(
        "query_id", "doc_id", (F.col("score") + F.col("constant")).alias("score")
    )
    fill = constant.select("query_id", F.explode(F.lit(smallest)).alias("doc_id"), F.round("constant", 6).alias("score"))
    # A filler for a matched document adds nothing: the maximum keeps the match.
    best = ranking.top_k(full, k).select("query_id", "doc_id", "score")
    return best.unionByName(fill).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


# --- cosine TF-IDF ---------------------------------------------------------------

def _log_tf(count: Column) -> Column:
    return 1 + F.log(count)


def _split_frequency(frequency: DataFrame) -> int:
    """The largest df that is left out so that the terms of higher df fit a broadcast; 0 where all fit.

    At most 64 rows, one for each binary magnitude of df, reach the driver.
    """
    size = frequency.groupBy(F.ceil(F.log2("df")).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("term") + 24).alias("bytes"))
    rows = bytes_ = 0
    for r in sorted(size.collect(), key=lambda r: -r["p"]):
        rows, bytes_ = rows + r["rows"], bytes_ + r["bytes"]
        if rows > BROADCAST_ROWS or bytes_ > BROADCAST_BYTES:
            return 1 << r["p"]
    return 0


def document_norms(post: DataFrame, stats: Statistics, split: int | None = None) -> DataFrame:
    """``doc_id, dn``: the sum of squared ``(1 + ln tf) * idf`` over all terms of a document.

    Common terms, nearly all postings, take their idf from a broadcast and never
    leave the task of their document.  Only the postings of terms found in at most
    ``split`` documents are shuffled by term, and none where that is one document.
    """
    def squares(rows: DataFrame) -> DataFrame:
        dw = _log_tf(F.col("tf")) * F.col("idf")
        return rows.groupBy("doc_id").agg(F.sum(dw * dw).alias("dn"))

    idf = term_idf(stats, "tfidf")
    split = _split_frequency(stats.frequency) if split is None else split
    post = post.where(F.col("tf") > 0).select("doc_id", "term", "tf")
    if split == 0:
        return squares(post.join(F.broadcast(idf), "term"))
    common = stats.frequency.where(F.col("df") > split).select("term")
    common = F.broadcast(idf.join(common, "term", "left_semi"))
    if split == 1:
        once = _idf(F.lit(stats.n_docs), F.lit(1), "tfidf")
        return squares(post.join(common, "term", "left").withColumn("idf", F.coalesce("idf", once)))
    rare = post.join(common, "term", "left_anti").join(idf, "term")
    parts = squares(post.join(common, "term")).unionByName(squares(rare))
    return parts.groupBy("doc_id").agg(F.sum("dn").alias("dn"))


def tfidf_pairs(post: DataFrame, stats: Statistics, terms: DataFrame, small: bool, matched: DataFrame | None = None) -> DataFrame:
    """Cosine of ``(1 + ln tf) * idf`` weights; document norms cover all document terms.

    ``matched`` are the postings of the queries' terms, where they are at hand.
    """
    qw = terms.join(term_idf(stats, "tfidf"), "term").select("query_id", "term", "idf", (_log_tf(F.col("qtf")) * F.col("idf")).alias("qw"))
    qw = materialize(qw, "query-idf")
    qn = qw.groupBy("query_id").agg(F.sum(F.col("qw") * F.col("qw")).alias("qn"))
    asked = (post if matched is None else matched).where(F.col("tf") > 0)
    dots = join_terms(asked, qw, small).groupBy("doc_id", "query_id").agg(
        F.sum(F.col("qw") * _log_tf(F.col("tf")) * F.col("idf")).alias("dot")
    )
    scored = dots.join(document_norms(post, stats), "doc_id").join(F.broadcast(qn) if small else qn, "query_id")
    return scored.where((F.col("qn") > 0) & (F.col("dn") > 0)).select(
        "doc_id", "query_id", (F.col("dot") / F.sqrt(F.col("qn") * F.col("dn"))).alias("score")
    )


def tfidf(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", doc_text: str = "text",
          query_id: str = "query_id", query_text: str = "question", tokenizer=T.tokenize) -> DataFrame:
    tok = tokenized(docs, doc_id, doc_text, tokenizer=tokenizer)
    terms = query_terms(queries, query_id, query_text, tokenizer)
    small = fits(terms)
    matched = postings(tok, _wanted(terms, small))
    pairs = tfidf_pairs(postings(tok), statistics(tok), terms, small, matched)
    return ranking.top_k(pairs.where(F.col("score") > 0), k)


# --- hashed n-gram TF-IDF ------------------------------------------------------------

def space_tokens(x: Column) -> Column:
    return T.split_words(F.lower(T.normalize_offline(x)))


def _gram_rows(df: DataFrame, key: str) -> DataFrame:
    """Unigrams and bigrams that are not punctuation, not only stop words, not single characters.

    Nulls are dropped behind the generator: an ``array_compact`` in it is interpreted, not compiled.
    """
    rows = df.select(key, F.posexplode_outer("tokens").alias("pos", "a"), F.col("tokens")).select(
        key, "a", F.get("tokens", F.col("pos") + 1).alias("b")
    ).where(F.col("a").isNotNull())
    def wordlike(c):
        return F.col(c).rlike(T.WORD)

    stop_a, stop_b = (F.col(c).isin(fixed.GRAM_STOPWORDS) for c in ("a", "b"))
    one = F.when(~stop_a & (F.length("a") >= 2), F.col("a"))
    two = F.when(F.col("b").isNotNull() & wordlike("b") & ~(stop_a & stop_b), F.concat_ws(" ", "a", "b"))
    return rows.where(wordlike("a")).select(key, F.explode_outer(F.array(one, two)).alias("gram")).where(F.col("gram").isNotNull())


def hashed_tfidf(docs: DataFrame, queries: DataFrame, k: int, buckets: int | None = fixed.HASH_BUCKETS,
                 doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "query_id",
                 query_text: str = "question", tokenizer=space_tokens) -> DataFrame:
    """Dot product of ``ln(1 + tf) * idf`` over uni- and bigrams.

    A gram's bucket comes from the first 24 bits of its MD5, which every engine
    has; other hashes collide elsewhere, so scores differ by their collisions.
    ``buckets=None`` keeps the gram itself as the feature and so has no collisions.
    """
    def feature(c: Column) -> Column:
        return c if buckets is None else F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long") % buckets

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("_t"))
    narrow = narrow.repartition(parts_for(narrow, "_t"), "doc_id")
    tok = narrow.select("doc_id", tokenizer(F.col("_t")).alias("tokens"))
    grams = _gram_rows(tok, "doc_id").select("doc_id", feature(F.col("gram")).alias("term"))
    asked = queries.select(F.col(query_id).alias("query_id"), tokenizer(F.col(query_text)).alias("tokens"))
    terms = _gram_rows(asked, "query_id").groupBy("query_id", feature(F.col("gram")).alias("term")).agg(
        F.count(F.lit(1)).alias("qtf")
    )
    n = docs.count()
    small = fits(terms)
    wanted = terms.select("term").distinct()
    if small:  # grams of no query are dropped before they are counted
        grams = grams.join(F.broadcast(wanted), "term", "left_semi")
    counts = grams.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    matched = counts if small else counts.join(wanted, "term", "left_semi")
    df = matched.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(0.0), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = materialize(terms.join(df, "term").select(
        "query_id", "term", (F.log1p(F.col("qtf")) * idf * idf).alias("weight")
    ).where(F.col("weight") > 0), "grams")
    pairs = join_terms(counts, weights, small).groupBy("doc_id", "query_id").agg(
        F.sum(F.col("weight") * F.log1p(F.col("tf"))).alias("score")
    )
    return ranking.top_k(pairs.where(F.col("score") > 0), k)


# --- serving retrieval: base score plus lexical boosts ---------------------------------

#: Questions that a cell answers at a time.
QUERY_BLOCK = 2048


def find_sequence(tokens: Column, sequence: Column) -> Column:
    """0-based position of a contiguous subsequence, -1 when absent."""
    size = F.size(sequence)
    starts = F.when(
        (size > 0) & (size <= F.size(tokens)), F.sequence(F.lit(0), F.size(tokens) - size)
    ).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(starts, lambda i: F.slice(tokens, i + 1, size) == sequence), F.lit(0)), F.lit(-1))


def _lead_boost(df: DataFrame) -> Column:
    """Boost for a document whose first sentence opens with the asked phrase, more if it is defined there."""
    at, raw_at = F.col("_at"), F.col("_raw_at")
    after = raw_at + F.size("q_terms")
    gap = F.slice("lead_raw", after + 1, F.greatest(F.col("_la") - after, F.lit(0)))
    content = F.exists(gap, lambda t: ~t.isin(fixed.STOPWORDS + fixed.DATE_TOKENS) & ~t.rlike(r"^\p{N}+$"))
    defined = (F.col("_la") > after) & ~content & (F.col("_la") - raw_at <= 18)
    boost = F.when(at <= 2, 1.0).otherwise(0.0) + F.when(
        raw_at >= 0,
        F.greatest(F.lit(0.0), 0.8 - 0.08 * raw_at) + F.when(defined, 2.4).otherwise(0.0),
    ).otherwise(0.0)
    return F.when((F.size("q_terms") >= 2) & (at >= 0), boost).otherwise(0.0)


def lexical_retrieve(docs: DataFrame, queries: DataFrame, k: int, method: str = "bm25", doc_id: str = "doc_id",
                     doc_text: str = "text", title: str = "title", query_id: str = "query_id",
                     query_text: str = "question") -> DataFrame:
    """Base score plus all lexical boosts, exact, with min-max scores.

    Questions and documents meet in cells (:mod:`boosted_cells`), so that no pair is
    a row.  The boost for the first sentence needs the text; a cell emits what can
    reach its best ``k`` with that boost, which is then computed for the emitted
    pairs that hold all words of the question.
    """
    if method not in ("bm25", "tfidf"):
        raise ValueError(f"unknown retriever: {method}")
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_text), F.lit("")).alias("text"), F.coalesce(F.col(title), F.lit("")).alias("title"))
    texts = texts.withColumn("row", F.xxhash64("text"))
    cells = parts_for(texts, "text")

    def spread(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    # Texts are exchanged once; their tokens are numbers from here on.
    tok = texts.withColumn("cell", spread("doc_id", cells)).repartition(2 * cells, "cell").select(
        "cell", "doc_id", "row", T.tokenize(F.col("text")).alias("tokens"), F.array_distinct(T.tokenize(F.col("title"))).alias("title_tokens"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    kind = spark.createDataFrame([], f"cell int, doc_id {id_type}, row bigint, codes array<bigint>, title_codes array<bigint>, terms array<string>, dfs array<bigint>, n bigint, length bigint").schema
    held = materialize(tok.groupBy("cell").applyInArrow(boosted_cells.encode(to_arrow_schema(kind)), kind), "lexical-cells")
    own = held.where("terms IS NOT NULL")
    listed = own.select("cell", F.posexplode(F.arrays_zip("terms", "dfs")).alias("code", "x")).select("cell", "code", F.col("x.terms").alias("term"), F.col("x.dfs").alias("df")).where("df > 0")
    frequency = materialize(listed.groupBy("term").agg(F.sum("df").alias("df")), "terms")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    stats = Statistics(frequency, total["n"], total["length"] / total["n"] if total["n"] else 0.0)

    asked = _asked_rows(queries, query_id, query_text, stats, method)
    if method == "tfidf":
        dfs = listed.drop("df").join(frequency, "term").groupBy("cell").agg(F.collect_list(F.struct("code", "df")).alias("x"))
        held = held.unionByName(dfs.select("cell", F.col("x.code").cast("array<bigint>").alias("codes"), F.col("x.df").alias("dfs")), allowMissingColumns=True)
    blocks = max(1, ceil(asked.count() / QUERY_BLOCK))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # More partitions than cells, so that few of them hold two cells.
    tasks = 2 * blocks * cells
    left = asked.withColumn("block", spread("query_id", blocks)).withColumn("cell", every(cells)).repartition(tasks, "block", "cell")
    right = held.withColumn("block", every(blocks)).repartition(tasks, "block", "cell")
    found = spark.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, ask bigint, doc_id {id_type}, row bigint, score double, complete boolean").schema
    gain = boosted_cells.binary_gain(stats.avg_len) if method == "bm25" else boosted_cells.log_gain
    idf = boosted_cells.tfidf_idf(stats.n_docs) if method == "tfidf" else None
    pairs = materialize(left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(
        boosted_cells.cell(k, gain, idf, to_arrow_schema(found)), found), "lexical-pairs")
    scored = pairs.where("NOT complete").select("query_id", "doc_id", "score").unionByName(_with_lead(pairs.where("complete"), texts, asked))
    return ranking.min_max(ranking.top_k(scored.where(F.col("score") > 0), k))


def _asked_rows(queries: DataFrame, query_id: str, query_text: str, stats: Statistics, method: str) -> DataFrame:
    """``query_id, ask, tokens, n_terms, terms, weights``: a row for each question; questions of one id share its words."""
    terms = query_terms(queries, query_id, query_text).where("query_id IS NOT NULL")
    idf = term_idf(stats, "binary" if method == "bm25" else "tfidf")
    # Words that no document has are counted among the words of the question.
    known = terms.join(idf, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    weight = F.col("qtf") * F.col("idf")
    if method == "tfidf":
        own = _log_tf(F.col("qtf")) * F.col("idf")
        norm = F.sqrt(F.sum(own * own).over(Window.partitionBy("query_id")))
        weight = F.when(norm > 0, own * F.col("idf") / norm).otherwise(0.0)
    words = known.withColumn("weight", weight).groupBy("query_id").agg(
        F.collect_list(F.struct("term", "weight")).alias("x"), F.count(F.lit(1)).alias("n_terms"))
    words = words.select("query_id", "n_terms", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
    rows = queries.select(F.col(query_id).alias("query_id"), F.xxhash64(query_text).alias("ask"), T.tokenize(F.col(query_text)).alias("tokens"))
    return materialize(rows.where("tokens IS NOT NULL").join(words, "query_id"), "lexical-asked")


def _with_lead(pairs: DataFrame, texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores of complete pairs with the boost for the first sentence; a text is split once for all its questions."""
    met = pairs.select("doc_id", "row").distinct()
    leads = texts.select("doc_id", "row", "text").join(maybe_broadcast(met), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"]).select(
        "doc_id", "row", T.raw_tokens(F.coalesce(F.get(T.split_sentences(F.col("text")), F.lit(0)), F.lit(""))).alias("lead_raw"))
    words = asked.select("query_id", "ask", F.array_distinct("tokens").alias("q_terms")).dropDuplicates(["query_id", "ask"])
    full = pairs.join(leads, ["doc_id", "row"]).join(maybe_broadcast(words), ["query_id", "ask"])
    full = full.withColumn("_at", find_sequence(T.content_only(F.col("lead_raw")), F.col("q_terms"))).withColumn(
        "_raw_at", F.when(F.col("_at") >= 0, find_sequence(F.col("lead_raw"), F.col("q_terms"))).otherwise(-1))
    after = F.col("_raw_at") + F.size("q_terms")
    tail = F.slice("lead_raw", after + 1, F.size("lead_raw"))
    full = full.withColumn(
        "_la", F.when((F.col("_raw_at") >= 0) & F.array_contains(tail, "la"), after + F.array_position(tail, "la") - 1).otherwise(-1))
    return full.select("query_id", "doc_id", (F.col("score") + _lead_boost(full)).alias("score"))


def hybrid(lexical: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """Rank fusion of both legs; queries without dense hits fall back to the lexical leg."""
    cut = lexical.where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")
    cut = ranking.min_max(cut)
    has_dense = dense.select("query_id").distinct()
    # Stored: at most k rows a query, and a union of two coalesced shuffles cannot be zipped by partition.
    fused = materialize(ranking.rrf(lexical.join(has_dense, "query_id", "left_semi"), dense, k), "fused")
    return ranking.with_fallback(fused, cut)


def related_questions(lexical: DataFrame, dense: DataFrame | None, questions: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Fused neighbours of a question without itself and without questions already asked.

    ``questions``: ``doc_id, text``; ``asked``: ``query_id, text`` including the question itself.
    """
    fused = lexical if dense is None else ranking.with_fallback(ranking.rrf(lexical, dense, k + 10), lexical)
    def key(c):
        return F.lower(F.trim(F.col(c)))

    named = fused.select("query_id", "doc_id", "rank").join(questions, "doc_id").withColumn("_key", key("text"))
    seen = asked.select("query_id", key("text").alias("_key")).distinct()
    fresh = named.join(seen, ["query_id", "_key"], "left_anti").withColumn("score", -F.col("rank").cast("double"))
    return ranking.top_k(fresh, k).select("query_id", "doc_id", "rank")
