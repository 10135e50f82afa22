"""Registered queries: index statistics, sparse and dense retrieval, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from askweave.functions import fixed
from askweave.functions import questions as Q
from askweave.functions import text as T
from askweave.operators import chunking, dense, impact_index, ranking, retrieval, text_index, vector_store
from askweave.session import materialize, new_path
from askweave.sources.tables import table

K = 10


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _tok(spark, d):
    return text_index.tokenized(table(spark, d, "documents"))


def _named(hits):
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", "rank", "score")


def term_freq(spark, d):
    post = text_index.postings(_tok(spark, d))
    return post.groupBy("term").agg(F.sum("tf").alias("total_tf"), F.max("tf").alias("max_tf"),
                                    F.min("first_pos").alias("earliest"))


def doc_freq_idf(spark, d):
    stats = text_index.statistics(_tok(spark, d))
    rare = (stats.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)
    return stats.frequency.select("term", "df", F.round(F.log(1 + rare), 6).alias("idf"))


def avg_doc_len(spark, d):
    return _tok(spark, d).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("len"), 6).alias("avg_len"))


def ngram_df(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs = docs.repartition(text_index.parts_for(docs, "text"), "doc_id")
    tok = docs.select("doc_id", retrieval.space_tokens(F.col("text")).alias("tokens"))
    grams = retrieval._gram_rows(tok, "doc_id").distinct()
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def bm25(variant):
    def run(spark, d):
        hits = retrieval.bm25(table(spark, d, "documents"), _asked(spark, d), K, variant)
        return _named(hits)

    return run


def tfidf_cosine(spark, d):
    return _named(retrieval.tfidf(table(spark, d, "documents"), _asked(spark, d), K))


def tfidf_ngram(spark, d):
    return _named(retrieval.hashed_tfidf(table(spark, d, "documents"), _asked(spark, d), K, buckets=None))


def tfidf_hashed(spark, d):
    return _named(retrieval.hashed_tfidf(table(spark, d, "documents"), _asked(spark, d), K))


def _titled(spark, d):
    return Q.add_source_titles(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def lexical(method):
    def run(spark, d):
        hits = retrieval.lexical_retrieve(_titled(spark, d), _asked(spark, d), K, method)
        return hits.select(F.col("query_id").alias("item_id"), "doc_id", "rank", "score", "score_norm")

    return run


def passage_bm25(spark, d):
    docs = table(spark, d, "documents")
    passages = chunking.chunk_documents(docs).select("passage_id", "text")
    hits = retrieval.bm25(passages, _asked(spark, d), K, doc_id="passage_id", parts=text_index.parts_for(docs, "text"))
    return hits.select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("passage_id"), "rank", "score")


def minmax_topk(spark, d):
    hits = retrieval.bm25(table(spark, d, "documents"), _asked(spark, d), K)
    return ranking.min_max(hits).select(F.col("query_id").alias("item_id"), "doc_id", "score_norm")


def softmax_topk(spark, d):
    hits = retrieval.bm25(table(spark, d, "documents"), _asked(spark, d), K)
    return ranking.softmax(hits).select(F.col("query_id").alias("item_id"), "doc_id", "weight")


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return (v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
            v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")))


def dense_search(metric):
    def run(spark, d):
        q, v = _vectors(spark, d)
        return dense.dense_top_k(q, v, K, metric).select(
            F.col("query_id").alias("vec_id"), F.col("doc_id").alias("neighbour"), "rank", "score")

    return run


def _legs(spark, d, k):
    """Boosted lexical leg over documents and dense leg over the vectors of the same ids."""
    lex = materialize(retrieval.lexical_retrieve(_titled(spark, d), _asked(spark, d), k).select("query_id", "doc_id", "score", "rank"), "lexical-leg")
    q, v = _vectors(spark, d)
    known = table(spark, d, "documents").select("doc_id")
    v = v.join(known, "doc_id", "left_semi")
    q = q.join(_asked(spark, d).select("query_id"), "query_id", "left_semi")
    # Stored: k rows a query that several parts of a fusion read.
    return lex, materialize(dense.dense_top_k(q, v, k), "dense-leg")


def hybrid(spark, d):
    lex, den = _legs(spark, d, 3 * K)
    hits = retrieval.hybrid(lex, den, K)
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.round("score", 6).alias("score"), "score_norm")


def preferred(spark, d):
    # Stored: the wishes and the injection read the hits, at most K rows a query, several times.
    hits = materialize(ranking.min_max(retrieval.bm25(table(spark, d, "documents"), _asked(spark, d), K)), "hits")
    # The preferred document of an even item is its fourth hit, of an odd item its own number.
    wish = hits.where((F.col("rank") == 4) & (F.col("query_id") % 2 == 0)).select("query_id", "doc_id").unionByName(
        _asked(spark, d).where("query_id % 2 = 1").select("query_id", F.col("query_id").alias("doc_id")))
    out = ranking.inject_preferred(hits, wish, K)
    return out.select(F.col("query_id").alias("item_id"), "doc_id", "rank", "score", "score_norm")


def compare_retrievers(spark, d):
    lex, den = _legs(spark, d, 9)
    runs = {
        "tfidf": retrieval.lexical_retrieve(_titled(spark, d), _asked(spark, d), 3, "tfidf"), "bm25": lex.where("rank <= 3"),
        "dense": den.where("rank <= 3"), "hybrid": retrieval.hybrid(lex, den, 3),
    }
    out = None
    for name, hits in runs.items():
        part = hits.where("rank <= 3").select(F.lit(name).alias("method"), F.col("query_id").alias("item_id"), "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _stored(spark, d, counts, kind):
    """An index of the documents, stored and loaded again."""
    folder, docs = new_path(spark, "impacts"), table(spark, d, "documents")
    impact_index.save_impacts(counts(docs), docs.count(), folder, kind)
    return impact_index.load_impacts(spark, folder, kind)


def tfidf_cosine_indexed(spark, d):
    index = _stored(spark, d, impact_index.word_counts, "cosine")
    return _named(impact_index.search(index, impact_index.asked_words(_asked(spark, d)), K))


def tfidf_grams_indexed(buckets):
    def run(spark, d):
        index = _stored(spark, d, lambda docs: impact_index.gram_counts(docs, buckets), "product")
        return _named(impact_index.search(index, impact_index.asked_grams(_asked(spark, d), buckets), K))

    return run


def candidate_counts(spark, d):
    return table(spark, d, "benchmark").select(
        "item_id", ranking.candidate_count((F.col("item_id") % 30).cast("int")).alias("candidates"))


def letter_shares(text):
    """Shares of six letters as a vector: an encoder of built-in functions that SQL can repeat."""
    return F.transform(F.array(*[F.lit(c) for c in "aeinrs"]), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.greatest(F.length(text), F.lit(1)))


def stored_vectors(spark, d):
    """Vectors of documents and items from a store that has encoded both and was then cut to the documents' texts."""
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text")
    path, model = new_path(spark, "vector-store"), "letter-shares-1"
    vector_store.sync(docs, "text", letter_shares, path, model)
    vector_store.sync(docs.unionByName(items), "text", letter_shares, path, model)
    vector_store.compact(docs, "text", path, model)
    rows = vector_store.with_vectors(docs.unionByName(items), "text", path, model)
    return rows.select("kind", "id", vector_store.content_key(F.col("text"), model).alias("key"),
                       *[F.round(F.get("vector", F.lit(i)).cast("double"), 4).alias(f"share_{c}") for i, c in enumerate("aeinrs")])


QUERIES = {
    "term_freq": term_freq,
    "doc_freq_idf": doc_freq_idf,
    "avg_doc_len": avg_doc_len,
    "ngram_df": ngram_df,
    "bm25_binary_topk": bm25("binary"),
    "bm25_okapi_topk": bm25("okapi"),
    "bm25_l_topk": bm25("l"),
    "bm25_plus_topk": bm25("plus"),
    "bm25_lucene_topk": bm25("lucene"),
    "tfidf_cosine_topk": tfidf_cosine,
    "tfidf_ngram_topk": tfidf_ngram,
    "tfidf_hashed_topk": tfidf_hashed,
    "tfidf_cosine_indexed_topk": tfidf_cosine_indexed,
    "tfidf_ngram_indexed_topk": tfidf_grams_indexed(None),
    "tfidf_hashed_indexed_topk": tfidf_grams_indexed(fixed.HASH_BUCKETS),
    "lexical_bm25_boosted": lexical("bm25"),
    "lexical_tfidf_boosted": lexical("tfidf"),
    "passage_bm25_topk": passage_bm25,
    "minmax_topk": minmax_topk,
    "softmax_topk": softmax_topk,
    "dense_cosine_topk": dense_search("cosine"),
    "dense_ip_topk": dense_search("ip"),
    "dense_l2_topk": dense_search("l2"),
    "rrf_hybrid": hybrid,
    "preferred_injection": preferred,
    "compare_retrievers": compare_retrievers,
    "candidate_count": candidate_counts,
    "stored_vectors": stored_vectors,
}
