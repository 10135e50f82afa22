"""Registered queries: gold mapping, retrieval metrics, answer metrics, thresholds, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from askweave.functions import text as T
from askweave.operators import gold, metrics, quantiles, retrieval, sampling
from askweave.session import materialize
from askweave.sources.tables import table

QUOTAS = {"en": 30, "de": 10, "fr": 8, "es": 8, "NO_ANSWER": 12}


def predictions(spark, d):
    """Prediction rows from conversation turns: the reply holds the answer, numbers decide the span."""
    talk = table(spark, d, "conversations")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    rows = asked.join(reply, ["conv_id", "turn"]).withColumn("w", F.split(T.squeeze(F.col("context")), " "))
    conv, turn = F.col("conv_id"), F.col("turn")
    # Spans start anywhere in the reply, so that whole replies matter.
    first = (conv + turn) % F.size("w")
    span = F.array_join(F.slice("w", (1 + (first + conv % 3) % F.size("w")).cast("int"), (5 + conv % 2).cast("int")), " ")
    return rows.select(
        (conv * 1000 + turn).alias("id"), "question", "context",
        (conv % 5 != 0).alias("is_answerable"),
        F.when(conv % 5 != 0, F.array_join(F.slice("w", (1 + first).cast("int"), F.lit(6)), " ")).otherwise("").alias("gold_answer"),
        F.when((conv + turn) % 7 == 0, "").otherwise(span).alias("predicted_answer"),
        (((F.length("context") * 7 + turn) % 83 - 41) / 4.0).alias("score_margin"),
    )


def candidates(spark, d):
    """Four candidates per prediction row with scores and flags derived from its id."""
    rows = predictions(spark, d).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    i, j = F.col("id"), F.col("j")

    def score(a, b):
        return ((i * a + j * b) % 101) / 101.0

    def flag(a, m):
        return (i + j * a) % m != 0

    words = F.split(T.squeeze(F.col("context")), " ")
    first = (1 + (i + j) % F.size(words)).cast("int")
    return rows.select(
        "id", (i * 10 + j).alias("candidate_id"),
        F.array_join(F.slice(words, first, F.lit(6)), " ").alias("text"),
        F.array_join(F.slice(words, first, F.lit(7)), " ").alias("raw_text"),
        F.when(j == 2, "").otherwise(F.array_join(F.slice(words, first, F.lit(5)), " ")).alias("display_text"),
        F.when(j == 3, "phrase_fallback").otherwise("neural_span").alias("method"),
        score(31, 17).alias("reader_score"), score(7, 13).alias("retrieval_score"), score(3, 41).alias("answer_type_score"),
        score(11, 5).alias("relation_score"), score(19, 29).alias("boundary_score"), score(23, 3).alias("completeness_score"),
        score(5, 7).alias("cause_pattern_score"), score(13, 11).alias("subject_match_score"),
        score(17, 23).alias("target_relation_score"), score(29, 19).alias("ranking_score"),
        F.when(flag(1, 9), 1.0).otherwise(0.0).alias("evidence_score"),
        F.when(j == 3, 0.9).otherwise(1.0).alias("fallback_penalty"),
        F.when((i + j) % 2 == 0, "CAUSE").otherwise("PURPOSE").alias("relation_type"),
        flag(1, 11).alias("valid_span"), flag(2, 9).alias("passes_evidence_gate"), flag(3, 7).alias("passes_type_gate"),
        flag(5, 13).alias("passes_relation_gate"), flag(7, 8).alias("passes_completeness_gate"),
        flag(3, 5).alias("passes_reader_threshold"), ((i + j) % 3 == 0).alias("require_subject_match"),
        F.lit(0.5).alias("min_subject_score"),
    )


def _questions(spark, d):
    return predictions(spark, d).select("id", "gold_answer", "is_answerable", F.element_at(
        F.array(*[F.lit(b) for b in ("CAUSE", "TIME", "ENTITY", "GENERAL")]), (F.col("id") % 4 + 1).cast("int")).alias("bucket"),
        F.col("predicted_answer").alias("production_answer"))


def _scored(spark, d):
    return metrics.score_predictions(predictions(spark, d))


def _gold(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("context"))
    return gold.gold_mapping(items, table(spark, d, "documents").select("doc_id", "text"))


def gold_mapping(spark, d):
    return _gold(spark, d).select(F.col("query_id").alias("item_id"), "doc_id", "strategy")


def gold_documents(spark, d):
    """The mapping with documents as questions: every strategy and both directions occur."""
    docs = table(spark, d, "documents")
    q = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("context"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return gold.gold_mapping(q, items).select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("item_id"), "strategy")


def near_documents(spark, d):
    """Best other text per document by word overlap, over the distinct documents."""
    # Stored: the join reads the distinct texts on both sides, for their words, and to verify.
    docs = materialize(table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")), "distinct-documents")
    asking = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("context"))
    return gold.best_overlap(asking, docs.select("doc_id", "text"), 0.8, others_only=True).select(F.col("query_id").alias("left_id"), F.col("doc_id").alias("right_id"), "overlap")


def _hits(spark, d, k=50):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return retrieval.bm25(table(spark, d, "documents"), items, k)


def recall_mrr(spark, d):
    return gold.retrieval_metrics(_hits(spark, d), _gold(spark, d))


def recall_mrr_all(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return gold.retrieval_metrics(_hits(spark, d), _gold(spark, d), questions=items)


def recall_by_class(spark, d):
    classes = table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), metrics.length_class(T.count_words(F.col("text"))).alias("class"))
    return gold.recall_by_class(_hits(spark, d, 10), _gold(spark, d), classes, 10)


def dense_recall(spark, d):
    """Recall of dense search with the label as relevance: is a neighbour of the same class in the top k?"""
    from askweave.operators.dense import dense_top_k

    v = table(spark, d, "embeddings")
    hits = dense_top_k(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
                       v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), 11)
    hits = hits.where("query_id <> doc_id")
    a = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    b = v.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl"))
    first = hits.join(a, "query_id").join(b, "doc_id").where("ql = dl").groupBy("query_id").agg(F.min("rank").alias("r"))
    return a.join(first, "query_id", "left").groupBy(F.col("ql").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("r") <= 6, 1.0).otherwise(0.0)), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def em_f1_rows(spark, d):
    s = _scored(spark, d)
    return s.select("id", "em", F.round("f1", 6).alias("f1"), metrics.error_class().alias("error_type"),
                    metrics.result_note(F.col("gold_answer"), F.col("predicted_answer")).alias("note"))


def em_f1_report(spark, d):
    return metrics.report(_scored(spark, d))


def set_overlap(spark, d):
    words = {c: T.split_words(T.normalize_answer(F.col(c))) for c in ("gold_answer", "predicted_answer")}
    rows = predictions(spark, d).withColumns({"g": words["gold_answer"], "p": words["predicted_answer"]})
    return rows.select("id", F.round(metrics.set_f1(F.col("g"), F.col("p")), 6).alias("set_f1"),
                       F.round(metrics.jaccard(F.col("g"), F.col("p")), 6).alias("jaccard"))


def error_taxonomy(spark, d):
    return _scored(spark, d).groupBy(metrics.error_class().alias("error_type")).agg(F.count(F.lit(1)).alias("count"))


def length_hist(spark, d):
    return metrics.length_histogram(_scored(spark, d), "predicted_words")


def ratio_buckets(spark, d):
    return metrics.span_ratio_buckets(_scored(spark, d))


def refinement_outcomes(spark, d):
    rows = candidates(spark, d).join(predictions(spark, d).select("id", "gold_answer"), "id")
    raw = metrics.score_predictions(rows, predicted="raw_text").withColumnRenamed("f1", "raw_f1").drop("em", "gold_words", "predicted_words", "empty")
    both = metrics.score_predictions(raw, predicted="text")
    outcome = metrics.refinement_outcome(F.col("raw_f1"), F.col("f1"), F.col("raw_text") != F.col("text"))
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("count"))


def threshold_sweep(spark, d):
    return metrics.threshold_sweep(_scored(spark, d))


def threshold_best(spark, d):
    return metrics.select_threshold(metrics.threshold_sweep(_scored(spark, d))).select("threshold", "overall_f1", "answerable_f1", "reader_priority_score")


def objectives(spark, d):
    sweep = metrics.threshold_sweep(_scored(spark, d))
    return metrics.threshold_objectives(sweep).select("objective", "threshold", "overall_f1", "answerable_f1", "unanswerable_accuracy")


def score_distribution(spark, d):
    rows = predictions(spark, d).withColumn("confidence", metrics.display_confidence(F.col("score_margin")))
    return metrics.score_distribution(rows, ["score_margin", "confidence"])


def percentile_nearest(spark, d):
    return quantiles.quantile_columns(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, ["event_type"], "nearest")


def percentile_linear(spark, d):
    return quantiles.quantile_columns(table(spark, d, "events"), "value", {"p10": 0.1, "p50": 0.5, "p95": 0.95}, ["event_type"])


def grid_search(spark, d):
    return metrics.grid_search(_questions(spark, d), candidates(spark, d)).select(
        "config", "penalty", "threshold", "overall_em", "overall_f1", "answerable_f1", "unanswerable_accuracy", "reader_priority_score")


def grid_winners(spark, d):
    from askweave.session import materialize

    grid = materialize(metrics.grid_search(_questions(spark, d), candidates(spark, d)), "grid")
    return metrics.grid_winners(grid).select("config", "selection", "penalty", "threshold", "overall_f1", "reader_priority_score")


def ablation(spark, d):
    return metrics.ablation(_questions(spark, d), candidates(spark, d)).select(
        "variant", "bucket", "overall_count", "overall_em", "overall_f1", "answerable_f1", "unanswerable_accuracy",
        "false_positive", "false_negative")


def _sampling_rows(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("question"),
                                               (F.col("n_chars") % 3 != 0).alias("is_answerable"), F.col("lang").alias("bucket"))


def quota_sample(spark, d):
    return sampling.holdout(_sampling_rows(spark, d), QUOTAS, "seed-1").select("id", "bucket", "stratum", "order_key")


def round_robin(spark, d):
    rows = _sampling_rows(spark, d).withColumn("key", sampling.stable_key("seed-2", F.col("id")))
    return sampling.round_robin(rows, ["bucket", "is_answerable"], "key", 50).select("id", "bucket", "is_answerable", "turn", "position")


def rebalance(spark, d):
    rows = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("flag"))
    return sampling.rebalance(rows.withColumn("key", sampling.stable_key("seed-3", F.col("doc_id"))), "flag", "key").select("doc_id", "flag")


def ranking_counts(spark, d):
    """Counters over the best candidate of each prediction row that passes the reader threshold."""
    best = candidates(spark, d).where("passes_reader_threshold").groupBy("id").agg(F.max_by(
        F.struct("text", "raw_text", "ranking_score"), F.struct("ranking_score", -F.col("candidate_id"))).alias("b"))
    rows = predictions(spark, d).join(best, "id", "left").select(
        "is_answerable", "gold_answer", F.coalesce("b.text", F.lit("")).alias("predicted_answer"), F.col("context").alias("passages"),
        F.col("b.raw_text").alias("selected"), F.col("b.ranking_score").alias("ranking_score"))
    return metrics.ranking_counters(rows, 0.7)


QUERIES = {f.__name__: f for f in (
    gold_mapping, gold_documents, near_documents, recall_mrr, recall_mrr_all, recall_by_class, dense_recall, em_f1_rows,
    em_f1_report, set_overlap, error_taxonomy, length_hist, ratio_buckets, refinement_outcomes, threshold_sweep,
    threshold_best, objectives, score_distribution, percentile_nearest, percentile_linear, grid_search, grid_winners,
    ablation, quota_sample, round_robin, rebalance, ranking_counts)}
