"""Top-k, score normalisation, rank fusion and rank combination for sets of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askweave.functions import fixed


def top_k(scored: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", score: str = "score",
          ascending: bool = False) -> DataFrame:
    """Best ``k`` rows per query; ties go to the smaller document id.

    The rank filter lets Spark keep only ``k`` rows per query and task before
    the exchange.  Scores are rounded first so that order does not hang on the
    last bits of a sum.
    """
    scored = scored.withColumn(score, F.round(score, 6))
    order = F.col(score).asc() if ascending else F.col(score).desc()
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(order, F.col(doc))))
    return ranked.where(F.col("rank") <= k)


def min_max(hits: DataFrame, query: str = "query_id", score: str = "score", name: str = "score_norm") -> DataFrame:
    """Min-max over the rows kept per query; a constant list becomes 1 (positive) or 0."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    near = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(low), F.abs(high))
    value = F.when(near, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((F.col(score) - low) / (high - low))
    return hits.withColumn(name, F.round(value, 6))


def softmax(hits: DataFrame, query: str = "query_id", score: str = "score", name: str = "weight") -> DataFrame:
    w = Window.partitionBy(query)
    shifted = F.exp(F.least(F.lit(50.0), F.col(score) - F.max(score).over(w)))
    hits = hits.withColumn("_e", shifted)
    return hits.withColumn(name, F.round(F.col("_e") / F.sum("_e").over(w), 6)).drop("_e")


def rrf(left: DataFrame, right: DataFrame, k: int, constant: int = fixed.RRF_K, query: str = "query_id",
        doc: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists.

    A document missing from one list takes the length of the longer list plus
    one.  The two lists are stacked and grouped, which needs one exchange and
    treats both sides alike.
    """
    stacked = left.select(query, doc, F.col("rank").alias("a"), F.lit(None).cast("int").alias("b")).unionByName(
        right.select(query, doc, F.lit(None).cast("int").alias("a"), F.col("rank").alias("b"))
    )
    merged = stacked.groupBy(query, doc).agg(F.min("a").alias("rank_a"), F.min("b").alias("rank_b"))
    w = Window.partitionBy(query)
    merged = merged.withColumn("_missing", F.greatest(F.count("rank_a").over(w), F.count("rank_b").over(w)) + 1)
    fused = sum((1.0 / (constant + F.coalesce(F.col(c), F.col("_missing"))) for c in ("rank_a", "rank_b")), F.lit(0.0))
    return min_max(top_k(merged.withColumn("score", F.round(fused, 9)).drop("_missing"), k, query, doc), query)


def with_fallback(primary: DataFrame, backup: DataFrame, query: str = "query_id") -> DataFrame:
    """``primary`` hits, and ``backup`` hits for the queries without any."""
    rest = backup.join(primary.select(query).distinct(), query, "left_anti")
    return primary.unionByName(rest, allowMissingColumns=True)


def candidate_count(k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.least(
        F.lit(fixed.CANDIDATES_MAX), F.greatest(k, F.lit(fixed.CANDIDATES_MIN), fixed.CANDIDATES_FACTOR * k)
    )


def clamp_top_k(value: int | None) -> int:
    return min(fixed.TOP_K_MAX, max(1, int(value or fixed.TOP_K_DEFAULT)))


def inject_preferred(hits: DataFrame, preferred: DataFrame, limit: int, query: str = "query_id",
                     doc: str = "doc_id") -> DataFrame:
    """Put a preferred document first; others keep their order below a capped score.

    ``preferred`` holds at most one document per query.  A query without a
    preferred document keeps its hits unchanged.
    """
    chosen = preferred.select(F.col(query), F.col(doc).alias("_preferred"))
    joined = hits.join(chosen, query, "left")
    is_it = F.col(doc) == F.col("_preferred")
    top = joined.where(F.col("_preferred").isNotNull()).groupBy(query).agg(
        F.max(F.when(is_it, F.col("score"))).alias("_own"), F.max("score").alias("_best")
    )
    first = chosen.join(top, query, "left").select(
        query, F.col("_preferred").alias(doc), F.coalesce("_own", "_best", F.lit(0.0)).alias("score"),
        F.lit(1.0).alias("score_norm"), F.lit(0).alias("_old"), F.lit(True).alias("_has"),
    )
    has = F.col("_preferred").isNotNull()
    others = joined.where(~F.coalesce(is_it, F.lit(False))).select(
        query, doc, "score",
        F.when(has, F.least(F.lit(fixed.PREFERRED_CAP), F.col("score_norm"))).otherwise(F.col("score_norm")).alias("score_norm"),
        F.col("rank").alias("_old"), has.alias("_has"),
    )
    ranked = first.unionByName(others).withColumn(
        "rank", F.row_number().over(Window.partitionBy(query).orderBy("_old", doc))
    )
    return ranked.where(~F.col("_has") | (F.col("rank") <= limit)).drop("_old", "_has")


def check_weights(**weights: float) -> None:
    if any(w < 0 for w in weights.values()):
        raise ValueError("a ranking weight is below zero")
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("ranking weights do not add up to 1")


def combine(retrieval: Column, reader: Column, answer_type: Column, relation: Column | float = 0.0,
            w_retrieval: float = fixed.RANKING_WEIGHTS["retrieval"], w_reader: float = fixed.RANKING_WEIGHTS["reader"],
            w_type: float = fixed.RANKING_WEIGHTS["answer_type"], w_relation: float | None = None) -> Column:
    """Weighted sum of the ranking signals; the relation weight defaults to what is left of 1."""
    if w_relation is None:
        w_relation = max(0.0, 1.0 - w_retrieval - w_reader - w_type)
    check_weights(retrieval=w_retrieval, reader=w_reader, answer_type=w_type, relation=w_relation)
    return retrieval * w_retrieval + reader * w_reader + answer_type * w_type + relation * F.lit(w_relation)


def reader_signal(reader: Column, penalty: Column, boundary: Column, completeness: Column) -> Column:
    return reader * penalty * (0.5 + 0.5 * boundary) * (0.5 + 0.5 * completeness)


def keep_selected_visible(hits: DataFrame, k: int, selected: str, query: str = "query_id") -> DataFrame:
    """First ``k`` rows per query; a selected row outside them replaces the last one."""
    late = F.max(F.when(F.col(selected) & (F.col("rank") > k), 1).otherwise(0)).over(Window.partitionBy(query))
    hits = hits.withColumn("_late", late)
    keep = (F.col("rank") < k) | ((F.col("rank") == k) & (F.col("_late") == 0)) | (F.col(selected) & (F.col("_late") == 1))
    return hits.where(keep).drop("_late")
