"""Registered queries: related questions and follow-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from askweave.functions import questions as Q
from askweave.functions import subjects
from askweave.functions import text as T
from askweave.operators import followups, retrieval, text_index
from askweave.plans.evaluation_queries import candidates
from askweave.plans.semantics_queries import framed
from askweave.session import materialize, new_path
from askweave.sources.tables import table


def plain_tokens(x):
    return T.words(F.lower(x), T.WORD)


def related_questions(spark, d):
    """Three related user turns per benchmark item, without items equal to it or already asked."""
    talk = table(spark, d, "conversations").where("role = 'user'")
    known = talk.groupBy(F.trim("text").alias("text")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = retrieval.bm25(known, items, 13, "okapi", tokenizer=plain_tokens)
    # The best neighbour of every third item counts as asked before.
    before = hits.where("rank = 1 and query_id % 3 = 0").join(known, "doc_id").select("query_id", "text")
    asked = items.select("query_id", F.col("question").alias("text")).unionByName(before)
    return retrieval.related_questions(hits, None, known, asked, 3).select(F.col("query_id").alias("item_id"), F.col("doc_id").alias("turn_id"), "rank")


def _ranked_rows(spark, d):
    c = candidates(spark, d)
    return c.select(F.col("id").alias("question_id"), F.col("candidate_id").alias("ordinal"), F.col("reader_score").alias("answerability"),
                    F.col("retrieval_score").alias("relevance"), F.col("relation_score").alias("novelty"),
                    F.concat(F.lit("g"), (F.col("candidate_id") % 3).cast("string")).alias("group"))


def followup_rank(spark, d):
    return followups.rank(_ranked_rows(spark, d)).select("question_id", "ordinal", "ranking_score", "rank")


def duplicate_questions(spark, d):
    talk = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return followups.similar_questions(talk, "id", "text", 0.6)


def question_similarity(spark, d):
    q = framed(spark, d)
    items = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return q.join(items, "id").select("id", F.round(followups.question_similarity(F.col("question"), F.col("text")), 6).alias("similarity"))


def _contexts(spark, d):
    """Each question with a passage about its subject that holds the whole reply."""
    asked = Q.annotate_questions(framed(spark, d)).select(F.col("id").alias("question_id"), "question", "subject", "relation", "target", "predicate")
    # Written before filtering: a filter on a parsed column would pull the whole parser into its condition.
    asked = materialize(asked, "asked")
    reply = table(spark, d, "conversations").where("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("question_id"), F.col("conv_id").cast("string").alias("passage_id"),
        F.lower(T.squeeze(F.col("text"))).alias("w"))
    body = ("{s} sinh năm 1901 tại thành phố Huế. {s} tham gia phong trào {w} vì lý do riêng. "
            "{s} được thành lập nhằm nghiên cứu {w}. {s} khác với {w}.")
    text = F.replace(F.replace(F.lit(body), F.lit("{w}"), F.col("w")), F.lit("{s}"), F.col("subject"))
    rows = asked.join(reply, "question_id").where("subject is not null").withColumn("context", text)
    return rows.withColumns({"answer": F.lit("năm 1901"), "relevance": F.lit(1.0), "is_selected": F.lit(True), "position": F.lit(1)})


def follow_ups(spark, d):
    return followups.follow_ups(_contexts(spark, d)).select("question_id", "rank", "text", "followup", "ranking_score")


def followup_funnel(spark, d):
    return followups.funnel(followups.gate(followups.discover(_contexts(spark, d))))


def subject_focus(spark, d):
    """Focus and inferred subject of each framed user turn, cut to so many words that subjects of all lengths occur."""
    q = framed(spark, d).withColumn("w", F.split("question", " "))
    q = q.select("id", F.array_join(F.slice("w", F.lit(1), (1 + F.col("id") % 9).cast("int")), " ").alias("phrase"))
    frame = F.element_at(F.array(*[F.lit(x) for x in ("{} là ai?", "Vai trò của {}", "{} sinh năm nào?", "Vì sao {} xảy ra?", "{}")]), (F.col("id") % 5 + 1).cast("int"))
    q = q.withColumn("asked", F.replace(frame, F.lit("{}"), F.col("phrase")))
    return q.select("id", subjects.focus_subject(F.col("asked")).alias("focus"), subjects.infer_subject(F.col("asked")).alias("inferred"))


def follow_ups_probed(spark, d):
    """Follow-ups of weakly grounded passages; a second search over all passages confirms them or not."""
    weak = materialize(_contexts(spark, d), "probe-contexts").withColumns({"relevance": F.lit(0.1), "is_selected": F.lit(False)})
    passages = weak.select("passage_id", "context").dropDuplicates(["passage_id"])
    folder = new_path(spark, "probe-index")
    text_index.save_index(text_index.tokenized(passages, "passage_id", "context"), folder)
    post, stats = text_index.load_index(spark, folder)
    return followups.follow_ups_probed(weak, passages, post, stats).select("question_id", "rank", "text", "followup", "tier", "passage_id", "ranking_score")


QUERIES = {f.__name__: f for f in (related_questions, followup_rank, duplicate_questions, question_similarity, follow_ups, followup_funnel, subject_focus, follow_ups_probed)}
