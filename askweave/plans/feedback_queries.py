"""Registered queries: feedback log derived from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from askweave.operators import feedback
from askweave.sources.tables import table
from askweave.streaming import feedback_stream


def feedback_rows(events):
    """Events as feedback: type and status from the event, passage and span from its properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "click", "CORRECT").when(F.col("event_type") == "error", "INCORRECT")
        .when(F.col("event_type") == "view", "NO_ANSWER_BUT_SHOULD_HAVE").when(F.col("event_type") == "purchase", "SPAN_CORRECTION")
        .otherwise("ANSWERED_BUT_SHOULD_NOT")
    )
    fix = F.col("event_type") == "purchase"
    e = events.withColumn("k", k)
    return e.select(
        F.col("event_id").alias("feedback_id"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("Question "), (F.col("user_id") % 40).cast("string")).alias("question"),
        F.concat(F.lit("answer "), (F.col("k") % 5).cast("string")).alias("predicted_answer"), kind.alias("feedback_type"),
        F.element_at(F.array(*[F.lit(v) for v in ("TIME", "PERSON", "LOCATION", "")]), (F.col("user_id") % 4 + 1).cast("int")).alias("question_type"),
        F.element_at(F.array(F.lit("CAUSE"), F.lit("EVENT_TIME"), F.lit(None).cast("string")), (F.col("user_id") % 3 + 1).cast("int")).alias("semantic_relation"),
        F.when(F.col("k") % 3 != 0, (F.col("k") % 20).cast("string")).alias("selected_passage_id"),
        F.when(fix, (F.col("k") % 7).cast("string")).alias("corrected_passage_id"),
        F.when(fix, F.concat(F.lit("span "), (F.col("k") % 3).cast("string"))).alias("corrected_answer"),
        F.when(fix, F.col("k") % 3).alias("corrected_start_char"), F.when(fix, F.col("k") % 3 + 6).alias("corrected_end_char"),
        F.when(F.col("k") % 4 != 0, F.array((F.col("k") % 7).cast("string"), (F.col("k") % 20).cast("string"))).alias("retrieved_passage_ids"),
        F.when(F.col("k") % 6 == 0, F.concat(F.lit("REASON_"), (F.col("k") % 17).cast("string"))).alias("rejection_reason"),
        F.when(F.col("k") % 10 == 0, F.lit(False)).alias("corpus_support_found"),
        F.element_at(F.array(*[F.lit(v) for v in ("PENDING", "APPROVED", "REJECTED", "REVIEWED")]), (F.col("event_id") % 4 + 1).cast("int")).alias("status"),
        (F.col("value") < 5).alias("synthetic"),
    )


def _log(spark, d):
    rows = feedback_rows(table(spark, d, "events"))
    return rows.withColumn("gap_type", feedback.classify_gap(rows))


def _store(spark, d):
    return feedback.deduplicate(_log(spark, d))


def _passages(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("passage_id"), "text")


def fb_dedup(spark, d):
    return _store(spark, d).select("feedback_id", "fingerprint", "duplicate_count", "timestamp", "last_seen", "status")


def fb_conflicts(spark, d):
    return feedback.mark_conflicts(_store(spark, d)).select("feedback_id", "conflict")


def gap_classify(spark, d):
    return _log(spark, d).groupBy("feedback_type", "gap_type").agg(F.count(F.lit(1)).alias("count"))


def fb_summary(spark, d):
    return feedback.summary(_store(spark, d))


def fb_buckets(spark, d):
    return feedback.buckets(_store(spark, d), "semantic_relation")


def fb_buckets_type(spark, d):
    return feedback.buckets(_store(spark, d), "question_type")


def fb_trend(spark, d):
    return feedback.trend(_store(spark, d))


def fb_heatmap(spark, d):
    return feedback.heatmap(_store(spark, d))


def fb_top_reasons(spark, d):
    return feedback.top_values(_store(spark, d), "rejection_reason", feedback.fixed.TOP_REASONS)


def fb_status_counts(spark, d):
    return _store(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.sum("duplicate_count").alias("submissions"))


def fb_gap_types(spark, d):
    return feedback.top_values(_store(spark, d), "gap_type")


def fb_review_latest(spark, d):
    """Every event reviews the feedback of half its number; the latest review of each counts."""
    events = table(spark, d, "events")
    reviews = events.select(
        F.floor(F.col("event_id") / 2).alias("feedback_id"), F.col("ts").alias("reviewed_at"),
        F.element_at(F.array(*[F.lit(v) for v in ("approved", "rejected", "reviewed", "bogus")]), (F.col("user_id") % 4 + 1).cast("int")).alias("decision"),
        F.col("event_type").alias("note"))
    return feedback.latest_review(_log(spark, d), reviews).select("feedback_id", "status", "review_note")


def fb_export(spark, d):
    out = feedback.export_corrections(_store(spark, d), _passages(spark, d))
    return out.select("feedback_id", "question", F.md5("context").alias("context_md5"), "answer_text", "answer_start", "source")


def fb_review_view(spark, d):
    out = feedback.with_passages(_store(spark, d), _passages(spark, d))
    return out.select("feedback_id", "shown_passage_id", F.length("passage_text").alias("passage_chars"))


def fb_validate(spark, d):
    """Corrections checked against the passages they quote; invalid ones with their reason."""
    rows = _log(spark, d)
    good, bad = feedback.validate(rows, _passages(spark, d))
    both = good.select("feedback_id", F.lit("ok").alias("result")).unionByName(bad.select("feedback_id", F.col("error").alias("result")))
    return both.groupBy("result").agg(F.count(F.lit(1)).alias("count"))


def fb_trend_stream(spark, d):
    """The daily trend as a stream over the event files, read until all input is processed."""
    from uuid import uuid4

    from askweave.session import checkpoint_folder

    folder = f"{checkpoint_folder(spark)}/askweave/stream-{uuid4().hex}"
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = feedback_rows(source).withColumn("duplicate_count", F.lit(1)).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    trend = feedback_stream.daily_trend(rows, delay="365 days")
    # Complete counts per day replace the batch folder; the last batch holds the answer.
    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    run = trend.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(save)
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("date", "total", "correct", "incorrect", "no_answer")


QUERIES = {f.__name__: f for f in (
    fb_dedup, fb_conflicts, gap_classify, fb_summary, fb_buckets, fb_buckets_type, fb_trend, fb_heatmap, fb_top_reasons,
    fb_status_counts, fb_gap_types, fb_review_latest, fb_export, fb_review_view, fb_validate, fb_trend_stream)}
