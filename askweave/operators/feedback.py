"""Feedback log: validation, de-duplication, conflicts, review, analytics, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askweave.functions import fixed
from askweave.functions import text as T


def classify_gap(df: DataFrame) -> Column:
    """What kind of gap a feedback row shows; null for correct answers.

    Uses ``feedback_type, corrected_passage_id, retrieved_passage_ids,
    corpus_support_found, selected_passage_id, rejection_reason``.
    """
    kind = F.upper(F.coalesce(F.col("feedback_type"), F.lit("")))
    corrected = F.coalesce(F.col("corrected_passage_id"), F.lit("")) != ""
    selected = F.coalesce(F.col("selected_passage_id"), F.lit("")) != ""
    complaint = kind.isin("INCORRECT", "ANSWERED_BUT_SHOULD_NOT") | (F.coalesce(F.col("rejection_reason"), F.lit("")) != "")
    inside = F.array_contains("retrieved_passage_ids", F.col("corrected_passage_id"))
    return (
        F.when(kind == "CORRECT", F.lit(None).cast("string"))
        .when(F.col("corpus_support_found") == False, "CORPUS_GAP")  # noqa: E712 - null must not match
        .when(corrected & F.col("retrieved_passage_ids").isNull(), "UNKNOWN_GAP")
        .when(corrected & inside, "READER_SEMANTIC_GAP")
        .when(corrected, "RETRIEVAL_GAP")
        .when(selected & complaint, "READER_SEMANTIC_GAP")
        .otherwise("UNKNOWN_GAP")
    )


def parse_id_list(x: Column) -> Column:
    """JSON array of strings; anything unreadable becomes an empty array."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def fingerprint(columns: list[str]) -> Column:
    parts = [T.normalize_feedback(F.col(c).cast("string")) for c in columns]
    return F.sha2(F.concat_ws(fixed.FINGERPRINT_SEPARATOR, *parts), 256)


FINGERPRINT_COLUMNS = ["question", "predicted_answer", "feedback_type", "corrected_passage_id", "corrected_answer",
                       "corrected_start_char", "corrected_end_char"]


def _longest(df: DataFrame, *columns: str) -> Column:
    """Characters of the longest of the columns that ``df`` has."""
    return F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.length(c), F.lit(0)) for c in columns if c in df.columns])


def validate(df: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split submissions into valid rows and rows with an ``error``.

    ``passages``: ``passage_id, text``.  A correction must quote its passage at the
    given offsets; the stored answer is the quoted text.
    """
    def text(c):
        return F.nullif(T.strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))

    df = df.withColumns({
        "question": text("question"), "feedback_type": F.upper(F.coalesce(text("feedback_type"), F.lit(""))),
        "corrected_answer": text("corrected_answer"), "selected_passage_id": text("selected_passage_id"),
        "corrected_passage_id": text("corrected_passage_id"),
    })
    start, end = F.col("corrected_start_char"), F.col("corrected_end_char")
    any_fix = F.col("corrected_answer").isNotNull() | start.isNotNull() | end.isNotNull()
    target = F.when(any_fix, F.coalesce(F.col("corrected_passage_id"), F.col("selected_passage_id")))
    df = df.withColumn("_target", target).withColumn("_row", F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256))
    known = passages.select(F.col("passage_id"), F.lit(True).alias("_known"))
    chosen = known.select(F.col("passage_id").alias("selected_passage_id"), F.col("_known").alias("_selected_known"))
    body = passages.select(F.col("passage_id").alias("_target"), F.col("text").alias("_body"))
    listed = df.select("_row", F.explode("retrieved_passage_ids").alias("passage_id")).distinct()
    unknown = listed.join(known, "passage_id", "left_anti").groupBy("_row").agg(F.min("passage_id").alias("_unknown"))
    j = df.join(chosen, "selected_passage_id", "left").join(body, "_target", "left").join(unknown, "_row", "left")
    span = F.substring("_body", start + 1, end - start)
    error = (
        F.when(F.col("question").isNull(), "the question is missing")
        .when(F.length("question") > 2000, "the question is longer than 2000 characters")
        .when(_longest(df, "selected_passage_id", "corrected_passage_id") > 300, "an id is longer than 300 characters")
        .when(_longest(df, "note") > 4000, "the note is longer than 4000 characters")
        .when(~F.col("feedback_type").isin([t for t in fixed.FEEDBACK_TYPES if t != "DOCUMENT_SUBMISSION"]), "unknown type of feedback")
        .when(F.col("selected_passage_id").isNotNull() & F.col("_selected_known").isNull(),
              F.concat(F.lit("no such passage: "), F.col("selected_passage_id")))
        .when(F.col("_unknown").isNotNull(), F.concat(F.lit("no such passage: "), F.col("_unknown")))
        .when((F.col("feedback_type") == "SPAN_CORRECTION") & ~any_fix, "a span correction without a span")
        .when(any_fix & (F.col("_target").isNull() | F.col("corrected_answer").isNull() | start.isNull() | end.isNull()),
              "a correction needs its passage, answer and offsets")
        .when(any_fix & F.col("_body").isNull(), F.concat(F.lit("no such passage: "), F.col("_target")))
        .when(any_fix & ((start < 0) | (end <= start) | (end > F.length("_body"))), "the offsets lie outside the passage")
        .when(any_fix & (T.normalize_feedback(span) != T.normalize_feedback(F.col("corrected_answer"))),
              "the answer is not the passage's text at the offsets")
        .when(~any_fix & F.col("corrected_passage_id").isNotNull(), "a corrected passage without a span")
    )
    j = j.withColumn("error", error).withColumns({
        "corrected_passage_id": F.col("_target"), "corrected_answer": F.when(any_fix, span),
    })
    drop = ["_target", "_row", "_selected_known", "_body", "_unknown"]
    return j.where("error is null").drop("error", *drop), j.where("error is not null").drop(*drop)


def deduplicate(df: DataFrame, keys: list[str] | None = None, time: str = "timestamp", row_id: str = "feedback_id") -> DataFrame:
    """One row per fingerprint: the first submission with its count and last time seen.

    ``min_by`` is a partial aggregate, so a fingerprint that makes up a third of
    the log still leaves each task as one row.
    """
    df = df.withColumn("fingerprint", fingerprint(keys or FINGERPRINT_COLUMNS))
    rest = [c for c in df.columns if c != "fingerprint"]
    first = F.min_by(F.struct(*rest), F.struct(F.col(time), F.col(row_id))).alias("_first")
    grouped = df.groupBy("fingerprint").agg(first, F.count(F.lit(1)).alias("duplicate_count"), F.max(time).alias("last_seen"))
    return grouped.select("_first.*", "fingerprint", "duplicate_count", "last_seen")


def mark_conflicts(df: DataFrame) -> DataFrame:
    """Flag corrections that disagree with another live correction of the same question and passage.

    A row conflicts when some non-rejected other row has a different span.  Per
    group only the distinct live spans are counted; rows are never paired.
    """
    has_fix = F.col("corrected_answer").isNotNull() & F.col("corrected_passage_id").isNotNull()
    question = T.normalize_feedback(F.col("question"))
    span = F.concat_ws("␟", "corrected_start_char", "corrected_end_char", "corrected_answer")
    df = df.withColumns({"_q": F.sha2(question, 256), "_span": F.when(has_fix, F.sha2(span, 256))})
    live = df.where(has_fix & (F.col("status") != "REJECTED")).groupBy("_q", "corrected_passage_id").agg(
        F.min("_span").alias("_low"), F.max("_span").alias("_high")
    )
    joined = df.join(live, ["_q", "corrected_passage_id"], "left")
    # Another span exists unless both extremes equal the row's own.
    differs = has_fix & F.col("_low").isNotNull() & ((F.col("_low") != F.col("_span")) | (F.col("_high") != F.col("_span")))
    return joined.withColumn("conflict", F.coalesce(differs, F.lit(False))).drop("_q", "_span", "_low", "_high")


def latest_review(df: DataFrame, reviews: DataFrame) -> DataFrame:
    """Apply a review log: the last decision per feedback wins.  ``reviews``: ``feedback_id, decision, note, reviewed_at``."""
    allowed = reviews.where(F.upper("decision").isin(fixed.REVIEW_DECISIONS))
    last = allowed.groupBy("feedback_id").agg(
        F.max_by(F.struct(F.upper("decision").alias("decision"), "note"), F.struct("reviewed_at", "decision")).alias("r")
    )
    joined = df.join(last, "feedback_id", "left")
    return joined.withColumns({
        "status": F.coalesce(F.col("r.decision"), F.col("status")), "review_note": F.col("r.note"),
    }).drop("r")


def by_status(df: DataFrame, status: str | None = None, limit: int | None = None, time: str = "timestamp") -> DataFrame:
    """Newest first, optionally of one status; ``limit`` is clamped to 1..1000 as a listing page."""
    if status:
        if status.upper() not in fixed.FEEDBACK_STATUSES:
            raise ValueError("no such status")
        df = df.where(F.col("status") == status.upper())
    df = df.orderBy(F.desc(time))
    return df if limit is None else df.limit(min(1000, max(1, int(limit))))


# --- analytics -------------------------------------------------------------------------

def _weight() -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.col("duplicate_count"), F.lit(1))).cast("long")


def _is(*kinds: str) -> Column:
    return F.coalesce(F.col("feedback_type").isin(*kinds), F.lit(False))


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, _weight()).otherwise(0)), F.lit(0))


def blind_spot_score(rate: Column, n: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), rate) * F.log1p(F.greatest(F.lit(0), n)), 6)


def _label(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("UNKNOWN"))


def buckets(df: DataFrame, column: str) -> DataFrame:
    """Weighted outcome counts per value; complaints about missing answers are counted apart."""
    no = _is(*fixed.NO_ANSWER_COMPLAINTS)
    grouped = df.groupBy(_label(column).alias(column)).agg(
        F.sum(_weight()).alias("total"), _sum(_is("CORRECT")).alias("correct"),
        _sum(~_is("CORRECT") & ~no).alias("incorrect"), _sum(no).alias("no_answer"),
    )
    rate = (F.col("incorrect") + F.col("no_answer")) / F.col("total")
    return grouped.withColumns({"failure_rate": F.round(rate, 6), "blind_spot_score": blind_spot_score(rate, F.col("total"))})


def summary(df: DataFrame) -> DataFrame:
    """Weighted totals; "incorrect" here is everything that is not correct, pending is a row count."""
    total = F.coalesce(F.sum(_weight()), F.lit(0))
    s = df.agg(
        total.alias("total_feedback"), F.count(F.lit(1)).alias("unique_records"), _sum(_is("CORRECT")).alias("correct"),
        _sum(_is(*fixed.NO_ANSWER_COMPLAINTS)).alias("no_answer_complaints"),
        F.count(F.when(F.col("status") == "PENDING", 1)).alias("pending_review"),
        _sum(~F.coalesce(F.col("synthetic"), F.lit(False))).alias("real_feedback"),
    )
    n = F.col("total_feedback")
    s = s.withColumns({"incorrect": n - F.col("correct"), "synthetic_feedback": n - F.col("real_feedback")})

    def rate(c):
        return F.when(n > 0, F.round(F.col(c) / n, 6)).otherwise(0.0)

    return s.withColumns({"correct_rate": rate("correct"), "incorrect_rate": rate("incorrect"),
                          "no_answer_complaint_rate": rate("no_answer_complaints")})


def trend(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Weighted counts per day; complaints count as "no_answer" and as "incorrect"."""
    return df.groupBy(F.date_format(time, "yyyy-MM-dd").alias("date")).agg(
        F.sum(_weight()).alias("total"), _sum(_is("CORRECT")).alias("correct"), _sum(~_is("CORRECT")).alias("incorrect"),
        _sum(_is(*fixed.NO_ANSWER_COMPLAINTS)).alias("no_answer"),
    )


def heatmap(df: DataFrame) -> DataFrame:
    cells = df.groupBy(_label("question_type").alias("question_type"), _label("semantic_relation").alias("relation")).agg(
        F.sum(_weight()).alias("total"), _sum(~_is("CORRECT")).alias("failures")
    )
    rate = F.col("failures") / F.col("total")
    return cells.withColumns({"failure_rate": F.round(rate, 6), "blind_spot_score": blind_spot_score(rate, F.col("total"))})


def top_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Weighted counts of non-blank values, most frequent first (value breaks ties)."""
    value = F.trim(F.coalesce(F.col(column), F.lit("")))
    counted = df.where(value != "").groupBy(value.alias(column)).agg(F.sum(_weight()).alias("count"))
    ordered = counted.orderBy(F.desc("count"), column)
    return ordered if limit is None else ordered.limit(limit)


def export_corrections(df: DataFrame, passages: DataFrame) -> DataFrame:
    """Approved corrections with their passage, oldest first, ready for a JSON-lines sink."""
    chosen = df.where(
        (F.col("status") == "APPROVED") & (F.coalesce(F.col("corrected_passage_id"), F.lit("")) != "")
        & F.col("corrected_answer").isNotNull() & F.col("corrected_start_char").isNotNull()
    )
    body = passages.select(F.col("passage_id").alias("corrected_passage_id"), F.col("text").alias("context"))
    def version(c):
        return F.col(c) if c in df.columns else F.lit(None).cast("string")

    return chosen.join(body, "corrected_passage_id").select(
        "question", "context", F.col("corrected_answer").alias("answer_text"),
        F.col("corrected_start_char").cast("int").alias("answer_start"), F.lit("human_feedback").alias("source"), "feedback_id",
        F.struct(version("model_version").alias("reader"), version("corpus_version").alias("corpus"),
                 version("semantic_policy_version").alias("semantic_policy")).alias("system_version"), "timestamp",
    ).orderBy("timestamp", "feedback_id").drop("timestamp")


def with_passages(df: DataFrame, passages: DataFrame) -> DataFrame:
    """Review view: each row with the corrected, else the selected passage; rows without one stay."""
    key = F.coalesce(F.nullif("corrected_passage_id", F.lit("")), F.col("selected_passage_id"))
    body = passages.select(F.col("passage_id").alias("shown_passage_id"), F.col("text").alias("passage_text"))
    return df.withColumn("shown_passage_id", key).join(body, "shown_passage_id", "left")


def submit_documents(df: DataFrame) -> DataFrame:
    """Document submissions with a validation error or the status they enter review with."""
    error = (
        F.when(T.strip(F.coalesce(F.col("title"), F.lit(""))) == "", "title is required")
        .when(T.strip(F.coalesce(F.col("text"), F.lit(""))) == "", "text is required")
        .when(~F.upper(F.coalesce(F.col("source_type"), F.lit(""))).isin(fixed.DOCUMENT_SOURCE_TYPES), "unsupported source_type")
    )
    return df.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "PENDING_REVIEW"))
