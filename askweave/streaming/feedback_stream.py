"""Incremental feedback analytics with Structured Streaming.

The batch operators define the results; the streams here keep them up to date
as the log grows.  State survives executor loss in the checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from askweave.operators import feedback


def distinct_submissions(stream: DataFrame, time: str = "timestamp", delay: str = "1 day") -> DataFrame:
    """First occurrence of each fingerprint inside the watermark."""
    keyed = stream.withColumn("fingerprint", feedback.fingerprint(feedback.FINGERPRINT_COLUMNS))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def daily_trend(stream: DataFrame, time: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """Weighted outcome counts per day, with late rows accepted up to ``delay``."""
    windowed = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("day"))
    out = windowed.agg(
        F.sum(feedback._weight()).alias("total"), feedback._sum(feedback._is("CORRECT")).alias("correct"),
        feedback._sum(~feedback._is("CORRECT")).alias("incorrect"),
        feedback._sum(feedback._is(*feedback.fixed.NO_ANSWER_COMPLAINTS)).alias("no_answer"),
    )
    return out.withColumn("date", F.date_format("day.start", "yyyy-MM-dd")).drop("day")


def merge_into_store(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keep a de-duplicated store up to date: each micro-batch is one aggregate per fingerprint.

    Counts are stored per batch and added up when read, so a batch that is
    replayed after a failure replaces its own folder instead of counting twice.
    """
    def save(batch: DataFrame, number: int) -> None:
        feedback.deduplicate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)


def read_store(spark, path: str, time: str = "timestamp", row_id: str = "feedback_id") -> DataFrame:
    """The store as one row per fingerprint: first submission, summed counts, last time seen."""
    parts = spark.read.parquet(path).drop("batch")
    rest = [c for c in parts.columns if c not in ("fingerprint", "duplicate_count", "last_seen")]
    grouped = parts.groupBy("fingerprint").agg(
        F.min_by(F.struct(*rest), F.struct(time, row_id)).alias("_first"),
        F.sum("duplicate_count").alias("duplicate_count"), F.max("last_seen").alias("last_seen"),
    )
    return grouped.select("_first.*", "fingerprint", "duplicate_count", "last_seen")
