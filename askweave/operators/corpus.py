"""Corpus and question-set building: cleaning, distinct documents, re-anchoring, leakage, profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askweave.functions import text as T


def distinct_corpus(rows: DataFrame, key: list[str], ordinal: str, text: str) -> DataFrame:
    """First occurrence of every distinct ``key`` with a gap-free document number.

    Duplicates collapse in a partial aggregate before the exchange, so a text
    that makes up a third of the rows costs one row per task.  Numbers come
    from a range sort with per-partition counts, not from one global window.
    """
    first = rows.groupBy(*key).agg(F.min(ordinal).alias(ordinal)).where(F.trim(F.col(text)) != "")
    return number_rows(first, ordinal, "doc_number").withColumn("id", F.format_string("doc_%05d", "doc_number"))


def number_rows(df: DataFrame, order: str, name: str, buckets: int = 256) -> DataFrame:
    """1..n by a unique numeric column without a single-partition window.

    Approximate quantiles cut the order column into buckets; a row's bucket is a
    function of its value alone, so a recomputed task gives the same answer.
    Each bucket is numbered on its own and shifted by the sizes before it.
    """
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(order, cuts, 10000)).first()[0] or []
    limits = F.lit(sorted(set(bounds))) if bounds else F.array().cast("array<bigint>")
    numbered = df.withColumn("_bucket", F.size(F.filter(limits, lambda b: b < F.col(order))))
    within = Window.partitionBy("_bucket").orderBy(order)
    sizes = numbered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    # At most ``buckets`` rows: a running sum over them is no bottleneck.
    before = sizes.select(
        "_bucket", (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_before")
    )
    return (
        numbered.withColumn("_n", F.row_number().over(within))
        .join(F.broadcast(before), "_bucket")
        .select(*df.columns, (F.col("_before") + F.col("_n")).alias(name))
    )


def clean_text_columns(df: DataFrame, columns: list[str], legacy_accents: bool = False) -> DataFrame:
    return df.withColumns({c: T.clean_html(F.col(c), legacy_accents) for c in columns})


def reanchor(context: Column, answer: Column, start: Column) -> Column:
    """Keep a 0-based start whose slice is the answer, else the first occurrence, else the old value."""
    fits = (start >= 0) & (F.substring(context, start + 1, F.length(answer)) == answer)
    found = F.instr(context, answer) - 1
    return F.when(answer == "", start).when(fits, start).when(found >= 0, found).otherwise(start)


def is_answerable(df: DataFrame, answer: str = "answer_text", start: str = "answer_start") -> Column:
    text = F.trim(F.coalesce(F.col(answer), F.lit(""))) != ""
    if start in df.columns:
        return text & (F.coalesce(F.col(start), F.lit(-1)) >= 0)
    return text


def possible_questions(df: DataFrame) -> DataFrame:
    """Drop impossible rows (null counts as possible) and rows without any answer candidates."""
    if "is_impossible" in df.columns:
        df = df.where(~F.coalesce(F.col("is_impossible"), F.lit(False)))
    if {"answers", "plausible_answers"} <= set(df.columns):
        def size(c: str) -> Column:
            return F.coalesce(F.size(F.col(f"{c}.text")), F.lit(0))

        df = df.where((size("answers") > 0) | (size("plausible_answers") > 0))
    return df


def split_leakage(df: DataFrame, split: str, content: str) -> DataFrame:
    """Number of distinct contents shared by each pair of splits.

    One grouping by content digest yields the set of splits per content; pairs
    are formed from that small set, never by joining splits with each other.
    """
    per_content = df.where(F.col(content).isNotNull()).groupBy(F.sha2(F.col(content), 256).alias("h")).agg(
        F.array_sort(F.collect_set(split)).alias("splits")
    )
    pairs = F.flatten(
        F.transform("splits", lambda a: F.transform(
            F.filter("splits", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right"))
        ))
    )
    shared = per_content.where(F.size("splits") > 1).select(F.explode(pairs).alias("p"))
    return shared.groupBy(F.col("p.left").alias("left_split"), F.col("p.right").alias("right_split")).agg(
        F.count(F.lit(1)).alias("shared_contents")
    )


def describe_numbers(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles (linear interpolation)."""
    value = F.col(column)
    return df.groupBy(*(by or [])).agg(
        F.count(value).alias("count"),
        F.round(F.mean(value), 6).alias("mean"),
        F.round(F.stddev_samp(value), 6).alias("std"),
        F.min(value).alias("min"),
        F.round(F.percentile(value, F.lit(0.25)), 6).alias("p25"),
        F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile(value, F.lit(0.75)), 6).alias("p75"),
        F.max(value).alias("max"),
    )


def shares(df: DataFrame, column: str) -> DataFrame:
    """Row count and percentage per value; the total is a sum over the few groups."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count")).scalar()
    return counted.withColumn("percent", F.round(F.col("count") * 100.0 / total, 6))
