"""Helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askweave.session import materialize

__all__ = ["SPACE", "bounded_batches", "hot_join", "materialize", "numbered", "read_table", "total_columns", "trimmed", "word_count", "words"]

#: The white space of ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"
#: Rows an Arrow batch holds at most, so that a batch of long texts stays small.
BATCH_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches for the Python operators of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.when(trimmed(text) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed(text), "[\\x20\\x09-\\x0D]+"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def hot_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, salt: Column, how: str = "left", parts: int = 32) -> DataFrame:
    """Join ``rows`` with ``table`` (one row a key, ``n`` rows of ``rows`` each) so that no key meets in one task.

    Keys of more than a thousandth of all rows are at most a thousand, which
    bounds the broadcast that marks them.  Their rows are dealt to ``parts``
    salts and their row of ``table`` is repeated for each.  ``n`` is dropped.
    """
    hot = table.where(F.col(n) > max(1000, total // 1000)).select(F.col(key).alias("_hot"))
    rows = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
    rows = rows.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(salt), F.lit(parts))).otherwise(0).cast("int")).drop("_hot")
    salts = F.when(F.col(n) > max(1000, total // 1000), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(table.withColumn("_salt", F.explode(salts)).drop(n), [key, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, order: list[Column], label: str, total: Callable[[], Column] | None = None) -> DataFrame:
    """``df`` in a stored, globally ordered form with ``_rank`` from 0, without a task that holds all rows.

    A range exchange orders the partitions, a window counts inside each, and the
    sizes of the earlier partitions (one number a partition) are added.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), label)
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    start = spark.createDataFrame(offsets or [(0, 0)], "_part int, _start long")
    return dealt.join(F.broadcast(start), "_part").withColumn("_rank", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def total_columns(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
