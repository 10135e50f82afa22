"""Vectors kept by content: only texts that no earlier batch has encoded reach the encoder.

A store is a folder of Parquet parts, ``generation=<g>/batch=<b>``, with one row per
distinct text and model.  A changed text has another key, a changed model has other
keys throughout, so a stale vector is never served; the number of rows decides nothing.
A part counts once Spark has marked it as complete.  A batch that died is written
again, and a batch that is replayed finds its keys stored and encodes nothing.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askweave.session import broadcast_if_fits

_SCHEMA = "key string, vector array<float>"


def content_key(text: Column, model: str) -> Column:
    """Key of a text under a model; null counts as the empty text."""
    return F.sha2(F.concat(F.lit(model + "\x1f"), F.coalesce(text, F.lit(""))), 256)


def _numbers(spark: SparkSession, folder: str, kind: str, complete: bool) -> list[int]:
    """Numbers ``n`` of the subfolders ``<kind>=<n>``, rising; only names are listed, never rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    out = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith(f"{kind}=") and (not complete or files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))):
            out.append(int(name.split("=")[1]))
    return sorted(out)


def _generation(spark: SparkSession, path: str) -> int:
    """The newest generation whose first part is complete; 0 for a new store."""
    known = _numbers(spark, path, "generation", complete=False)
    return max([g for g in known if 0 in _numbers(spark, f"{path}/generation={g}", "batch", complete=True)], default=0)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``key, vector`` of all complete parts; empty for a new store."""
    folder = f"{path}/generation={_generation(spark, path)}"
    parts = [f"{folder}/batch={b}" for b in _numbers(spark, folder, "batch", complete=True)]
    return spark.read.schema(_SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], _SCHEMA)


def sync(df: DataFrame, text: str, encoder: Callable[[Column], Column], path: str, model: str) -> int:
    """Encode the texts of ``df`` that the store lacks, append them as one part, and return how many they were.

    ``encoder`` maps a text column to an array column (a pandas UDF or built-in
    functions).  Copies are encoded once; the keys are grouped before they meet the
    store, so a text that a third of the rows share is one row there.
    """
    spark = df.sparkSession
    folder = f"{path}/generation={_generation(spark, path)}"
    known = _numbers(spark, folder, "batch", complete=True)
    asked = df.select(content_key(F.col(text), model).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    asked = asked.groupBy("key").agg(F.first("_text").alias("_text"))
    if known:
        asked = asked.join(read_store(spark, path).select("key"), "key", "left_anti")
    part = f"{folder}/batch={known[-1] + 1 if known else 0}"
    asked.select("key", encoder(F.col("_text")).cast("array<float>").alias("vector")).write.mode("overwrite").parquet(part)
    return spark.read.schema(_SCHEMA).parquet(part).count()


def with_vectors(df: DataFrame, text: str, path: str, model: str, name: str = "vector") -> DataFrame:
    """``df`` with the stored vector of each row's text; null where the store has none."""
    stored = read_store(df.sparkSession, path).withColumnsRenamed({"key": "_vector_key", "vector": name})
    return df.withColumn("_vector_key", content_key(F.col(text), model)).join(broadcast_if_fits(stored), "_vector_key", "left").drop("_vector_key")


def compact(live: DataFrame, text: str, path: str, model: str) -> int:
    """Rewrite the store as a new generation of one part that holds the texts of ``live`` only; returns its rows.

    Readers see the old generation until the new part is complete.
    """
    spark = live.sparkSession
    keys = live.select(content_key(F.col(text), model).alias("key")).distinct()
    part = f"{path}/generation={_generation(spark, path) + 1}/batch=0"
    read_store(spark, path).join(keys, "key", "left_semi").write.mode("overwrite").parquet(part)
    return spark.read.schema(_SCHEMA).parquet(part).count()
