"""The corpus pipeline: five stages, each written as Parquet and read again.

``run(spark, sf_dir)`` applies the stages to ``documents``: toxic documents go, one
document of each group of near copies stays, documents that hold benchmark items
go, sources are mixed to their targets, and the rows of the mix are shuffled into
shards.  All stages but the last return the columns of ``documents``.

A stage's text decides by itself: null and empty texts are clean, copies of each
other, leak nothing, add no words to a mix and are taken by no source without words.
Repeated rows (equal id and text) are one document up to the mix, which may take a
document twice.  Columns that a stage does not use are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askweave.llm import decontamination, mixing, near_copies, sharding, toxicity
from askweave.llm.common import materialize, read_table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold of the toxicity model."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    return toxicity.scored(rows, model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.one_of_each(docs).select(*docs.columns)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    leaked = decontamination.leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return decontamination.without_leaks(docs, leaked).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixing.take(mixing.mix(docs)).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    return sharding.shuffled_shards(docs)


STAGES = [("toxicity", not_toxic), ("near_duplicates", no_near_copies), ("decontamination", no_leaks), ("mixing", mixed), ("sharding", sharded)]
#: A trained model and XXH64 fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def pipeline_queries() -> dict:
    return {"pipeline": run}


def pipeline_sql() -> dict:
    return {}
