"""Queries of the mixing and sharding operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askweave.llm.common import read_table
from askweave.llm.mixing import mix
from askweave.llm.sharding import row_size, shuffled_shards


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shuffled_shards(read_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return sharded.select("doc_id", row_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_mix_sources": op2_mix_sources, "op8_shuffle_shards": op8_shuffle_shards}
