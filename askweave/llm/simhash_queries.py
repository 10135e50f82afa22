"""Query of the SimHash near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askweave.llm.common import read_table
from askweave.llm.simhash_dedup import near_duplicates


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash_dedup": op1_simhash_dedup}
