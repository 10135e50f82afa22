"""Queries of the secret scan, the toxicity model and the token counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askweave.llm import secrets, token_counts, toxicity
from askweave.llm.common import read_table

PIECES = "piece_bpe_32k.model"


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.scored(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, token_counts.vocabulary(public_tokenizers.path(PIECES))).select("doc_id", "n_tokens")


QUERIES = {"op5_secret_scan": op5_secret_scan, "op7_toxicity": op7_toxicity, "op9_token_counts": op9_token_counts}
