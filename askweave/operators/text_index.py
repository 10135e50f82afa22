"""Corpus statistics and postings.

Documents are exchanged once, by document id, while they are still one narrow
row each.  Everything per document (token counts, per-query sums, local top-k)
then happens in that stage; Spark sees that grouping by (document, ...) is
already satisfied and adds no further exchange for postings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askweave.functions import text as T
from askweave.session import BROADCAST_ROWS, fits, materialize

Tokenizer = Callable[[Column], Column]
#: Bytes of text that one task takes apart; its tokens are held in a hash table while they are counted.
TASK_BYTES = 8 << 20


def parts_for(docs: DataFrame, *text_cols: str) -> int:
    """Tasks that hold ``TASK_BYTES`` of the texts on average, at least one a core."""
    size = docs.agg(*[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"n{i}") for i, c in enumerate(text_cols)]).first()
    return max(docs.sparkSession.sparkContext.defaultParallelism, ceil(sum(size) / TASK_BYTES))


def tokenized(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    title_col: str | None = None,
    tokenizer: Tokenizer = T.tokenize,
    co_locate: bool = True,
    parts: int | None = None,
) -> DataFrame:
    """``doc_id, tokens, len`` (and ``title_tokens``), partitioned by document.

    The number of partitions grows with the texts; pass ``parts`` where counting
    their bytes would compute them twice.  Pass ``co_locate=False`` when the table
    is bucketed by its id already.
    """
    cols = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    if title_col:
        cols.append(F.coalesce(F.col(title_col), F.lit("")).alias("title"))
    narrow = docs.select(*cols)
    if co_locate:
        narrow = narrow.repartition(parts or parts_for(narrow, "text"), "doc_id")
    out = [F.col("doc_id"), tokenizer(F.col("text")).alias("tokens")]
    if title_col:
        out.append(F.array_distinct(tokenizer(F.col("title"))).alias("title_tokens"))
    return narrow.select(*out).withColumn("len", F.size("tokens"))


def exploded(tok: DataFrame) -> DataFrame:
    """One row per token occurrence.

    The outer generator keeps the optimizer from inferring a filter that would
    tokenize every document twice.
    """
    return tok.select("doc_id", "len", F.posexplode_outer("tokens").alias("pos", "term")).where(
        F.col("term").isNotNull()
    )


def postings(tok: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``doc_id, len, term, tf, first_pos``; grouped where the tokens are.

    With ``wanted(term)``, which must fit a broadcast, other terms are dropped before they are counted.
    """
    rows = exploded(tok)
    if wanted is not None:
        rows = rows.join(F.broadcast(wanted), "term", "left_semi")
    return rows.groupBy("doc_id", "len", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos")
    )


def document_frequency(tok: DataFrame) -> DataFrame:
    """``term, df`` for the whole vocabulary."""
    return _term_rows(tok).where(F.col("term") != ALL).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


ALL = ""  # no token is empty, so the empty term can stand for "every document"


def _term_rows(tok: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Every (document, term) once, plus one ``ALL`` row per document that carries its length.

    Unwanted terms are dropped right behind the generator, before duplicates are
    removed in the hash aggregate of the same stage.
    """
    rows = tok.select("doc_id", "len", F.explode_outer(F.concat("tokens", F.array(F.lit(ALL)))).alias("term"))
    if wanted is not None:
        rows = rows.join(maybe_broadcast(wanted), "term", "left_semi")
    return rows.select("doc_id", "len", "term").distinct()


@dataclass(frozen=True)
class Statistics:
    """``frequency`` (``term, df``), number of documents, mean length."""

    frequency: DataFrame
    n_docs: int
    avg_len: float


def statistics(tok: DataFrame, vocabulary: DataFrame | None = None) -> Statistics:
    """All corpus statistics in one pass.

    With a ``vocabulary`` only its terms are counted, so each task exchanges at
    most that many rows.  The result is written once; the two totals are the
    only values that reach the driver.
    """
    wanted = None
    if vocabulary is not None:
        wanted = vocabulary.select("term").distinct().unionByName(vocabulary.sparkSession.sql(f"SELECT '{ALL}' AS term"))
    rows = _term_rows(tok, wanted)
    counted = materialize(
        rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("total_len")), "terms"
    )
    total = counted.where(F.col("term") == ALL).first()
    n, length = (total["df"], total["total_len"]) if total else (0, 0)
    return Statistics(counted.where(F.col("term") != ALL).select("term", "df"), n, length / n if n else 0.0)


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if fits(df, max_rows) else df


def query_terms(
    queries: DataFrame, id_col: str, text_col: str, tokenizer: Tokenizer = T.tokenize
) -> DataFrame:
    """``query_id, term, qtf``; a repeated query term keeps its count."""
    tokens = queries.select(
        F.col(id_col).alias("query_id"), F.explode_outer(tokenizer(F.col(text_col))).alias("term")
    ).where(F.col("term").isNotNull())
    return tokens.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def save_index(tok: DataFrame, folder: str) -> None:
    """Persist statistics and postings as Parquet; later runs read instead of tokenizing."""
    postings(tok).write.mode("overwrite").parquet(f"{folder}/postings")
    rows = _term_rows(tok).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("total_len"))
    rows.write.mode("overwrite").parquet(f"{folder}/terms")


def load_index(spark, folder: str) -> tuple[DataFrame, Statistics]:
    """Stored postings and statistics; the postings can replace a tokenized corpus in scoring."""
    terms = spark.read.parquet(f"{folder}/terms")
    total = terms.where(F.col("term") == ALL).first()
    n, length = (total["df"], total["total_len"]) if total else (0, 0)
    stats = Statistics(terms.where(F.col("term") != ALL).select("term", "df"), n, length / n if n else 0.0)
    return spark.read.parquet(f"{folder}/postings"), stats
