"""Readers: Parquet, JSON, JSON lines, CSV, JDBC and dispatch by suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_KEYS = ("data", "examples", "items", "rows", "cases")
TITLE_COLUMNS = ("document_title", "title")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require_columns(df: DataFrame, required: Sequence[str], what: str = "dataset") -> DataFrame:
    """Fail early, by schema only, when columns are missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
    return df


def read_records(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows from Parquet, JSON lines, CSV, or a JSON document holding a list of rows.

    A JSON document may be the list itself or an object with the list under one
    of ``ROW_KEYS``.
    """
    lower = path.lower().rstrip("/")
    if lower.endswith((".jsonl", ".ndjson")):
        df = spark.read.json(path)
    elif lower.endswith(".json"):
        df = spark.read.option("multiLine", True).json(path)
        holders = [
            key for key in ROW_KEYS
            if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType)
        ]
        if holders:
            df = df.select(F.explode(holders[0]).alias("row")).select("row.*")
    elif lower.endswith(".csv"):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        df = spark.read.parquet(path)
    if columns is not None:
        df = require_columns(df, columns, path).select(*columns)
    return df


def discover_document_columns(df: DataFrame) -> DataFrame:
    """``id, text, document_title, heading`` from whichever of them the table has."""
    by_lower = {c.lower(): c for c in df.columns}
    title = next((by_lower[c] for c in TITLE_COLUMNS if c in by_lower), None)
    heading = by_lower.get("heading")
    return df.select(
        F.col(by_lower["id"]).cast("string").alias("id"),
        F.trim(F.coalesce(F.col(by_lower["text"]).cast("string"), F.lit(""))).alias("text"),
        (F.col(title) if title else F.lit(None)).cast("string").alias("document_title"),
        (F.col(heading) if heading else F.lit(None)).cast("string").alias("heading"),
    ).where(F.col("text") != "")


def read_document_store(spark: SparkSession, url: str, table_name: str = "documents", **options: str) -> DataFrame:
    """Documents of a relational store over JDBC, with optional columns discovered from its schema."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table_name)
    for key, value in options.items():
        reader = reader.option(key, value)
    return discover_document_columns(reader.load())


def first_answer(df: DataFrame) -> DataFrame:
    """Flat ``answer_text`` / ``answer_start`` from nested answers (struct of lists or list of structs)."""
    kind = df.schema["answers"].dataType
    if isinstance(kind, T.ArrayType):
        first = F.try_element_at(F.col("answers"), F.lit(1))
        text, start = first["text"], first["answer_start"]
    else:
        text = F.try_element_at(F.col("answers.text"), F.lit(1))
        start = F.try_element_at(F.col("answers.answer_start"), F.lit(1))
    return df.withColumn("answer_text", F.coalesce(text, F.lit(""))).withColumn(
        "answer_start", F.coalesce(start, F.lit(-1)).cast("int")
    )


def content_digest(df: DataFrame) -> DataFrame:
    """Order-independent digest of a table: row count and xor of row hashes.

    Computed by the executors in one pass; used where a lock file pins a data set.
    """
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in sorted(df.columns)]
    # 13 hex digits fit a signed 64-bit integer with room to spare.
    row_hash = F.conv(F.substring(F.sha2(F.concat_ws("␟", *fields), 256), 1, 13), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(row_hash).alias("digest"))


def verify_lock(df: DataFrame, status: str, rows: int, digest: int, expected_status: str = "LOCKED") -> DataFrame:
    """Return ``df`` when it matches its lock entry, else raise."""
    if status != expected_status:
        raise ValueError(f"data set is not {expected_status}")
    found = content_digest(df).first()
    if found["rows"] != rows:
        raise ValueError("row count differs from the lock entry")
    if found["digest"] != digest:
        raise ValueError("content digest differs from the lock entry")
    return df


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no finished result yet (resume after an interruption)."""
    return df.join(done.select(key).distinct(), key, "left_anti")
