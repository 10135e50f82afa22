"""Writers.  All of them are distributed; none collects rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table pre-partitioned and sorted by ``key`` so later joins and aggregates need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_csv(df: DataFrame, path: str, bom: bool = True, mode: str = "overwrite") -> None:
    """CSV with header; ``bom`` marks every part file as UTF-8 for spreadsheet programs."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    flat = df.select([
        F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`")
        for c, kind in df.dtypes
    ])
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
