"""Shuffled shards by a two-pass external shuffle.

Pass 1 scatters the rows over buckets of bounded size with a seeded hash.  Pass 2
holds one bucket at a time, permutes it (``shuffle`` is a Fisher-Yates
permutation with its own seed for each bucket) and writes it.  Bucket after
bucket is then one random order of all rows; shard ``s`` of ``k`` is its ``s``-th
of ``k`` equal runs.  Rows cross the network once.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askweave.llm.common import materialize

SHARDS = 40
SEED = 20_240
#: Bytes of text a bucket holds on average: it is held in memory while it is permuted.
BUCKET_BYTES = 16 << 20
#: Bytes a row counts besides its text.
ROW_BYTES = 16


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def running_starts(counts: DataFrame, key: str, n: str) -> DataFrame:
    """``counts`` with ``_start``, the sum of ``n`` over smaller keys; two levels keep each window short."""
    counts = counts.withColumn("_block", F.floor(F.col(key) / 1024))
    inside = F.sum(n).over(Window.partitionBy("_block").orderBy(key)) - F.col(n)
    blocks = counts.groupBy("_block").agg(F.sum(n).alias("_sum"))
    blocks = blocks.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    return counts.withColumn("_inside", inside).join(blocks, "_block").withColumn("_start", F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``, in stored, shuffled form.

    Shard sizes differ by one row at most; slots of a shard run from 0 without
    gaps.  Rows are scattered by id and by their place in the input, so neither
    null ids nor an id repeated any number of times fill a bucket.  Rows are
    never inspected beyond id and size: null and empty texts, ties and repeated
    rows are dealt like any other.  Columns named ``shard`` or ``slot`` are
    replaced.  An empty table gives an empty result.  Runs over the same files
    agree.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    total = docs.agg(F.coalesce(F.sum(row_size(F.col(text_col))), F.lit(0))).first()[0]
    buckets = max(1, ceil(total / bucket_bytes))
    place = F.monotonically_increasing_id()
    dealt = docs.select(F.struct(*kept).alias("_row"), F.col(id_col).alias("_id"), place.alias("_place"))
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_id", "_place"), F.lit(buckets)).cast("int"))
    dealt = dealt.repartitionById(buckets, F.col("_bucket")).sortWithinPartitions("_bucket", "_id", "_place")
    held = dealt.groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    written = materialize(held.select("_bucket", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_pos", "_row")), "shards")
    counts = materialize(written.groupBy("_bucket").agg(F.count("*").alias("_n")), "shard-counts")
    rows = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    starts = running_starts(counts, "_bucket", "_n").drop("_n")
    at = written.join(starts, "_bucket").withColumn("_at", F.col("_start") + F.col("_pos"))
    shard = F.expr(f"CAST(_at * {shards}L DIV {max(rows, 1)}L AS INT)")
    first = F.expr(f"(_shard * {rows}L + {shards - 1}L) DIV {shards}L")
    at = at.withColumn("_shard", shard)
    return at.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_shard").alias("shard"), (F.col("_at") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within its files."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
