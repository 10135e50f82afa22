"""Benchmark decontamination by a size-partitioned MinHash containment search.

A benchmark item counts as leaked into a document if at least ``containment`` of
its distinct five-word shingles occur there, wherever they stand.

Jaccard similarity between a short item and a long document is near zero, so
bands over signatures of whole documents cannot find it.  The search is one-sided
instead.  Items are partitioned by size; an item's sketch is its ``k`` smallest
shingle hashes, with ``k`` set by its size class.  A document that holds enough of
the item can miss only ``n - ceil(containment * n)`` shingles, so it holds at
least the rest of the sketch: the sketch has no false negatives.  Pairs that pass
are verified by the texts of their shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askweave.llm.common import materialize

SHINGLE = 5
CONTAINMENT = 0.8
#: Sketch rows (two longs each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+", " ")
    return F.filter(F.split(F.trim(spaced), " "), lambda w: w != "")


def _places(words: Column) -> Column:
    return F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column) -> Column:
    return F.transform(_places(words), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))


def _texts(words: Column) -> Column:
    return F.array_distinct(F.transform(_places(words), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(SHINGLE)])))


def _least(n: Column, containment: float) -> Column:
    return F.ceil(n * containment - 1e-9)


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``(item, h, enough)``: the sketch of each item and how many of its hashes a document must hold."""
    hashes = items.select("item", F.explode(F.array_distinct(_hashes(F.col("words")))).alias("h"))
    ranked = hashes.select("item", "h", F.row_number().over(Window.partitionBy("item").orderBy(F.xxhash64(F.lit(11), "h"))).alias("at"), F.count("*").over(Window.partitionBy("item")).alias("n"))
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the size class
    k = F.least(F.col("n"), 2 * (largest - _least(largest, containment)) + 8)
    return ranked.withColumn("k", k).where("at <= k").select("item", "h", (F.col("k") - (F.col("n") - _least(F.col("n"), containment))).cast("long").alias("enough"), _least(F.col("n"), containment).cast("long").alias("least"))


def leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, doc_key, item_id, n_shingles, n_found, containment)`` of every leaked item of every document.

    ``doc_key`` hashes id and text.  Null and empty texts, and items or documents
    of fewer than five words, have no shingle and match nothing.  Rows repeated in
    id and text share one result, ids may be null, and an item repeated in id and
    text counts once.  Long texts are searched whole.  An empty table on either
    side gives an empty result.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.xxhash64(F.lit(5), F.col(item_col), F.col(item_text_col)).alias("item"), plain_words(F.col(item_text_col)).alias("words")).dropDuplicates(["item"])
    items = materialize(items, "leak-items")
    sketch = materialize(sketches(items, containment), "leak-sketch")
    facts = sketch.agg(F.count("*").alias("n"), F.coalesce(F.min("least"), F.lit(1)).alias("least")).first()
    if facts["n"] <= broadcast_rows:
        sketch = F.broadcast(sketch)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(5), F.col(id_col), F.col(text_col)).alias("doc_key"), plain_words(F.col(text_col)).alias("words"))
    large = keyed.where(F.size("words") >= facts["least"] + SHINGLE - 1)
    hits = large.select("doc_key", F.explode_outer(_hashes(F.col("words"))).alias("h")).join(sketch, "h")
    found = hits.groupBy("doc_key", "item", "h", "enough").agg(F.lit(1).alias("one")).groupBy("doc_key", "item").agg(F.count("*").alias("n"), F.first("enough").alias("enough"))
    pairs = materialize(found.where("n >= enough").select("doc_key", "item"), "leak-pairs")
    wanted = pairs.join(items.select("item", "item_id", _texts(F.col("words")).alias("item_texts")), "item").select("doc_key", "item_id", "item_texts")
    met = keyed.join(pairs.select("doc_key").distinct(), "doc_key", "left_semi").dropDuplicates(["doc_key"]).select("doc_id", "doc_key", _texts(F.col("words")).alias("doc_texts")).join(wanted, "doc_key")
    n = F.size("item_texts").cast("long")
    both = met.select("doc_id", "doc_key", "item_id", n.alias("n_shingles"), F.size(F.array_intersect("doc_texts", "item_texts")).cast("long").alias("n_found"))
    return both.where(F.col("n_found") >= _least(F.col("n_shingles"), containment)).withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def without_leaks(docs: DataFrame, leaked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``leaked`` names by ``doc_key``."""
    keys = materialize(leaked.select("doc_key").distinct(), "leak-keys").withColumnRenamed("doc_key", "_leaked")
    return docs.join(keys, F.xxhash64(F.lit(5), F.col(id_col), F.col(text_col)) == F.col("_leaked"), "left_anti")
