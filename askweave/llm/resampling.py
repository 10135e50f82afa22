"""Importance resampling towards a target text collection.

Weights are scored in arrays: a batch of texts is cut into words by Arrow, the
CRC of each distinct word is taken once, and the CRC of a pair of words is combined
from those of its words by table look-ups, so no feature becomes a Python string.

Ranks come from parallel sorting by regular sampling.  Each run of rows is sorted
where it lies and gives regularly spaced samples; the sorted samples give regular
splitters; each row is sent to its splitters' segment, which is ordered by itself;
the counts of the earlier segments turn a place in a segment into an exact rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askweave.llm.common import bounded_batches, materialize

#: What stands between words, once A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Words a document needs to be drawn, per cent of those documents that are drawn, and the seed of the draw.
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Samples of all runs together that reach the driver (at least one a run).
SAMPLES = 1 << 16
#: Longest word whose CRC is combined by tables; longer ones are rare and taken one by one.
TABLE_BYTES = 48


@lru_cache(maxsize=None)
def _tables() -> np.ndarray:
    """For each length up to ``TABLE_BYTES``, what each byte of a CRC becomes when so many bytes follow."""
    out = np.zeros((TABLE_BYTES + 1, 4, 256), np.uint32)
    value = np.arange(256, dtype=np.uint32)
    for length in range(TABLE_BYTES + 1):
        zeros = bytes(length)
        base = zlib.crc32(zeros)
        for bit in range(32):
            image = np.uint32(zlib.crc32(zeros, 1 << bit) ^ base)
            out[length, bit // 8] ^= np.where(value >> np.uint32(bit % 8) & np.uint32(1), image, np.uint32(0))
    return out


def followed(crc: np.ndarray, word_crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC of a string followed by a word of at most ``TABLE_BYTES`` bytes, from the CRCs of both."""
    table = _tables()
    out = word_crc.copy()
    for k in range(4):
        out ^= table[size, k, (crc >> np.uint32(8 * k) & np.uint32(255)).astype(np.intp)]
    return out


def batch_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the bucket of each feature of a batch: all words, then all pairs of neighbours."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATOR)
    words, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    coded, row = words.filter(real).dictionary_encode(), row.filter(real).to_numpy().astype(np.int64)
    code = coded.indices.to_numpy()
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    single = np.fromiter((zlib.crc32(w) for w in names), np.uint32, len(names))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in single.tolist()), np.uint32, len(names))
    size = np.fromiter(map(len, names), np.int64, len(names))
    first = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.array([], np.int64)
    a, b = code[first], code[first + 1]
    pair = followed(spaced[a], single[b], np.minimum(size[b], TABLE_BYTES))
    for i in np.flatnonzero(size[b] > TABLE_BYTES).tolist():
        pair[i] = zlib.crc32(names[b[i]], int(spaced[a[i]]))
    return np.concatenate([row, row[first]]), (np.concatenate([single[code], pair]) % np.uint32(BUCKETS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        n += np.bincount(batch_buckets(batch.column("text"))[1], minlength=BUCKETS)
    has = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has])], ["bucket", "n"])


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket: ``BUCKETS`` numbers, whatever the size of ``docs``."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the source."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket = batch_buckets(batch.column("_text"))
            n = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n), pa.array(total // np.maximum(n, 1))], ["row", "n_features", "weight"])

    return run


def _noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw that the id and the seed decide."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Stored rows ``(row, doc_id, n_features, weight, score)``; ``row`` holds the columns ``carry`` (the id where none are named)."""
    bounded_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    kept = F.struct(*[F.col(c) for c in carry or [id_col]]).alias("row")
    rows = docs.select(F.struct(F.col(id_col).alias("id"), kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = rows.mapInArrow(_weights(gain), f"row {rows.schema['row'].dataType.simpleString()}, n_features long, weight long")
    out = out.select("row.row", F.col("row.id").alias("doc_id"), "n_features", "weight")
    return materialize(out.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)).withColumn("_tie", F.monotonically_increasing_id()), "resample-scored")


_KEY = ("_down", "_no_id", "_id", "_tie")


def _keys(rows: pd.DataFrame) -> list[np.ndarray]:
    return [rows[c].to_numpy() for c in _KEY]


def _regular(samples: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        rows = pd.concat(held) if held else pd.DataFrame()
        if len(rows):
            yield rows.iloc[np.unique(np.linspace(0, len(rows), samples + 2)[1:-1].astype(np.int64).clip(0, len(rows) - 1))]

    return run


def _segments(splitters: list[np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(splitters[0])
        for rows in batches:
            both = [np.concatenate([s, k]) for s, k in zip(splitters, _keys(rows), strict=True)]
            order = np.lexsort(both[::-1])
            below = np.empty(len(order), np.int64)
            below[order] = np.cumsum(order < p)  # splitters at or before a row
            yield rows.assign(_segment=below[p:])

    return run


def ranked(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, score, _tie)`` with ``_rank`` from 1: highest score first, then smallest id, null ids last, then ``_tie``.

    ``_tie`` differs between rows, so that equal rows spread over segments.  The
    driver sees ``SAMPLES`` keys (or one a run) and one count a segment.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumns({"_down": -F.col("score"), "_no_id": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    runs = keyed.select(*_KEY)
    each = max(1, min(4 * parts, SAMPLES // max(1, runs.rdd.getNumPartitions())))
    sample = runs.sortWithinPartitions(*_KEY).mapInPandas(_regular(each), runs.schema).toPandas().sort_values(list(_KEY))
    at = np.unique(np.linspace(0, len(sample), parts + 1)[1:-1].astype(np.int64).clip(0, max(0, len(sample) - 1)))
    splitters = [sample[c].to_numpy()[at] if len(sample) else np.array([], np.int64) for c in _KEY]
    dealt = keyed.mapInPandas(_segments(splitters), keyed.withColumn("_segment", F.lit(0).cast("long")).schema)
    dealt = materialize(dealt, "resample-segments")
    before, start = 0, []
    for r in dealt.groupBy("_segment").count().orderBy("_segment").collect():
        start.append((r["_segment"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(start or [(0, 0)], "_segment long, _start long"))
    place = F.row_number().over(Window.partitionBy("_segment").orderBy(*_KEY))
    out = dealt.withColumn("_place", place.cast("long")).join(offsets, "_segment").withColumn("_rank", F.col("_start") + F.col("_place"))
    return out.drop("_down", "_no_id", "_id", "_segment", "_place", "_start")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(row, doc_id, n_features, weight, score, rank)`` for each row of ``docs``; ``rank`` is null where it is not drawn.

    Of the N rows with ``min_words`` words the ``percent * N // 100`` highest
    scores are drawn: a score is the row's mean gain towards ``target`` plus noise
    that its id decides, so the draw is a weighted sample and reruns agree.  Null
    and empty texts have no features, weight 0, and are never drawn; a null id
    draws its noise from an empty one and ranks behind equal scores; repeated rows
    are drawn each by itself; texts are read whole.  ``row`` holds the columns
    named in ``carry``, so names cannot clash.  An empty table gives an empty result.
    """
    rows = scored(docs, target, seed, id_col, text_col, carry)
    fit = rows.where(F.col("n_features") >= 2 * min_words - 1)
    drawn = ranked(fit)
    take = percent * fit.count() // 100
    drawn = drawn.withColumn("rank", F.when(F.col("_rank") <= take, F.col("_rank"))).drop("_rank", "_tie")
    rest = rows.where(F.col("n_features") < 2 * min_words - 1).drop("_tie").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)


def drawn_rows(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns."""
    return resample(docs, target, percent, carry=docs.columns, **options).where(F.col("rank").isNotNull()).select("row.*")
