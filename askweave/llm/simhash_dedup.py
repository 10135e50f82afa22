"""Near duplicates by SimHash and pivot distance tables.

Fingerprints within ``max_bits`` differing bits are linked.  Three steps find
the links without comparing all fingerprints with each other:

1. Rows meet where they can match at all: a fingerprint is cut into blocks, and
   two fingerprints with at most ``max_bits`` differing bits agree on all but
   ``max_bits`` blocks.  Each choice of agreeing blocks is a key of an equi-join.
   Distances to references alone cannot bring rows together: for 64 random bits
   they all lie near 32.
2. Where rows meet, a table holds their Hamming distances to many reference
   fingerprints.  By the triangle inequality a pair with a coordinate difference
   above ``max_bits`` is no match.  Rows are sorted by the first coordinate, so
   the scan of a row ends at the first one too far away; the other coordinates
   discard most of the rest.
3. Survivors are verified by counting the differing bits.

A meeting of rows returns a spanning forest of its links, never the links
themselves, so that a group of thousands of near copies stays linear in output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from askweave.llm.common import bounded_batches, hot_join, materialize
from askweave.llm.graph import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Reference fingerprints of the distance table: hashes of their numbers.
PIVOTS = tuple(xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(12))
#: Rows that one meeting holds at most; larger ones are split into a grid of such cells.
CELL_ROWS = 4096
#: One fingerprint in so many is counted to find meetings that need splitting.
PROBE = 16


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words; of the whole sequence where there are fewer."""
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - shingle + 1].tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        counts += np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as a signed integer; a text without words has 0."""
    words = (text or "").encode().lower().split()
    return _majority(_shingle_hashes(words, shingle)) if words else 0


@F.pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def block_count(rows: int, max_bits: int = MAX_BITS) -> int:
    """Blocks a fingerprint is cut into: so many that a few thousand rows at most share the value of a key on average."""
    blocks = max_bits + 2
    while blocks < 16 and 64 * (blocks - max_bits) // blocks < log2(max(rows, 2)) - 12:
        blocks += 1
    return blocks


def meeting_keys(fp: Column, blocks: int, max_bits: int = MAX_BITS) -> Column:
    """One key for each choice of blocks that must agree, the choice's number included."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1) for i in range(blocks)]
    return F.array(*[F.xxhash64(F.lit(k), *[part[i] for i in chosen]) if sum(cuts[i + 1] - cuts[i] for i in chosen) > 48 else _packed(k, chosen, part, cuts)
                     for k, chosen in enumerate(combinations(range(blocks), blocks - max_bits))])


def _packed(k: int, chosen: tuple[int, ...], part: list[Column], cuts: list[int]) -> Column:
    out = F.lit(k).cast("long")
    for i in chosen:
        out = F.shiftleft(out, cuts[i + 1] - cuts[i]).bitwiseOR(part[i])
    return out


def _join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links ``(a, b)`` those that join two trees of ``root``, which is brought up to date."""
    out_a, out_b = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = x, y
        while root[u] != u:
            u = root[u]
        while root[v] != v:
            v = root[v]
        if u != v:
            root[max(u, v)] = min(u, v)
            out_a.append(x)
            out_b.append(y)
    if len(a):
        while not np.array_equal(up := root[root], root):
            root[:] = up
    return out_a, out_b


def forest(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among rows of equal ``key``; rows come sorted by key and first coordinate."""
    n = len(key)
    table = [np.bitwise_count(fp ^ np.uint64(p)).astype(np.int16) for p in PIVOTS]
    root = np.arange(n)
    out_a, out_b = [], []
    left = np.arange(n - 1)
    shift = 1
    while len(left):
        left = left[left + shift < n]
        right = left + shift
        near = (key[left] == key[right]) & (table[0][right] - table[0][left] <= max_bits)
        left, right = left[near], right[near]
        apart = root[left] != root[right]
        a, b = left[apart], right[apart]
        for column in table[1:]:
            ok = np.abs(column[a] - column[b]) <= max_bits
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        more_a, more_b = _join_up(root, a[ok], b[ok])
        out_a += more_a
        out_b += more_b
        shift += 1
    return np.array(out_a, int), np.array(out_b, int)


def _fingerprint_links(max_bits: int):
    def link(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        node = rows["node"].to_numpy()
        a, b = forest(rows["cell"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), max_bits)
        yield pd.DataFrame({"a": node[a], "b": node[b]})

    return link


def _meetings(link: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        size = 0

        def linked(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            key = rows["cell"].to_numpy()
            same = key[1:] == key[:-1]
            rows = rows[np.append(same, False) | np.insert(same, 0, False)]
            if len(rows):
                yield from link(rows)

        for batch in batches:
            kept.append(batch)
            size += len(batch)
            if size >= 65536:  # what follows the last full meeting stays for the next batches
                rows = pd.concat(kept)
                start = int(np.searchsorted(rows["cell"].to_numpy(), rows["cell"].iloc[-1]))
                if start:
                    yield from linked(rows.iloc[:start])
                kept, size = [rows.iloc[start:]], 0
        if kept:
            yield from linked(pd.concat(kept))

    return run


def _cells(key: Column, chunks: Column, chunk: Column) -> Column:
    """The cells of the grid that a row of a large meeting belongs to; the key alone where ``chunk`` is null."""
    return F.when(chunk.isNull(), F.array(key)).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.xxhash64(F.lit(2), key, F.least(x, chunk), F.greatest(x, chunk))))


def _chunk() -> Column:
    return F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("chunks"))).cast("int")


def links(nodes: DataFrame, rows: int, max_bits: int = MAX_BITS, blocks: int | None = None, cell_rows: int = CELL_ROWS, probe: int = PROBE) -> DataFrame:
    """A spanning forest ``(a, b)`` of all linked pairs of ``nodes(node, fp)``."""
    blocks = blocks or block_count(rows, max_bits)
    met = nodes.select("node", "fp", F.explode(meeting_keys(F.col("fp"), blocks, max_bits)).alias("key"))
    probed = nodes.where(F.pmod(F.xxhash64("node"), F.lit(probe)) == 0).select(F.explode(meeting_keys(F.col("fp"), blocks, max_bits)).alias("key"))
    large = probed.groupBy("key").count().where(F.col("count") * probe > cell_rows)
    large = materialize(large.select("key", F.ceil(F.col("count") * 2 * probe / cell_rows).cast("int").alias("chunks")), "simhash-large")
    met = met.join(large, "key", "left").withColumn("chunk", _chunk())
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows * comb(blocks, max_bits) / 1_000_000))
    met = met.select("node", "fp", F.explode(_cells(F.col("key"), F.col("chunks"), F.col("chunk"))).alias("cell")).repartition(parts, "cell")
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(np.uint64(PIVOTS[0]).view(np.int64)))))
    return met.sortWithinPartitions("cell", first).mapInPandas(_meetings(_fingerprint_links(max_bits)), "a long, b long")


def _groups(prints: DataFrame) -> DataFrame:
    """``prints(doc_id, doc_key, node, ...)`` with one row of each node: its first row's place, and its ``n`` rows."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_key")
    carried = [F.first(c).alias(c) for c in ("fp", "marks", "size", "keys") if c in prints.columns]
    return materialize(prints.groupBy("node").agg(F.min(place).alias("least"), F.count("*").alias("n"), *carried), "simhash-groups")


def _named(groups: DataFrame, linked: DataFrame) -> DataFrame:
    """``(node, least, n)``: the first row of each node's component."""
    star = components(linked, "simhash").withColumnRenamed("node", "member")
    rooted = groups.select("node", "least", "n").join(star, F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node")).drop("member")
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return rooted.join(first, "root").select("node", F.col("first").alias("least"), "n")


def _key(id_col: str, text_col: str):
    return F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    ``fingerprint`` has 16 hexadecimal digits, ``component_id`` is the smallest
    id reachable over links.  Null and blank texts have fingerprint zero and link
    like others.  Rows without an id keep a row; they count for links but give no
    component its name (null where no row of a component has an id).  Repeated
    rows give repeated results.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    prints = docs.select(F.col(id_col).alias("doc_id"), _key(id_col, text_col).alias("doc_key"), simhash(F.col(text_col)).alias("fp"))
    prints = materialize(prints.withColumn("node", F.col("fp")), "simhash-prints")
    groups = _groups(prints)
    size = groups.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    named = _named(groups, links(groups.select("node", "fp"), size["rows"], max_bits))
    out = hot_join(prints, named, "node", "n", size["total"], F.struct("doc_id", "doc_key"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))
