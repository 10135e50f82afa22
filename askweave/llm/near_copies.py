"""Near copies of documents: a Jaccard similarity of five-word shingles of 0.8 or more, by exact count.

Links of SimHash fingerprints come first, found by the operator of near duplicates
(blocks bring rows together, distances to references discard, bits verify); each is
checked by the shingles of both texts.  At a similarity of 0.8 two fingerprints
differ in about ten of 64 bits, so SimHash misses such pairs.  Minima of shingle
hashes (MinHash) propose what it missed, in three steps that keep every table linear
in its input:

1. *Likely links.* Texts that share a band of minima meet.  A meeting returns a
   spanning forest of the pairs whose minima agree as those of near copies do, and
   each link of the forests is verified by the shingles of both texts.
2. *Rows still apart.* Where a band holds rows of several groups, a meeting tells
   which rows have a possible partner in another group: a mark a row, never a pair.
3. *Links where rows meet.* Shingles are sent to the meetings of those rows.  All
   possible pairs of different groups are counted there, groups are united as soon
   as a pair passes, and only the uniting links leave.

A meeting holds a bounded number of rows and bytes of shingles.  In a larger one
the rows of its largest group are compared with the others only, block by block, so
that a group of any size which step 1 has united costs nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from askweave.llm.common import bounded_batches, hot_join, materialize
from askweave.llm.graph import components
from askweave.llm.simhash_dedup import SEED, _groups, _join_up, _key, _named, _shingle_hashes, links, simhash
from askweave.session import broadcast_if_fits

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of minima that bring near copies together; a pair of similarity s shares none
#: with a chance of (1 - s**BAND)**BANDS, which is 0.00003 at 0.8.
BAND = 4
BANDS = 20
#: Of the BAND * BANDS minima so many agree where a pair is tried first, and where it is
#: tried at all (at a similarity of 0.8 fewer agree with a chance of about 0.0000001).
LIKELY = 66
POSSIBLE = 44
#: Rows and shingles that one side of a meeting holds.
CELL_ROWS = 2048
CELL_SHINGLES = 1 << 22
#: Shingles of the meetings that a worker reads before it works on them.
_READ_BYTES = 32 << 20
_FACTORS = np.array([xxhash.xxh64_intdigest(str(i).encode(), 11) | 1 for i in range(BAND * BANDS)], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct five-word shingles; of the whole text where it has fewer words."""
    words = (text or "").encode().lower().split()
    return np.unique(_shingle_hashes(words, SHINGLE)) if words else np.array([], "<u8")


def sketch(text: str | None) -> tuple[int, bytes, int, list[int]]:
    """A name of a text's shingle set, a byte of each of its minima, its size, and a key of each band of minima."""
    shingles = shingle_set(text)
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _FACTORS).min(0))
    keys = np.array([xxhash.xxh64_intdigest(least[i * BAND : (i + 1) * BAND].tobytes(), i) for i in range(BANDS)] + [xxhash.xxh64_intdigest(shingles.tobytes(), SEED)], np.uint64).view(np.int64).tolist()
    return keys[-1], (least >> np.uint64(32)).astype(np.uint8).tobytes(), len(shingles), keys[:-1]


@F.pandas_udf(StructType([StructField("node", LongType()), StructField("marks", BinaryType()), StructField("size", IntegerType()), StructField("keys", ArrayType(LongType()))]))
def sketches(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sketch(x) for x in texts], columns=["node", "marks", "size", "keys"])


@F.pandas_udf(BinaryType())
def shingle_bytes(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(x).tobytes() for x in texts], dtype=object)


@F.pandas_udf(DoubleType())
def jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
    """The similarity of two shingle sets."""
    def of(a: bytes, b: bytes) -> float:
        x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / max(1, len(x) + len(y) - both)

    return pd.Series([of(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def agreeing(key: np.ndarray, marks: np.ndarray, root: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal ``key`` and different ``root`` that agree in ``least`` marks; rows come sorted by key.

    ``root`` may change while the pairs are read.
    """
    left = np.arange(len(key) - 1)
    shift = 1
    while len(left):
        left = left[left + shift < len(key)]
        left = left[key[left] == key[left + shift]]
        a = left[root[left] != root[left + shift]]
        ok = (marks[a] == marks[a + shift]).sum(1) >= least
        if ok.any():
            yield a[ok], a[ok] + shift
        shift += 1


def united(root: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], similarity: float, least: int = POSSIBLE) -> tuple[list[int], list[int]]:
    """Links of a meeting's rows that unite all groups (``root``) with a pair of at least ``similarity``.

    A row is counted against all others at once: its shingles' lists of rows are
    laid end to end.  Rows whose possible partners are in their group by then are
    passed over, so a group that unites early costs one count a row at most.
    """
    names, group = np.unique(root, return_inverse=True)
    tree = np.arange(len(names))
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    all_shingles = np.concatenate(sets) if len(sets) else np.array([], "<u8")
    order = np.argsort(all_shingles, kind="stable")
    shingles, first = np.unique(all_shingles[order], return_index=True)
    rows, last = owner[order], np.append(first[1:], len(order))
    out_a, out_b = [], []
    for i, own in enumerate(sets):
        others = np.flatnonzero(tree[group] != tree[group[i]])
        others = others[(marks[others] == marks[i]).sum(1) >= least]
        if not len(others):
            continue
        at = np.searchsorted(shingles, own)
        if len(own):
            width = last[at] - first[at]
            steps = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            both = np.bincount(rows[np.repeat(first[at], width) + steps], minlength=len(sets))[others]
        else:
            both = np.zeros(len(others), np.int64)
        passed = others[both >= (similarity - 1e-9) * np.maximum(1, sizes[i] + sizes[others] - both)]
        for j in passed.tolist():
            a, b = tree[group[i]], tree[group[j]]
            if a != b:
                tree[tree == max(a, b)] = min(a, b)
                out_a.append(i)
                out_b.append(j)
    return out_a, out_b


def _whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined so that no cell is torn, of a bounded size beyond their last cell; rows come sorted by cell."""
    kept: list[pd.DataFrame] = []
    rows = held = 0
    for batch in batches:
        kept.append(batch)
        rows += len(batch)
        held += int(batch["shingles"].map(len).sum()) if "shingles" in batch else 0
        if rows >= 65536 or held >= _READ_BYTES:
            all_rows = pd.concat(kept)
            start = int(np.searchsorted(all_rows["cell"].to_numpy(), all_rows["cell"].iloc[-1]))
            if start:
                yield all_rows.iloc[:start]
            kept, rows, held = [all_rows.iloc[start:]], 0, 0
    if kept:
        yield pd.concat(kept)


def _marks(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(len(rows), -1)


def _alone_left_out(rows: pd.DataFrame) -> pd.DataFrame:
    same = np.diff(rows["cell"].to_numpy()) == 0
    return rows[np.append(same, False) | np.insert(same, 0, False)] if len(rows) else rows


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in map(_alone_left_out, _whole_cells(batches)):
        node, tree = rows["node"].to_numpy(), np.arange(len(rows))
        for a, b in agreeing(rows["cell"].to_numpy(), _marks(rows) if len(rows) else np.zeros((0, 1)), tree, LIKELY):
            a, b = (np.array(x, int) for x in _join_up(tree, a, b))
            yield pd.DataFrame({"a": node[a], "b": node[b]})


def _active(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in map(_alone_left_out, _whole_cells(batches)):
        if len(rows):
            active = np.zeros(len(rows), bool)
            for a, b in agreeing(rows["cell"].to_numpy(), _marks(rows), rows["root"].to_numpy(), POSSIBLE):
                active[a] = active[b] = True
            yield rows[active]


def _uniting(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_cells(batches):
            cell, node = rows["cell"].to_numpy(), rows["node"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = rows.iloc[start:end]
                if len(part) > 1:
                    a, b = united(part["root"].to_numpy(), _marks(part), [np.frombuffer(x, "<u8") for x in part["shingles"]], similarity)
                    yield pd.DataFrame({"a": node[start:end][a], "b": node[start:end][b]})

    return run


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored ``(node, n, shingles)`` for ``wanted(node, n)``; ``nodes`` has the row of ``docs`` that holds a node's text."""
    keyed = materialize(wanted.join(nodes.select("node", "least.doc_key"), "node"), "copies-wanted")
    texts = docs.join(broadcast_if_fits(keyed), "doc_key").select("node", "n", "text").dropDuplicates(["node"])
    return materialize(texts.select("node", "n", shingle_bytes("text").alias("shingles")), "copies-sets")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets have the wanted similarity; they come from forests, so they are few."""
    pairs = materialize(pairs.distinct(), "copies-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    sets, total = _sets(ends, nodes, docs), pairs.count()
    for end, other in (("a", "b"), ("b", "a")):
        pairs = hot_join(pairs, sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}"), "n"), end, "n", total, F.xxhash64(other), "inner")
    return materialize(pairs.where(jaccard("set_a", "set_b") >= similarity - 1e-9).select("a", "b"), "copies-verified")


def _dealt(seed: int, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "key", "node"), parts).cast("int")


def _meeting_cells() -> Column:
    """The cells of a row whose band holds several groups: one, or in a large band those of its block in a grid.

    Blocks of the rows outside the largest group stand against blocks of all rows.
    """
    i, j = _dealt(1, F.col("minor_blocks")), _dealt(2, F.col("blocks"))
    cell = lambda x, y: F.xxhash64(F.lit(3), "key", x, y)
    among_all = F.transform(F.sequence(F.lit(0), F.col("minor_blocks") - 1), lambda x: cell(x, j))
    as_minor = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: cell(i, y))
    return (F.when(F.col("blocks") == 1, F.array("key")).when(F.col("root") == F.col("major"), among_all)
            .otherwise(F.array_distinct(F.concat(among_all, as_minor))))


def simhash_links(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` of SimHash among ``nodes(node, least, fp)`` that have the wanted similarity.

    Nodes of one fingerprint hang on the smallest of them; fingerprints are linked
    by the near-duplicate operator's forest.
    """
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "copies-prints")
    size = prints.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    heads = prints.where("n > 1").select("fp", F.col("node").alias("b"), "n")
    same = hot_join(nodes.select("node", "fp"), heads, "fp", "n", size["total"], F.xxhash64("node"), "inner").where("node <> b")
    return _verified(same.select(F.col("node").alias("a"), "b").unionByName(links(prints.select("node", "fp"), size["rows"])), nodes, docs, similarity)


def near_links(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS, known: DataFrame | None = None) -> DataFrame:
    """Links ``(a, b)`` that join all near copies among ``nodes(node, least, marks, size, keys)`` that share a band.

    ``known`` are verified links of another method; what they join needs no more links.
    """
    spark = nodes.sparkSession
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("rows", F.col("n")), "copies-shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    met = hot_join(nodes.select("node", "marks", "size", F.explode("keys").alias("key")), shared, "key", "n", total, F.xxhash64("node"), "inner")
    met = materialize(met, "copies-met")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / 1_000_000))

    def meetings(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "cell").sortWithinPartitions("cell", "node")

    # each band deals its rows anew, so the blocks of a large group overlap from band to band
    blocks = F.ceil(F.col("rows") / (2 * cell_rows)).cast("int")
    first = met.select("node", "marks", F.when(blocks == 1, F.col("key")).otherwise(F.xxhash64(F.lit(4), "key", _dealt(0, blocks))).alias("cell"))
    sure = _verified(meetings(first).mapInPandas(_likely, "a long, b long"), nodes, docs, similarity)
    sure = sure if known is None else sure.unionByName(known)

    star = components(sure, "copies-sure").withColumnRenamed("node", "member")
    apart = met.join(star, F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node")).drop("member", "rows")
    apart = materialize(apart, "copies-apart")
    by_root = apart.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    by_key = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("roots"), F.max(F.struct("n", "s", "root")).alias("most")).where("roots > 1")
    many = lambda rows, shingles: F.greatest(F.ceil(rows / cell_rows), F.ceil(shingles / CELL_SHINGLES)).cast("int")
    by_key = materialize(by_key.select("key", "n", F.col("most.root").alias("major"), many(F.col("n"), F.col("s")).alias("blocks"),
                                       F.greatest(F.lit(1), many(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s"))).alias("minor_blocks")), "copies-mixed")
    left = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    mixed = hot_join(apart, by_key, "key", "n", left, F.xxhash64("node"), "inner").select("node", "root", "marks", F.explode(_meeting_cells()).alias("cell"))
    active = materialize(meetings(mixed).mapInPandas(_active, "node long, root long, marks binary, cell long"), "copies-active")
    sets = _sets(active.groupBy("node").agg(F.count("*").alias("n")), nodes, docs)
    with_sets = hot_join(active, sets, "node", "n", active.count(), F.xxhash64("cell"), "inner")
    more = meetings(with_sets.select("node", "root", "marks", "shingles", "cell")).mapInPandas(_uniting(similarity), "a long, b long")
    return sure.unionByName(materialize(more, "copies-united"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, null last.

    SimHash links and, for what they miss, MinHash bands propose.  Near copies have a
    Jaccard similarity of ``similarity`` or more in distinct
    five-word shingles, by count, and groups are joined by such pairs.  A text of
    fewer words is its own shingle.  Rows equal in id and text are one row; null
    and blank texts are copies of each other.  Texts are read whole, whatever
    their length.  Other columns are passed on under any name.  An empty table
    gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("doc_id"), _key(id_col, text_col).alias("doc_key"), F.col(text_col).alias("text"))
    sketched = keyed.select("doc_id", "doc_key", simhash("text").alias("fp"), sketches("text").alias("x")).select("doc_id", "doc_key", "fp", "x.*")
    groups = _groups(materialize(sketched, "copies-sketches"))
    texts = keyed.select("doc_key", "text")
    named = _named(groups, near_links(groups, texts, similarity, known=simhash_links(groups, texts, similarity)))
    stay = materialize(named.select(F.col("least.doc_key").alias("stays")).distinct(), "copies-stay")
    rows = docs.select(_key(id_col, text_col).alias("doc_key"), F.struct(*docs.columns).alias("row"))
    return rows.join(stay, F.col("doc_key") == F.col("stays"), "left_semi").dropDuplicates(["doc_key"]).select("row.*")
