"""Near duplicates among vectors by an exact metric range join.

Unit vectors with a cosine of at least ``c`` lie within ``r = sqrt(2 - 2 c)`` of
each other, so links are the pairs of a range join in a metric space:

1. *Pivots partition.* A bounded sample gives each label a tree of pivots.  A
   vector's home is the cell of its nearest pivot, level by level.
2. *The triangle inequality sets replication.* A vector within ``r`` of one whose
   home is pivot ``i`` lies at most ``2 r`` further from ``i`` than from its own
   pivot (and at most ``r`` beyond the plane between the two).  It visits those
   cells, and only those before its own, so each pair meets in one cell.
3. *Cells join independently.* Rows within ``r / 2`` of a cell's centre are all
   linked, by the triangle inequality again: they are counted, not compared.  The
   others are compared with all, in bounded blocks.

Only the sample's fit decides how rows are cut; it never decides a link.  A split
that would copy most rows to most children is not made: where vectors have no
clusters, blocks of a cell cost less than copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from askweave.llm.common import hot_join, materialize
from askweave.llm.graph import components
from askweave.session import broadcast_if_fits

SIMILARITY = 0.98
#: Rows of a cell that is not cut further, and rows on both sides of one comparison.
CELL_ROWS = 16_384
OWN_ROWS = 4_096
MET_ROWS = 4_096
#: Bytes of the sample that fits the pivots, and children of one pivot node at most.
SAMPLE_BYTES = 24 << 20
FAN = 16
#: A cut is made if a row goes to less than this share of the children.
COPIED = 0.6
#: Slack for rounding in distances, which decides what is compared, never what is linked.
SLACK = 1e-6
_BATCH = 4096


@dataclass
class Node:
    """A cell: a centre, and pivots with their cells where it is cut."""

    centre: np.ndarray
    leaf: int = 0
    pivots: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)


def _squared(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T), 0)


def _visits(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot, and which pivots' cells may hold rows within ``radius`` of it."""
    sq = _squared(x, pivots)
    home = sq.argmin(1)
    at = np.arange(len(x))
    least, d = sq[at, home][:, None], np.sqrt(sq)
    between = np.sqrt(_squared(pivots, pivots))[home]
    near = (d <= np.sqrt(least) + 2 * radius + SLACK) & (sq - least <= 2 * radius * between + SLACK)
    near[at, home] = True
    return home, near


def grow(sample: np.ndarray, rows: float, radius: float, cell_rows: int = CELL_ROWS, seed: int = 0) -> tuple[Node, int]:
    """A tree for about ``rows`` vectors of which ``sample`` is a part, and its number of leaves."""
    leaves = 0

    def cut(part: np.ndarray, depth: int) -> Node:
        nonlocal leaves
        node = Node(part.mean(0))
        fan = min(FAN, ceil(rows * len(part) / max(1, len(sample)) / cell_rows), len(part) // 8)
        if fan > 1 and depth < 12:
            rng = np.random.default_rng(seed + depth)
            pivots = part[[rng.integers(len(part))]]
            for _ in range(fan - 1):  # far from those before, but not the farthest of all
                away = _squared(part, pivots).min(1)
                pivots = np.vstack([pivots, part[np.argsort(away)[-1 - len(part) // 50]]])
            home = _squared(part, pivots).argmin(1)
            pivots = np.vstack([part[home == i].mean(0) for i in range(fan) if (home == i).any()])
            home, near = _visits(part, pivots, radius)
            sizes = np.bincount(home, minlength=len(pivots))
            if len(pivots) > 1 and near.sum(1).mean() < COPIED * len(pivots) and sizes.max() < 0.9 * len(part):
                node.pivots = pivots
                node.children = [cut(part[home == i], depth + 1) if sizes[i] else Node(pivots[i]) for i in range(len(pivots))]
                for child in node.children:
                    if not child.children and not child.leaf:
                        leaves += 1
                        child.leaf = leaves
                return node
        leaves += 1
        node.leaf = leaves
        return node

    return cut(sample, 0), leaves


def route(tree: Node, x: np.ndarray, radius: float) -> Iterator[tuple[Node, np.ndarray, np.ndarray]]:
    """For each leaf that rows of ``x`` go to: the leaf, the rows, and which of them have their home there."""
    todo = [(tree, np.arange(len(x)), np.ones(len(x), bool))]
    while todo:
        node, rows, own = todo.pop()
        if not node.children:
            yield node, rows, own
            continue
        home, near = _visits(x[rows], node.pivots, radius)
        for i, child in enumerate(node.children):
            goes = np.where(own, (home == i) | (near[:, i] & (i < home)), near[:, i])
            if goes.any():
                todo.append((child, rows[goes], own[goes] & (home[goes] == i)))


def _unit(values: pd.Series) -> pd.Series:
    """Unit vectors as bytes of doubles; null where a vector links with nothing."""
    def of(v) -> bytes | None:
        if v is None or len(v) == 0:
            return None
        x = np.array([np.nan if e is None else e for e in v], float)
        if not np.isfinite(x).all() or not x.any():
            return None
        x = x / np.abs(x).max()
        return (x / np.sqrt(x @ x)).tobytes()

    return pd.Series([of(v) for v in values], dtype=object)


def unit_vectors(vector: Column) -> Column:
    return F.pandas_udf(_unit, BinaryType())(vector)


def _stacked(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def _routed(trees: dict[int, Node], radius: float):
    """Rows of a class go to their leaves: ``role`` 0 at the home's core, 1 at home, 2 as a visitor."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, rows in batch.groupby("tree"):
                if tree not in trees:  # no row of the group was sampled: one cell without a centre
                    yield rows.assign(leaf=0, role=1)[["tree", "leaf", "role", "node", "n", "unit"]]
                    continue
                x = _stacked(rows["unit"])
                for leaf, at, own in route(trees[tree], x, radius):
                    core = own & (np.sqrt(_squared(x[at], leaf.centre[None, :]))[:, 0] <= radius / 2 - SLACK)
                    yield rows.iloc[at].assign(leaf=leaf.leaf, role=np.where(core, 0, np.where(own, 1, 2)))[["tree", "leaf", "role", "node", "n", "unit"]]

    return run


def _blocks(n: int, size: int = 512) -> Iterator[slice]:
    return (slice(at, at + size) for at in range(0, n, size))


def _label_roots(linked: np.ndarray, own: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that each row of both sides reaches inside this comparison."""
    top = np.iinfo(np.int64).max
    while True:
        new_own, new_met = own.copy(), met.copy()
        for s in _blocks(len(own)):
            new_own[s] = np.minimum(own[s], np.where(linked[s], met[None, :], top).min(1))
            new_met = np.minimum(new_met, np.where(linked[s], new_own[s, None], top).min(0))
        if np.array_equal(new_own, own) and np.array_equal(new_met, met):
            return own, met
        own, met = new_own, new_met


def _compare(similarity: float):
    """For each row of a comparison that reaches another: how many vectors it links with, and the smallest node it reaches."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "to": []}).astype("int64")
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        x, y = _stacked(left["unit"]), _stacked(right["unit"])
        weight_a, weight_b = left["n"].to_numpy(), right["n"].to_numpy()
        home_a, home_b = left["role"].to_numpy() == 1, right["role"].to_numpy() == 1
        linked = np.empty((len(a), len(b)), bool)
        n_left, n_right = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for s in _blocks(len(a)):
            same = a[s, None] == b[None, :]
            found = (x[s] @ y.T >= similarity) & ~same
            n_left[s] = np.where(found, weight_b[None, :], 0).sum(1)
            # rows at home on both sides meet twice, once from each side: they are counted on the left
            n_right += np.where(found & ~(home_a[s, None] & home_b[None, :]), weight_a[s, None], 0).sum(0)
            linked[s] = found | same  # the two places of a node share their label
        to_left, to_right = _label_roots(linked, a, b)
        out = pd.DataFrame({"node": np.concatenate([a, b]), "links": np.concatenate([n_left, n_right]), "to": np.concatenate([to_left, to_right])})
        return out[(out["links"] > 0) | (out["to"] != out["node"])].astype("int64")

    return run


def _trees(classes: DataFrame, radius: float, cell_rows: int, sample_bytes: int) -> dict[int, Node]:
    """A tree for each group that the sample holds; the driver sees ``sample_bytes`` of vectors at most."""
    size = classes.agg(F.count("*").alias("rows"), F.max(F.octet_length("unit")).alias("bytes")).first()
    if not size["rows"]:
        return {}
    most = max(1, sample_bytes // size["bytes"])
    near = min(1.0, most / size["rows"])
    chosen = classes.where(F.xxhash64(F.lit(5), "node").cast("double") / 2.0**63 < 2 * near - 1).select("tree", "unit").limit(most).toPandas()
    return {int(tree): grow(_stacked(part["unit"]), len(part) / near, radius, cell_rows)[0] for tree, part in chosen.groupby("tree")}


def _cell_sizes(routed: DataFrame) -> DataFrame:
    role = lambda *r: F.count(F.when(F.col("role").isin(*r), 1))
    core = F.col("role") == 0
    return routed.groupBy("tree", "leaf").agg(role(0, 1).alias("own"), role(1, 2).alias("met"), F.sum(F.when(core, F.col("n"))).alias("core_n"), F.min(F.when(core, F.col("node"))).alias("core_node"))


def range_join(classes: DataFrame, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS, own_rows: int = OWN_ROWS, met_rows: int = MET_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(node, links, to)`` for ``classes(tree, node, n, unit)``: partial counts of linked rows of other classes, and a node of the same component.

    ``tree`` names the groups that are compared; their vectors have equal lengths.
    """
    radius = float(np.sqrt(2 - 2 * similarity))
    trees = _trees(classes, radius, cell_rows, sample_bytes)
    routed = classes.mapInPandas(_routed(trees, radius), "tree long, leaf long, role int, node long, n long, unit binary")
    routed = materialize(routed, "vectors-routed")
    sizes = materialize(_cell_sizes(routed), "vectors-cells")
    sized = routed.join(broadcast_if_fits(sizes), ["tree", "leaf"])
    core = sized.where("role = 0 and core_n > n").select("node", (F.col("core_n") - F.col("n")).alias("links"), F.col("core_node").alias("to"))
    meets = sized.where((F.col("own") > 0) & (F.col("met") > 0))
    owns, mets = F.ceil(F.col("own") / own_rows).cast("int"), F.ceil(F.col("met") / met_rows).cast("int")
    dealt = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), parts).cast("int")
    every = lambda parts: F.sequence(F.lit(0), parts - 1)
    cell = ["tree", "leaf", "role", "node", "n", "unit"]
    left = meets.where("role < 2").select(*cell, F.lit(0).alias("side"), dealt(owns, 1).alias("i"), F.explode(every(mets)).alias("j"))
    right = meets.where("role > 0").select(*cell, F.lit(1).alias("side"), dealt(mets, 2).alias("j"), F.explode(every(owns)).alias("i"))
    compared = left.unionByName(right).groupBy("tree", "leaf", "i", "j").applyInPandas(_compare(similarity), "node long, links long, to long")
    return materialize(core.unionByName(compared), "vectors-links")


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(F.col(label_col).isNotNull(), unit_vectors(vector)).alias("unit"))
    key = F.when(F.col("unit").isNotNull(), F.unhex(F.md5(F.concat(F.encode(F.concat(F.col("label").cast("string"), F.lit("|")), "utf-8"), "unit"))))
    return materialize(rows.withColumn("key", key), "vectors-rows")


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **sizes) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Rows of equal label link at a cosine of ``similarity`` or more, in doubles.
    ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest id reachable; ``kept`` tells whether that is
    the row's own.  Null labels, null, empty and zero vectors, and vectors with a
    null or infinite component link with nothing, and vectors of different lengths
    do not link.  Equal vectors are compared once.  Rows without an id count as
    links but name no component: a component without ids has a null name, and its
    rows are kept.  Repeated rows link with each other.  Extra columns are not
    read.  An empty table gives an empty result.
    """
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_BATCH))
    rows = _rows(vectors, id_col, vector_col, label_col)
    place = F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id")
    classes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.min(place).alias("least"), F.count("*").alias("n"))
    tree = F.xxhash64(F.col("label").cast("string"), F.octet_length("unit"))
    classes = materialize(classes.select("key", "unit", "least", "n", tree.alias("tree"), F.monotonically_increasing_id().alias("node")), "vectors-classes")
    found = range_join(classes.select("tree", "node", "n", "unit"), similarity, **sizes)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    star = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), "vectors").withColumnRenamed("node", "member")
    named = classes.select("key", "node", "least", "n").join(counted, "node", "left").join(star, F.col("node") == F.col("member"), "left")
    named = materialize(named.select("key", "least", "n", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "vectors-named")
    first = named.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members"))
    total = named.count()
    named = hot_join(named, first, "root", "members", total, F.col("key"), "inner")
    table = materialize(named.select("key", F.col("first.vec_id").alias("_component"), (F.col("links") + F.col("n") - 1).alias("_links"), "n"), "vectors-table")
    out = hot_join(rows.select("vec_id", "key"), table, "key", "n", rows.count(), F.struct("vec_id", F.monotonically_increasing_id()))
    component = F.when(F.col("_links").isNull(), F.col("vec_id")).otherwise(F.col("_component"))
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
