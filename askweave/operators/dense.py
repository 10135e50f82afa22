"""Exact dense search for whole query sets.

Queries and vectors are laid out on a grid of cells of bounded size.  Each cell
is one matrix product inside a task and emits only its best ``k`` rows per
query, so no list of all pairs ever exists and no side has to fit a broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askweave.operators import ranking

CELL_BYTES = 64 << 20
QUERY_BLOCK = 2048
#: Rows of the score matrix a task holds at a time: 256 queries by 8 192 vectors of 8 bytes, 16 MB.
SCORE_ROWS, SCORE_COLUMNS = 256, 8192
#: A cell of fewer vectors is not worth a task of its own.
LEAST_CELL = 1024
METRICS = ("cosine", "ip", "l2")


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _first_k(row: np.ndarray, ids: np.ndarray, cost: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` entries of least cost, then least id, of each row number."""
    order = np.lexsort((ids, cost, row))
    row = row[order]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    return order[place < k]


def _block_top_k(q: np.ndarray, v: np.ndarray, ids: np.ndarray, metric: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and scores of each query's best ``k`` vectors, one bounded score block at a time."""
    best = (np.empty(0, np.int64), np.empty(0, ids.dtype), np.empty(0), np.empty(0))
    for at in range(0, len(v), SCORE_COLUMNS):
        part, part_ids = v[at : at + SCORE_COLUMNS], ids[at : at + SCORE_COLUMNS]
        scores = q @ part.T
        if metric == "l2":
            scores = (q * q).sum(1)[:, None] + (part * part).sum(1)[None, :] - 2 * scores
        scores = np.round(scores, 6) + 0.0
        cost = scores if metric == "l2" else -scores
        if cost.shape[1] > k:  # all that ties with the k-th stays until ids decide
            row, column = np.nonzero(cost <= np.partition(cost, k - 1, axis=1)[:, k - 1 : k])
        else:
            row, column = np.nonzero(np.ones(cost.shape, bool))
        best = tuple(np.concatenate(x) for x in zip(best, (row, part_ids[column], scores[row, column], cost[row, column]), strict=True))
        keep = _first_k(best[0], best[1], best[3], k)
        best = tuple(x[keep] for x in best)
    return best[:3]


def _cell_top_k(metric: str, k: int, keep_positive: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            q = np.stack(left["vector"].to_numpy()).astype("float64")
            v = np.stack(right["vector"].to_numpy()).astype("float64")
            ids, q_ids = right["doc_id"].to_numpy(), left["query_id"].to_numpy()
            if metric == "cosine":
                q, v = _unit(q), _unit(v)
            for at in range(0, len(q), SCORE_ROWS):
                row, found, scores = _block_top_k(q[at : at + SCORE_ROWS], v, ids, metric, k)
                good = scores > 0 if keep_positive else np.ones(len(scores), bool)
                out.append((q_ids[at + row[good]], found[good], scores[good]))
        query, doc, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": query, "doc_id": doc, "score": score})

    return run


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine",
                query_id: str = "query_id", query_vector: str = "vector", doc_id: str = "doc_id",
                doc_vector: str = "vector") -> DataFrame:
    """Ranked hits ``query_id, doc_id, score, rank``.

    ``cosine`` keeps positive scores only; ``l2`` returns squared distances in
    ascending order.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).alias("vector"))
    v = vectors.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_vector).alias("vector"))
    # One count of each side; the width from one row.
    first = v.first()
    width = len(first["vector"]) if first else 1
    per_cell = max(1, CELL_BYTES // (8 * width))
    n_vectors, n_queries = v.count(), q.count()
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    # Enough cells for memory, and for every core as long as they are worth a task.
    wanted = math.ceil(v.sparkSession.sparkContext.defaultParallelism / blocks)
    cells = max(1, math.ceil(n_vectors / per_cell), min(wanted, n_vectors // LEAST_CELL))

    def spread(key, n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = q.withColumn("block", spread("query_id", blocks)).withColumn("cell", every(cells))
    right = v.withColumn("cell", spread("doc_id", cells)).withColumn("block", every(blocks))
    local = left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInPandas(
        _cell_top_k(metric, k, metric == "cosine"), "query_id long, doc_id long, score double"
    )
    return ranking.top_k(local, k, ascending=metric == "l2")


def encode(df: DataFrame, text: str, encoder, name: str = "vector") -> DataFrame:
    """Add vectors from an ``encoder`` (pandas UDF: text series to list series), once per distinct text."""
    distinct = df.select(text).distinct().withColumn(name, encoder(F.col(text)))
    return df.join(distinct, text)
