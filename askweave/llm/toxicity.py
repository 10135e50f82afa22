"""Toxicity by subword embeddings averaged into a linear softmax.

A text is the bag of the character n-grams of its words; n-grams share
``BUCKETS`` embedding rows by hash, their mean feeds a linear softmax of two
classes, and embeddings and softmax are trained jointly by gradient descent in
numpy.  A misspelling shares most n-grams with the word it hides.

Training takes a bounded sample of labelled rows in one task.  For scoring the
embeddings are folded with the softmax into one number a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from askweave.llm.common import bounded_batches

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMS = 8
#: Labelled rows of each class used for training (in expectation; chosen by a hash of the id).
TOXIC_ROWS = 2000
CLEAN_ROWS = 5000
EPOCHS = 12
BATCH = 64
RATE = 0.02
#: The mean over all n-grams of a text is small; this scale brings logits into range.
GAIN = 100.0
THRESHOLD = 0.3
#: Standard errors of a bucket's class difference from which it is trained.
LEAST_Z = 4.0
PIECE = 1 << 20
#: Neutral n-grams each text is averaged with, so that a few words alone decide nothing.
PAD = 1000

_FOLD = bytes(32 if chr(i) in " \t\n\x0b\x0c\r.,;:!?\"'()[]" else i for i in range(256))


def gram_ids(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams inside words, word edges included; long texts come in pieces."""
    raw = b" " + (text or "").lower().encode().translate(_FOLD) + b" "
    for at in range(0, len(raw), PIECE):
        part = np.frombuffer(raw[at : at + PIECE + GRAMS[-1] - 1], np.uint8)
        blank = np.cumsum(np.append(0, part == 32))
        code = part.astype(np.uint64)
        mixed = np.zeros(len(part), np.uint64)
        power = 1
        for k in range(GRAMS[-1]):
            n = k + 1
            if len(part) < n:
                break
            mixed = mixed[: len(part) - k] + code[k:] * np.uint64(power)
            power = power * 0x9E3779B97F4A7C15 % (1 << 64)
            if n in GRAMS:
                inner = blank[n - 1 : len(part)] == blank[1 : len(part) - n + 2]  # no blank but at the ends
                inner = inner[: PIECE]
                h = mixed[: PIECE][inner] * np.uint64(0xD6E8FEB86659FD93)
                yield ((h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(47)).astype(np.int32)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares; repeats count by their square root."""
    count = np.zeros(BUCKETS, np.int32)
    for ids in gram_ids(text):
        count += np.bincount(ids, minlength=BUCKETS).astype(np.int32)
    ids = np.flatnonzero(count)
    return ids.astype(np.int32), (np.sqrt(count[ids]) / (PAD + count.sum())).astype(np.float32)


def chosen_buckets(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Buckets whose document frequency differs between the classes by ``LEAST_Z`` standard errors; the rest stay zero."""
    have = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for (ids, _), label in zip(bags, toxic, strict=True):
        have[label][ids] += 1
    n = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    part = (have[0] + have[1]) / (n[0] + n[1])
    error = np.sqrt(part * (1 - part) * (1 / n[0] + 1 / n[1])) + 1e-12
    return np.abs(have[1] / n[1] - have[0] / n[0]) >= LEAST_Z * error


def fit(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Bucket weights and bias of the trained model; both classes must occur."""
    rng = np.random.default_rng(seed)
    use = chosen_buckets(bags, toxic)
    bags = [(i[use[i]], s[use[i]]) for i, s in bags]
    rows = rng.normal(0, 0.05, (BUCKETS, DIMS)).astype(np.float32)
    rows[~use] = 0
    soft = rng.normal(0, 0.3, (DIMS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    order = rng.permutation(len(bags))
    held, order = order[: len(order) // 5], order[len(order) // 5 :]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (rows, soft, bias)]
    step = 0
    for epoch in range(epochs):
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            sizes = [len(bags[i][0]) for i in part]
            ids = np.concatenate([bags[i][0] for i in part])
            share = np.concatenate([bags[i][1] for i in part]) * np.float32(GAIN)
            doc = np.repeat(np.arange(len(part)), sizes)
            picked = rows[ids] * share[:, None]
            mean = np.stack([np.bincount(doc, picked[:, d], minlength=len(part)) for d in range(DIMS)], 1).astype(np.float32)
            logits = mean @ soft + bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            error = chance - np.eye(2, dtype=np.float32)[toxic[part]]
            error *= (weight[part] / weight[part].sum())[:, None]
            back = error @ soft.T
            touched, inverse = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(inverse, share * back[doc, d], minlength=len(touched)) for d in range(DIMS)], 1)
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m, v), where in ((rows, grad, state[0], touched), (soft, mean.T @ error, state[1], slice(None)), (bias, error.sum(0), state[2], slice(None))):
                m[where] = 0.9 * m[where] + 0.1 * g
                v[where] = 0.999 * v[where] + 0.001 * g * g
                p[where] -= rate * m[where] / (np.sqrt(v[where]) + 1e-8)
    side = soft[:, 1] - soft[:, 0]
    fold = (rows @ side * GAIN).astype(np.float64)
    return calibrated(fold, float(bias[1] - bias[0]), [bags[i] for i in held], toxic[held], weight[held])


def calibrated(fold: np.ndarray, bias: float, bags: list, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slope and shift of the logit, fitted on rows that were kept back, so that scores are chances."""
    x = np.array([float(fold[i] @ s) for i, s in bags]) + bias
    if len(x) < 20 or toxic.min() == toxic.max():
        return fold, bias
    ends = (weight * toxic).sum(), (weight * (1 - toxic)).sum()
    goal = np.where(toxic == 1, (ends[0] + 1) / (ends[0] + 2), 1 / (ends[1] + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, w = weight * (p - goal), weight * p * (1 - p) + 1e-9
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, np.array([(g * x).sum() + 1e-3 * (a - 1), g.sum()]))
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
    return (fold * a, bias * a + b) if a > 0 else (fold, bias)


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bags, toxic, weight = [], [], []
    for batch in batches:
        for r in batch.itertuples():
            bags.append((np.frombuffer(r.ids, np.int32), np.frombuffer(r.shares, np.float32)))
            toxic.append(r.toxic)
            weight.append(r.weight)
    order = sorted(range(len(bags)), key=lambda i: (toxic[i], len(bags[i][0]), zlib.crc32(bags[i][0].tobytes())))  # arrival order varies
    toxic, weight, bags = np.array(toxic, int)[order], np.array(weight, float)[order], [bags[i] for i in order]
    if len(bags) and toxic.min() != toxic.max():
        fold, bias = fit(bags, toxic, weight)
    else:
        fold, bias = np.zeros(BUCKETS), 20.0 if len(bags) and toxic.min() == 1 else -20.0
    yield pd.DataFrame({"fold": [fold.astype(np.float32).tobytes()], "bias": [bias]})


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [bag(t) for t in batch["text"]]
        yield pd.DataFrame({"toxic": batch["toxic"], "weight": batch["weight"], "ids": [i.tobytes() for i, _ in found], "shares": [s.tobytes() for _, s in found]})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """The folded model, from labelled rows that are not held out.

    A repeated label counts as toxic if one of its rows is; null labels are left
    out.  Without both classes the model gives every text the known one (clean
    where nothing is labelled).
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_label_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out(F.col("_label_id")))
    have = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {k: min(1.0, most / max(1, have.get(k, 0))) for k, most in ((0, CLEAN_ROWS), (1, TOXIC_ROWS))}
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    chosen = known.where(F.pmod(F.xxhash64(F.lit(21), "_label_id"), F.lit(1_000_000)) < share * 1_000_000).withColumn("weight", 1.0 / share)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).select("text", "toxic", "weight")
    model = rows.mapInPandas(_bags, "toxic int, weight double, ids binary, shares binary").repartition(1).mapInPandas(_train, "fold binary, bias double").first()
    if model is None:
        return np.zeros(BUCKETS), -20.0
    return np.frombuffer(model["fold"], np.float32).astype(np.float64), float(model["bias"])


def score_text(text: str | None, fold: np.ndarray, bias: float) -> float:
    n, found = 0, [np.empty(0, np.int32)]
    for ids in gram_ids(text):
        n += len(ids)
        found.append(ids[fold[ids] != 0])
    ids, count = np.unique(np.concatenate(found), return_counts=True)
    return float(1 / (1 + np.exp(-np.clip((fold[ids] @ np.sqrt(count)) / (PAD + n) + bias, -30, 30))))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; a text without n-grams, null included, has
    the score of the bias alone."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        fold, bias = shared.value
        return pd.Series([score_text(t, fold, bias) for t in texts], dtype="float64")

    return docs.withColumn(name, score(F.col(text_col)))
