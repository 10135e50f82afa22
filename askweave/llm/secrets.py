"""Secrets in text: fixed patterns, and random strings found by two Markov models.

One character model is trained on strings the patterns label as random, the other
on the ordinary identifiers around them.  A long token whose log-likelihood ratio
between the two is high is reported as well.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askweave.llm.common import bounded_batches

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the run is taken whole, so its least length can stand in the pattern
HEX = re.compile(r"[0-9a-f]{16,}")
VALUE = 12

#: Characters the models tell apart; all others share the last state.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
LONG_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Documents (in expectation) the models are trained on.
SAMPLE_DOCS = 20_000
#: Least ratio of a reported token in nats, in all and for each character.
LEAST_RATIO = 16.0
LEAST_MEAN = 0.8
#: Counts that the back-off of a state weighs.
BACK_OFF = 200.0

_CODE = np.full(256, STATES - 1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns, in order."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS) or "ſ" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _steps(token: str) -> np.ndarray:
    code = _CODE[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]
    return code[:-1] * STATES + code[1:]


class _Covered:
    """Places that spans cover, merged and in order, so that a lookup is a binary search."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in spans:  # sorted by start
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def clear(self, a: int, b: int) -> bool:
        """Whether no span overlaps the places from ``a`` to ``b``."""
        at = bisect_left(self.starts, b)
        return at == 0 or self.ends[at - 1] <= a


def labelled_steps(text: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Transitions of the strings that the patterns mark as secrets, and of the tokens that touch none."""
    spans = base_spans(text)
    random = [_steps(m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= VALUE] if any(k == 0 for _, k, _ in spans) else []
    random += [_steps(text[a:b]) for a, k, b in spans if k > 0]
    covered = _Covered(spans)
    return random, [_steps(m.group()) for m in TOKEN.finditer(text) if covered.clear(*m.span())]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((2, STATES * STATES), np.int64)
    for batch in batches:
        for text in batch["text"]:
            for label, steps in enumerate(labelled_steps(text or "")):
                if steps:
                    total[label] += np.bincount(np.concatenate(steps), minlength=STATES * STATES)
    label, cell = np.nonzero(total)
    yield pd.DataFrame({"label": label, "cell": cell, "n": total[label, cell]})


def ratios(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition, random against ordinary.

    The model of random strings is half what was seen and half uniform, as a
    random string may use any alphabet.  Ordinary transitions back off to how often
    ordinary tokens use the character at all.
    """
    seen = counts.reshape(2, STATES, STATES).astype(float)
    random = 0.5 / STATES + 0.5 * (seen[0] + 1.0) / (seen[0] + 1.0).sum(1, keepdims=True)
    used = (seen[1].sum(0) + 0.5) / (seen[1].sum() + 0.5 * STATES)
    ordinary = (seen[1] + BACK_OFF * used) / (seen[1].sum(1, keepdims=True) + BACK_OFF)
    return (np.log(random) - np.log(ordinary)).ravel()


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Transition ratios from a sample of ``sample_docs`` documents, chosen by a hash of id and text."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("_id")).where(F.xxhash64(F.lit(3), "_id", "text").cast("double") / 2.0**63 <= 2 * share - 1).select("text")
    counts = np.zeros((2, STATES * STATES), np.int64)
    for r in rows.mapInPandas(_count, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["cell"]] = r["n"]
    return ratios(counts)


def markov_spans(text: str, base: list[tuple[int, int, int]], ratio: np.ndarray) -> list[tuple[int, int, int]]:
    found, covered = [], _Covered(base)
    for m in LONG_TOKEN.finditer(text):
        score = float(ratio[_steps(m.group())].sum())
        if score >= LEAST_RATIO and score >= LEAST_MEAN * (m.end() - m.start() - 1) and covered.clear(*m.span()):
            found.append((m.start(), 3, m.end()))
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of each row.

    Spans are offsets in code points, end exclusive; ``markov`` spans overlap no
    pattern's span.  Null and empty texts have no spans.  Null ids and repeated
    rows are scanned like others, texts whole.  Without labelled strings the
    models are near uniform and add nothing.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, id_col) if ratio is None else ratio)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratio = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                base = base_spans(text)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((doc, *n, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(sorted(base + markov_spans(text, base, ratio)))))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out["doc_id"] = batch["doc_id"].to_numpy()
            yield out

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
