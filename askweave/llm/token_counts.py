"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton enumerates the vocabulary matches of a text; dynamic
programming carries the best score and its piece count for each position.  The
tie rules are those of the ``tokenizers`` library's unigram model: of equal scores
the piece that starts first wins, an unknown character is possible only where it is
no piece itself, scores ``10`` less than the worst piece, and counts its bytes.

Pieces hold the word mark only at their start, and no line breaks, so a text is
counted in units: the marks and the word behind them.  Equal units of a batch are
counted once.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from askweave.llm.common import bounded_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Units whose counts a Python worker keeps.
KEPT_UNITS = 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file; its size is fixed by the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counting:
    """Counts the pieces of texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        whole = [p for p, _ in pieces if p.strip(MARK)]
        self.by_words = not any(MARK in p.lstrip(MARK) for p in whole)
        self.by_lines = not any("\n" in p for p, _ in pieces)
        self.kept: dict[str, int] = {}

    def pieces(self, unit: str) -> int:
        """Pieces on the best path over a unit."""
        n = len(unit)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        known = [None] * n
        for end, match in self.automaton.iter(unit):
            if known[end] is None:
                known[end] = [match]
            else:
                known[end].append(match)
        unknown, single = self.unknown, self.single
        for end in range(n):
            at, top, pieces = end + 1, None, 0
            for size, score in known[end] or ():  # the longest match, which starts first, comes first
                total = best[at - size] + score
                if top is None or total > top:
                    top, pieces = total, count[at - size] + 1
            if unit[end] not in single:
                total = best[end] + unknown
                if top is None or total > top:
                    top, pieces = total, count[end] + len(unit[end].encode())
            best[at], count[at] = top, pieces
        return count[n]

    def units(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        if not self.by_words:
            return [marked]
        lines = re.split("(\n)", marked) if self.by_lines else [marked]
        return [u for line in lines for u in re.findall(f"{MARK}+[^{MARK}]*|^[^{MARK}]+", line)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, kept = 0, self.kept
        for unit, times in Counter(self.units(text)).items():
            n = kept.get(unit)
            if n is None:
                if len(kept) >= KEPT_UNITS:
                    kept.clear()
                n = self.pieces(unit)
                if len(unit) <= 64:
                    kept[unit] = n
            total += n * times
        return total


@lru_cache(maxsize=2)
def _counting(pieces: tuple[tuple[str, float], ...]) -> Counting:
    return Counting(list(pieces))


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text; null and empty texts have none.

    Every row is counted by itself and whole; repeated rows count alike, null ids
    do not matter, an existing column of the name is replaced, and an empty table
    stays empty.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(pieces))

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        counting = _counting(shared.value)
        return pd.Series([counting.count(t) for t in texts], dtype="int64")

    return docs.withColumn(name, count(F.col(text_col)))
