"""Lexical search with boosts in cells of queries by documents.

Most documents share a word with most questions, and the boosts for phrases are large
beside the base scores, so that a bound on them leaves nearly every pair of question
and document in play.  Here no pair is a row: documents lie in cells of a bounded size,
and a cell adds up the postings of a question's terms in arrays over its documents,
finds the asked phrases once in its tokens, and emits what can be among the best ``k``.

Texts are rows ``doc_id, row, tokens, title_tokens``; ``row`` tells texts of one id
apart.  All texts of an id lie in one cell, which numbers its tokens once.  Questions are
rows ``query_id, ask, n_terms, terms, weights, tokens``; ``ask`` tells questions of one
id apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from askweave.functions import fixed

PHRASE_LIMIT, PHRASE_STEP, WINDOW = 1.5, 0.35, 40
LEAD_LIMIT = 1.0 + 0.8 + 2.4
#: More than what rounding to six digits can move a score.
MARGIN = 2e-6
#: Above every position of a token.
FAR = 1 << 31


def numbered(column) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the distinct values; null is a value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.dictionary_encode(null_encoding="encode")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary


def flat(column) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column, and the number of each row's values; null is an empty list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), size


def places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in the row of each value of lists of these sizes."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted keys."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)


def _units(doc: np.ndarray, length: np.ndarray, title: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each row's (document, length, title length), and the document and length of each number."""
    key, unit = np.unique(np.stack([doc, length, title], axis=1), axis=0, return_inverse=True)
    return unit.reshape(-1), key[:, 0], key[:, 1]


def encode(schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """The texts of a cell with numbers for tokens, and one row with the cell's ``terms``.

    That row has the number of (document, length) pairs of each term, ``dfs``, of all
    pairs, ``n``, and the sum of their lengths.  Texts without an id are only counted.
    """

    def run(docs: pa.Table) -> pa.Table:
        values, size = flat(docs["tokens"])
        titles, title_size = flat(docs["title_tokens"])
        code, vocabulary = numbered(pa.concat_arrays([values, titles]))
        n_terms, (row, _) = max(1, len(vocabulary)), places(size)
        unit, _, length = _units(numbered(docs["doc_id"])[0], size, np.zeros(len(size), np.int64))
        df = np.bincount(np.unique(unit[row] * n_terms + code[: len(row)]) % n_terms, minlength=len(vocabulary))
        texts = {"cell": docs["cell"], "doc_id": docs["doc_id"], "row": docs["row"], "codes": listed(code[: len(row)], size), "title_codes": listed(code[len(row) :], title_size)}
        words = {"cell": docs["cell"].slice(0, 1), "terms": pa.ListArray.from_arrays([0, len(vocabulary)], vocabulary), "dfs": listed(df, np.array([len(df)])),
                 "n": pa.array([len(length)]), "length": pa.array([int(length.sum())])}
        texts, words = (pa.table([rows[f.name].cast(f.type) if f.name in rows else pa.nulls(n, f.type) for f in schema], schema=schema)
                        for rows, n in ((texts, len(docs)), (words, 1)))
        return pa.concat_tables([texts.filter(pc.is_valid(texts["doc_id"])), words])

    return run


def listed(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(values.astype(np.int64)))


class Phrases:
    """Runs of two to four tokens of the questions, as a trie.

    A phrase is part of a text's tokens joined by blanks where its inner tokens are
    tokens there, its first one ends a token and its last one begins the next.
    """

    def __init__(self, questions: list[list[str]]):
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}, {}, {}, {}]  # by number of tokens before: (node, word) to node or phrase
        self.leaf: list[dict[int, int]] = [{}, {}, {}, {}]
        self.asked: list[list[int]] = []
        for tokens in questions:
            for t in tokens:
                self.words.setdefault(t, len(self.words))
        self.base = max(1, len(self.words))
        first, self.count = {}, 0
        for tokens in questions:
            mine = []
            for i in range(len(tokens) - 1):
                node = first.setdefault(self.words[tokens[i]], len(first))
                for n in range(1, min(4, len(tokens) - i)):
                    edge = node * self.base + self.words[tokens[i + n]]
                    if edge not in self.leaf[n]:
                        self.leaf[n][edge] = self.count
                        self.count += 1
                    mine.append(self.leaf[n][edge])
                    node = self.next[n].setdefault(edge, len(self.next[n]))
            self.asked.append(mine)
        self.first = first
        self.tables = [[self._table(d) for d in level] for level in (self.next, self.leaf)]

    @staticmethod
    def _table(d: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        key = np.fromiter(d.keys(), np.int64, len(d))
        order = np.argsort(key)
        return key[order], np.fromiter(d.values(), np.int64, len(d))[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        keys, values = table
        if not len(keys) or not len(key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], -1)

    @staticmethod
    def _ends(vocabulary: list[str], wanted: dict[str, int], suffix: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the vocabulary the wanted words that end (begin) it: numbers, and where each word's begin."""
        lengths = sorted({len(w) for w in wanted})
        found, begin = [], np.zeros(len(vocabulary) + 1, np.int64)
        for i, w in enumerate(vocabulary):
            for n in lengths:
                if n > len(w):
                    break
                x = wanted.get(w[-n:] if suffix else w[:n])
                if x is not None:
                    found.append(x)
            begin[i + 1] = len(found)
        return np.asarray(found, np.int64), begin

    def found(self, vocabulary: list[str], code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and row, sorted and without repeats, of the phrases that rows of tokens hold."""
        words = {w: n for w, n in self.words.items() if n in self.first}
        heads, head_at = self._ends(vocabulary, {w: self.first[n] for w, n in words.items()}, True)
        lasts = {e % self.base for level in self.leaf for e in level}
        tails, tail_at = self._ends(vocabulary, {w: n for w, n in self.words.items() if n in lasts}, False)
        exact = np.asarray([self.words.get(w, -1) for w in vocabulary], np.int64)

        def expand(codes: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = at[codes + 1] - at[codes]
            entry, place = places(size)
            return entry, values[at[codes][entry] + place]

        entry, node = expand(code, head_at, heads)
        n_rows, out = (int(row[-1]) + 1 if len(row) else 0), []
        for n in range(1, 4):
            inside = entry + n < len(code)
            entry, node = entry[inside], node[inside]
            same = row[entry + n] == row[entry]
            entry, node = entry[same], node[same]
            if not len(entry):
                break
            which, tail = expand(code[entry + n], tail_at, tails)
            phrase = self._find(self.tables[1][n], node[which] * self.base + tail)
            hit = phrase >= 0
            out.append(np.unique(phrase[hit] * n_rows + row[entry[which[hit]]]))
            word = exact[code[entry + n]]
            node = np.where(word >= 0, self._find(self.tables[0][n], node * self.base + word), -1)
            entry, node = entry[node >= 0], node[node >= 0]
        key = np.concatenate(out) if out else np.empty(0, np.int64)
        key.sort()
        return key // max(1, n_rows), key % max(1, n_rows)


@dataclass(frozen=True)
class Texts:
    """Numbered tokens of a cell's texts, with the text and the unit of each; texts of equal id and lengths are one unit."""

    doc: np.ndarray
    code: np.ndarray
    row: np.ndarray
    pos: np.ndarray
    title: np.ndarray
    title_row: np.ndarray
    unit: np.ndarray
    unit_doc: np.ndarray
    unit_length: np.ndarray


def _texts(docs: pa.Table) -> tuple[Texts, pa.Array]:
    doc, ids = numbered(docs["doc_id"])
    (codes, size), (titles, title_size) = flat(docs["codes"]), flat(docs["title_codes"])
    code, title = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (codes, titles))
    (row, pos), (title_row, _) = places(size), places(title_size)
    return Texts(doc, code, row, pos, title, title_row, *_units(doc, size, title_size)), ids


def _postings(t: Texts, number: np.ndarray, gain: Callable) -> tuple[np.ndarray, ...]:
    """Of wanted terms by document: term, document, gain, times found, times in a title, first and last first position.

    ``number`` of a token is that of its term, or -1.  Sorted by term; what several
    texts of one id say of a term is added up.
    """
    term = number[np.concatenate([t.code, t.title])]
    at = np.concatenate([t.unit[t.row], t.unit[t.title_row]])
    pos = np.concatenate([t.pos, np.full(len(t.title), FAR)])
    known = term >= 0
    key, pos = (term * len(t.unit_doc) + at)[known], pos[known]
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[order]
    start = _starts(key)
    if not len(start):
        return (np.empty(0, np.int64),) * 7
    key, body = key[start], (pos < FAR).astype(np.int64)
    tf, first, title = np.add.reduceat(body, start), np.minimum.reduceat(pos, start), np.maximum.reduceat(1 - body, start)
    term, at = key // len(t.unit_doc), key % len(t.unit_doc)
    # Units are sorted by document, so documents are sorted within a term.
    d, g = t.unit_doc[at], np.where(tf > 0, gain(np.maximum(tf, 1), t.unit_length[at]), 0.0)
    start = _starts(term * len(t.doc) + d)
    last = np.where(first < FAR, first, -1)
    return (term[start], d[start], np.add.reduceat(g, start), np.add.reduceat((tf > 0).astype(np.int64), start),
            np.add.reduceat(title, start), np.minimum.reduceat(first, start), np.maximum.reduceat(last, start))


def _norms(t: Texts, idf: np.ndarray) -> np.ndarray:
    """By document, the square root of the sum of squared ``(1 + ln tf) * idf`` over all its terms."""
    key, tf = np.unique(t.unit[t.row] * len(idf) + t.code, return_counts=True)
    weight = (1 + np.log(tf)) * idf[key % len(idf)]
    return np.sqrt(np.bincount(t.unit_doc[key // len(idf)], weights=weight * weight, minlength=int(t.doc.max()) + 1))


def cell(k: int, gain: Callable, idf: Callable | None, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The work of a cell: ``query_id, ask, doc_id, row, score, complete`` of the pairs that can be among the best ``k``.

    ``score`` lacks the boost of the first sentence, which only ``complete`` pairs can
    have.  ``gain(tf, length)`` is the part of a term without its weight.  With
    ``idf(df)`` scores are divided by the documents' norms; rows with ``codes`` and
    ``dfs`` then hold the documents of each term in the whole corpus.
    """

    def run(asked: pa.Table, docs: pa.Table) -> pa.Table:
        vocabulary = flat(docs["terms"])[0]
        stats = docs.filter(pc.and_(pc.is_valid(docs["dfs"]), pc.is_null(docs["terms"])))
        docs = docs.filter(pc.is_valid(docs["doc_id"]))
        if not len(asked) or not len(docs) or not len(vocabulary):
            return schema.empty_table()
        texts, ids = _texts(docs)
        phrases = Phrases(asked["tokens"].to_pylist())
        phrase, held = phrases.found(vocabulary.to_pylist(), texts.code, texts.row)
        phrase_at = np.searchsorted(phrase, np.arange(phrases.count + 1)).tolist()
        all_terms, n_asked = flat(asked["terms"])
        weights = flat(asked["weights"])[0].to_numpy(zero_copy_only=False).tolist()
        number, wanted = numbered(all_terms)
        known = pc.fill_null(pc.index_in(vocabulary, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        term, d, g, found, titled, first, last = _postings(texts, known, gain)
        if idf is not None:
            df = np.ones(len(vocabulary))
            df[flat(stats["codes"])[0].to_numpy(zero_copy_only=False)] = flat(stats["dfs"])[0].to_numpy(zero_copy_only=False)
            g = g / np.maximum(_norms(texts, idf(df))[d], 1e-300)
        begin = np.searchsorted(term, np.arange(len(wanted) + 1)).tolist()
        out, at = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))], 0
        for q, (n, n_terms) in enumerate(zip(n_asked.tolist(), asked["n_terms"].to_pylist(), strict=True)):
            base, n_found, n_titled = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            low, high = np.full(len(ids), FAR), np.full(len(ids), -1)
            for i in range(at, at + n):
                x = slice(begin[number[i]], begin[number[i] + 1])
                to = d[x]  # a document is there once for a term
                base[to] += weights[i] * g[x]
                n_found[to] += found[x]
                n_titled[to] += titled[x]
                low[to] = np.minimum(low[to], first[x])
                high[to] = np.maximum(high[to], last[x])
            at += n
            span = high - low + 1
            near = (n_found >= 2) & (span <= WINDOW)
            partial = base + 2.0 * n_found / n_terms + 0.8 * n_titled / n_terms + np.where(near, (WINDOW - span) / float(WINDOW), 0.0)
            times = np.zeros(len(docs), np.int64)
            for p in phrases.asked[q]:
                times[held[phrase_at[p] : phrase_at[p + 1]]] += 1
            matched = np.flatnonzero(n_found[texts.doc] > 0)
            to = texts.doc[matched]
            score, complete = partial[to] + np.minimum(PHRASE_LIMIT, PHRASE_STEP * times[matched]), n_found[to] == n_terms
            least = np.partition(score, -k)[-k] - MARGIN if len(score) > k else -np.inf
            keep = score + np.where(complete, LEAD_LIMIT, 0.0) >= least
            out.append((np.full(int(keep.sum()), q), matched[keep], score[keep], complete[keep]))
        query, row, score, complete = (np.concatenate(x) for x in zip(*out, strict=True))
        columns = [asked["query_id"].take(query), asked["ask"].take(query), docs["doc_id"].take(row), docs["row"].take(row), pa.array(score), pa.array(complete)]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def binary_gain(average: float) -> Callable:
    """The BM25 gain that takes a term's frequency as one."""
    k1, b = fixed.BM25_K1, fixed.BM25_B

    def gain(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (k1 + 1) / (1 + k1 * (1 - b + b * np.maximum(length, 1) / max(average, 1.0)))

    return gain


def log_gain(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return 1 + np.log(tf)


def tfidf_idf(n: int) -> Callable:
    return lambda df: np.log(1 + (n - df + 0.5) / (df + 0.5))
