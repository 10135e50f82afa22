import math
import random
from collections import Counter, defaultdict

import pytest

from askweave.functions import fixed
from askweave.operators import retrieval

WORDS = [f"w{i}x" for i in range(30)] + ["xw1", "w2xy", "axw3x", "la"]


def rows_of(rng):
    docs = [(i % 110, " ".join(rng.choices(WORDS, k=rng.randint(0, 25)))) for i in range(120)] + [(500, None), (None, "w1x w2x"), (7, "w1x w2x")]
    docs += [(600 + i, "w1x w2x w3x la w4x. w5x") for i in range(3)]
    docs = [(i, t, " ".join(rng.choices(WORDS, k=2)) if n % 3 else None) for n, (i, t) in enumerate(docs)]
    asked = [(i % 9, " ".join(rng.choices([*WORDS, "unknown"], k=rng.randint(0, 9)))) for i in range(11)] + [(20, "w1x w2x w3x"), (21, None), (22, "w1x w2x w1x w2x w9x")]
    return docs, asked


def by_hand(docs, asked, k, method):
    """All pairs scored one by one; the words of the rows are their tokens, 'la' is no content word where it is a stop word."""
    split = lambda t: [w for w in (t or "").replace(".", " ").split() if w not in fixed.STOPWORDS]
    units, rows = defaultdict(Counter), [(i, split(t), list(dict.fromkeys(split(h))), t or "") for i, t, h in docs]
    first, titled = defaultdict(dict), defaultdict(set)
    for i, body, title, _ in rows:
        key = (i, len(body), len(title))
        units[key].update(body)
        titled[key].update(title)
        for at, w in enumerate(body):
            first[key][w] = min(at, first[key].get(w, at))
    seen = {(i, len(body), w) for i, body, _, _ in rows for w in body}
    df, lengths = Counter(w for _, _, w in seen), {(i, len(body)) for i, body, _, _ in rows}
    n, average = len(lengths), sum(x for _, x in lengths) / len(lengths)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    words = defaultdict(Counter)
    for q, t in asked:
        words[q].update(split(t))
    out = defaultdict(list)
    norm = defaultdict(float)
    for key, tf in units.items():
        norm[key[0]] += sum(((1 + math.log(c)) * idf[w]) ** 2 for w, c in tf.items())
    for q, t in asked:
        mine, tokens = words[q], split(t)
        qn = sum(((1 + math.log(c)) * idf.get(w, 0)) ** 2 for w, c in mine.items())
        for i, body, _, text in rows:
            own = [u for u in units if u[0] == i]
            matched = sum(w in units[u] for u in own for w in mine)
            if i is None or not matched:
                continue
            at = [first[u][w] for u in own for w in mine if w in units[u]]
            span = max(at) - min(at) + 1
            if method == "bm25":
                gain = {u: (fixed.BM25_K1 + 1) / (1 + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * max(u[1], 1) / max(average, 1.0))) for u in own}
                base = sum(c * idf[w] * gain[u] for u in own for w, c in mine.items() if w in units[u])
            else:
                base = sum((1 + math.log(c)) * idf[w] ** 2 * (1 + math.log(units[u][w])) for u in own for w, c in mine.items() if w in units[u]) / math.sqrt(qn * norm[i])
            near = (retrieval.boosted_cells.WINDOW - span) / 40 if matched >= 2 and span <= 40 else 0.0
            joined = " ".join(body)
            phrases = sum(" ".join(tokens[x : x + m]) in joined for m in (2, 3, 4) for x in range(len(tokens) - m + 1))
            score = base + 2 * matched / len(mine) + 0.8 * sum(w in titled[u] for u in own for w in mine) / len(mine) + near + min(1.5, 0.35 * phrases)
            asks, raw = list(dict.fromkeys(tokens)), text.split(".")[0].split()
            lead = split(" ".join(raw))
            if matched == len(mine) and len(asks) >= 2:
                place = lambda x: next((p for p in range(len(x) - len(asks) + 1) if x[p : p + len(asks)] == asks), -1)
                if place(lead) >= 0:
                    score += 1.0 if place(lead) <= 2 else 0.0
                    p = place(raw)
                    if p >= 0:
                        rest = raw[p + len(asks) :]
                        score += max(0.0, 0.8 - 0.08 * p) + (2.4 if "la" in rest and all(w in fixed.STOPWORDS for w in rest[: rest.index("la")]) and rest.index("la") > 0 else 0.0)
            out[q].append((-round(score, 6), i))
    return sorted((q, r + 1, round(-s, 5)) for q, x in out.items() for r, (s, _) in enumerate(sorted(x)[:k]))


@pytest.mark.parametrize("method", ["bm25", "tfidf"])
def test_cells_give_what_scoring_pair_by_pair_gives(spark, monkeypatch, method):
    docs, asked = rows_of(random.Random(11))
    tables = spark.createDataFrame(docs, "doc_id int, text string, title string"), spark.createDataFrame(asked, "query_id long, question string")
    want = by_hand(docs, asked, 6, method)
    assert len(want) > 50
    for block in (2048, 3):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        got = retrieval.lexical_retrieve(*tables, 6, method).collect()
        found = sorted((r["query_id"], r["rank"], round(r["score"], 5)) for r in got)
        assert [x[:2] for x in found] == [x[:2] for x in want]
        assert max(abs(a[2] - b[2]) for a, b in zip(found, want)) < 2e-5


@pytest.mark.parametrize("method", ["bm25", "tfidf"])
def test_pairs_of_question_and_document_are_no_rows(spark, monkeypatch, method):
    """Every document shares a word with every question, and no base score is beyond the reach of the boosts."""
    rng, stored, write = random.Random(3), {}, retrieval.materialize

    def counted(df, label):
        out = write(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(retrieval, "materialize", counted)
    docs = spark.createDataFrame([(i, "common " + " ".join(rng.choices(WORDS, k=8)), "t") for i in range(2000)], "doc_id int, text string, title string")
    asked = spark.createDataFrame([(i, "common " + " ".join(rng.choices(WORDS, k=3))) for i in range(20)], "query_id int, question string")
    assert retrieval.lexical_retrieve(docs, asked, 5, method).count() == 100
    assert max(stored.values()) < 20 * 2000 / 4, stored
