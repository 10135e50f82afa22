import random

import pytest
from pyspark.sql import functions as F

from askweave.llm import near_copies as S


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_one_of_each_against_exact_similarity(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([60, 200, 400]))]
        for _ in range(rng.choice([1, 1, 3, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 80) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in S.one_of_each(docs).collect()} == roots_of(texts)


def test_one_of_each_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40000))
    rows = [(2, None), (1, ""), (3, "a b"), (3, "a b"), (None, "q r s"), (None, "q r s"), (None, long), (4, long + " x"), (5, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("node", "doc_key", "row", "stays", "least", "_stays")})
    got = S.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:3]) for r in got.collect()) == [("1", ""), ("3", "a b"), ("4", "w0 "), ("5", "oth"), ("None", "q r")]
    assert S.one_of_each(docs.limit(0)).count() == 0


def roots_of(texts, least=0.8):
    sets = [five(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def test_texts_of_one_repeated_shingle_and_near_misses_stay(spark):
    filler = "ha " * 120
    texts = [filler + " ".join(f"{k}x{i}" for i in range(60)) for k in "ab"]
    rng = random.Random(5)
    for g in range(40):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(3):  # pairs of 0.74, some of which a sketch takes for 0.8
            copy = list(base)
            for at in range(5, 300, 33):
                copy[at] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    kept = {r["doc_id"] for r in S.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == roots_of(texts) and len(kept) == len(texts)


def edited(base, rng, block):
    """A copy with a similarity just above 0.8, by words all over the text or by one block."""
    copy, n = list(base), len(base)
    if block:
        size = int(n * rng.uniform(0.06, 0.10))
        at = rng.randrange(n - size)
        copy[at : at + size] = [f"e{rng.randrange(10**9)}" for _ in range(size)]
    else:
        for _ in range(int(n * rng.uniform(0.012, 0.022))):
            copy[rng.randrange(n)] = f"e{rng.randrange(10**9)}"
    return copy


@pytest.mark.parametrize("block", [False, True])
def test_recall_of_scattered_and_block_edits(spark, block):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(150):
        base = [rng.choice(words) for _ in range(rng.randrange(150, 400))]
        texts += [" ".join(base), " ".join(edited(base, rng, block))]
    want = roots_of(texts)
    assert len(want) < len(texts) - 100
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in S.one_of_each(frame).collect()} == want
    groups = S._groups(frame.select("doc_id", F.xxhash64("doc_id").alias("doc_key"), S.sketches("text").alias("x")).select("doc_id", "doc_key", "x.*"))
    assert S.near_links(groups, frame.select(F.xxhash64("doc_id").alias("doc_key"), "text"), cell_rows=1).count() >= len(texts) - len(want)


def threshold_group(size, seed):
    """Texts of one group with similarities around 0.8, so that about half of their pairs fail."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    out = []
    for _ in range(size):
        copy = list(base)
        for at in rng.sample(range(0, 200, 5), 5):
            copy[at] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("cell_rows", [S.CELL_ROWS, 40])
def test_large_group_around_the_threshold(spark, cell_rows, monkeypatch):
    texts = threshold_group(150, 4) + [" ".join(f"x{k}y{i}" for i in range(100)) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(S.near_links, "__defaults__", (S.SIMILARITY, cell_rows))
    assert {r["doc_id"] for r in S.one_of_each(docs).collect()} == roots_of(texts)


def test_stored_rows_grow_with_the_group(spark, monkeypatch):
    """No table holds the pairs of a group: twice the texts, about twice the rows."""
    stored = {}
    keep = S.materialize

    def counted(df, label):
        out = keep(df, label)
        stored[label] = max(stored.get(label, 0), out.count())
        return out

    monkeypatch.setattr(S, "materialize", counted)
    seen = []
    for size in (250, 500, 1000):
        stored.clear()
        S.one_of_each(spark.createDataFrame(list(enumerate(threshold_group(size, 8))), "doc_id long, text string")).count()
        seen.append(dict(stored))
    for label in seen[0]:
        for small, large in zip(seen, seen[1:]):
            assert large[label] <= 2.6 * small[label] + 200, (label, seen)


def test_rows_outside_the_largest_group_meet_all_blocks(spark):
    """A band of many blocks, one group that holds most rows: a few others are found against every block."""
    import numpy as np
    rng = np.random.default_rng(1)
    root = np.where(rng.random(300) < 0.9, 7, np.arange(300))
    rows = [(int(i), int(r), 300, 1, 4, 2, 7) for i, r in enumerate(root)]
    frame = spark.createDataFrame(rows, "node long, root long, n long, key long, blocks int, minor_blocks int, major long")
    met = {}
    for r in frame.select("node", F.explode(S._meeting_cells()).alias("cell")).collect():
        met.setdefault(r["cell"], set()).add(r["node"])
    minor = [i for i in range(300) if root[i] != 7]
    assert all(any({i, j} <= cell for cell in met.values()) for i in minor for j in range(300))
    assert sum(map(len, met.values())) <= 300 * 2 + len(minor) * 4


def test_simhash_proposes_and_shingles_verify(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    edited = [*base[:200], "other", *base[201:]]
    filler = "ha " * 300
    texts = [" ".join(base), " ".join(edited), filler + " ".join(base[:20]), filler + " ".join(base[40:60]), "a b c", " ".join(base) + " " + " ".join(base)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = []
    links = S.links
    monkeypatch.setattr(S, "links", lambda nodes, rows: asked.append(rows) or links(nodes, rows))
    # without any band of minima the links of SimHash alone are left
    monkeypatch.setattr(S, "near_links", lambda nodes, docs, similarity, known: known)
    stay = {r["doc_id"] for r in S.one_of_each(docs).collect()}
    assert asked and {0, 2, 3, 4} <= stay and 1 not in stay
