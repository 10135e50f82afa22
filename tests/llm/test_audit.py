import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askweave.llm import audit_queries, divergence, resampling, vector_dedup

SF = "/root/testdata/sf0.001"


def twin(name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(audit_queries.SQL[name])
    return [c[0] for c in rel.description], rel.fetchall()


@pytest.mark.parametrize("name", sorted(audit_queries.SQL))
def test_queries_against_sql(spark, name):
    columns, rows = twin(name)
    got = audit_queries.QUERIES[name](spark, SF)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- divergence


def divergences_by_hand(docs, min_docs, top):
    groups, docs_of, counts = set(), defaultdict(set), Counter()
    for i, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)):
            docs_of[lang, w].add(i)
            counts[lang, source, w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), d in docs_of.items() if x == lang and len(d) >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        n = {s: sum(counts[lang, s, w] for w in kept) for s in sources}
        p = {(s, w): 1 + 10**9 * (counts[lang, s, w] + 5) // (n[s] + 5 * len(kept)) for s in sources for w in kept}
        q = {w: 1 + 10**9 * (sum(counts[lang, s, w] for s in sources) + 5) // (sum(n.values()) + 5 * len(kept)) for w in kept}
        for s in sources:
            pairs = [(sum(abs(p[s, w] - p[o, w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s, w] - q[w], w) for w in kept if counts[lang, s, w] and p[s, w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def test_divergences_odd_rows(spark):
    rows = [("Der die DAS Straße \x00 x1y", "de", f"s{i % 3}") for i in range(12)] + [("die die Öl", "de", None), (None, "de", "bare"), ("", None, None), ("one two", None, "z"), ("one", None, "z"), ("A" * 300_000 + " die", "de", "s0")]
    rows += [("té " * k, "fr", "abc"[k % 3]) for k in range(9)] + [("same", "fr", "a")] * 5
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("x"), "rank": F.lit(None).cast("int")})
    got = sorted(map(tuple, divergence.divergences(docs.repartition(7), min_docs=3, top_terms=2).collect()))
    assert got == divergences_by_hand(rows, 3, 2)
    assert divergence.divergences(docs.limit(0)).count() == 0


def test_divergences_small_holds(spark, monkeypatch):
    """Tasks that hand on early, and blocks of sources, change nothing."""
    rows = [(f"w{'abcdefghij'[i % 10]} w{'abcdefghij'[i % 7]} both", "en", f"s{i % 11}") for i in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "HELD_ROWS", 16)
    monkeypatch.setattr(divergence, "HELD_CELLS", 30)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 4)
    assert sorted(map(tuple, divergence.divergences(docs, 5, 3).collect())) == divergences_by_hand(rows, 5, 3)


def test_shares_stay_exact():
    count, total = np.array([9 * 10**12, 7, 9 * 10**14]), np.array([10**13 + 3, 35, 9 * 10**14 + 5])
    want = [1 + 10**9 * (int(c) + 5) // int(t) for c, t in zip(count, total)]
    assert divergence.shares(count, total).tolist() == want


# --- resampling


def resampled_by_hand(docs, target, percent=25):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    def bucket(x):
        return zlib.crc32(x.encode()) % 10000

    s = Counter(bucket(x) for _, t in docs for x in features(t))
    t = Counter(bucket(x) for t in target for x in features(t))
    size_s, size_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        f = [bucket(x) for x in features(text)]
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (size_s + 10000) / ((s[b] + 1) * (size_t + 10000)))) for b in f)
        weight = gain // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted(out, key=repr)


def test_resample_odd_rows(spark):
    words = "alpha beta GAMMA Öl straße x9 7 " + "q" * 90
    rows = [(i, " ".join(words.split()[(i * k) % 8] for k in range(i % 60))) for i in range(400)]
    rows += [(None, None), (None, "a " * 30), (500, ""), (501, "--- !!"), (502, "é " * 60000), (503, "a" * 400_000)] + [(504, "b " * 25)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "weight": F.lit("x"), "_tie": F.lit(0), "_text": F.lit(None).cast("string")})
    target = spark.createDataFrame([("alpha beta gamma",), (None,), ("b b b",)], "text string")
    got = [[*r] for r in resampling.resample(docs.repartition(5), target).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == resampled_by_hand(rows, ["alpha beta gamma", None, "b b b"])
    drawn = resampling.drawn_rows(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == sum(r[4] is not None for r in got)
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == len(rows)


def test_ranks_over_ties(spark):
    rows = [(i % 50 if i % 7 else None, i % 3, i) for i in range(5000)]
    got = resampling.ranked(spark.createDataFrame(rows, "doc_id long, score long, _tie long").repartition(6)).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    assert [(r["doc_id"], r["score"], r["_tie"]) for r in sorted(got, key=lambda r: r["_rank"])] == want
    assert sorted(r["_rank"] for r in got) == list(range(1, 5001))


def test_pair_crc():
    texts = ["a b", "Wort " + "x" * 60 + " é", "", "ab 9 ab 9 " * 50, "z"]
    row, bucket = resampling.batch_buckets(pa.array(texts))
    want = Counter()
    for i, t in enumerate(texts):
        w = lower(t).split()
        want.update((i, zlib.crc32(x.encode()) % 10000) for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    assert Counter(zip(row.tolist(), bucket.tolist())) == want


# --- vectors


def vectors_by_hand(rows, least=0.98):
    def unit(v):
        if v is None or not v or any(e is None or not math.isfinite(e) for e in v) or not any(v):
            return None
        x = np.array(v, float) / max(abs(e) for e in v)
        return x / np.sqrt(x @ x)

    units = [unit(v) if lab is not None else None for _, v, lab in rows]
    links = defaultdict(set)
    for i, x in enumerate(units):
        for j, y in enumerate(units[:i]):
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= least:
                links[i].add(j)
                links[j].add(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            todo, part = [i], {i}
            while todo:
                for j in links[todo.pop()] - part:
                    part.add(j)
                    todo.append(j)
            name = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(part, name)
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=repr)


def clusters(seed, centres=12, size=60, dims=8, spread=0.06):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(centres):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            out.append([len(out), (centre + rng.normal(size=dims) * spread * rng.random()).tolist(), c % 2])
    rng.shuffle(out)
    return [(int(i), v, lab) for i, v, lab in out]


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 40, "own_rows": 16, "met_rows": 24}, {"cell_rows": 25, "sample_bytes": 64 * 100}])
def test_vectors_by_hand(spark, sizes):
    rows = clusters(1)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)] + [(2000 + i, [3 * e for e in rows[5][1]], rows[5][2]) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_dedup.near_duplicates(frame.repartition(6), **sizes).collect()
    assert sorted(map(tuple, got), key=repr) == vectors_by_hand(rows)


def test_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [None, 1.0], 1)]
    rows += [(None, [1.0, 0.02], 1), (None, [0.0, 1.0], 2), (None, [0.0, 2.0], 2), (2, [1.0, 0.01], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1e300, 1e-300], 3), (12, [1e308, 0.0], 3), (13, [-1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"key": F.lit(1), "node": F.lit("x"), "n": F.lit(2), "unit": F.lit(3)})
    assert sorted(map(tuple, vector_dedup.near_duplicates(frame).collect()), key=repr) == vectors_by_hand(rows)
    assert vector_dedup.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("size", [400, 1600])
def test_one_large_group_is_counted_not_compared(spark, size):
    """Rows around a centre are linked by their distances to it: what is compared and returned grows with the group, not its square."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.05 * rng.normal(size=16)).tolist(), 0) for i in range(size)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    classes = frame.select(F.lit(1).cast("long").alias("tree"), F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("n"), vector_dedup.unit_vectors(F.col("embedding")).alias("unit"))
    found = vector_dedup.range_join(classes).collect()
    assert len(found) <= size * 1.05 and {r["to"] for r in found} == {0} and {r["links"] for r in found} == {size - 1}


def test_cuts_copy_few_rows():
    """Clustered vectors meet in their own cells."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = np.repeat(centres, 100, 0) + 0.05 * rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, leaves = vector_dedup.grow(x, len(x), 0.2, cell_rows=300)
    assert leaves >= 10
    assert sum(len(at) for _, at, _ in vector_dedup.route(tree, x, 0.2)) < 1.5 * len(x)
    assert sum(own.sum() for _, _, own in vector_dedup.route(tree, x, 0.2)) == len(x)
