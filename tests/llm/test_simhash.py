import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from askweave.llm import simhash_dedup as S
from askweave.llm.graph import components


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {x: find(x) for x in root}


def test_links_match_all_pairs_also_in_split_meetings(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for s in seeds for _ in range(12)}
    prints = sorted(np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist())
    want = plain_components([p & (2**64 - 1) for p in prints])
    nodes = spark.createDataFrame([(p, p) for p in prints], "node long, fp long")
    for extra in ({}, {"cell_rows": 6, "probe": 1}, {"blocks": 8}):
        got = {r["node"]: r["root"] for r in components(S.links(nodes, len(prints), **extra), "test").collect()}
        assert [got.get(p, p) for p in prints] == [min(q for q, w in zip(prints, want) if w == k) for k in want], extra


def test_documents_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_print(r["text"]) for r in rows]
    roots = plain_components(prints)
    least = {k: min(r["doc_id"] for r, w in zip(rows, roots) if w == k) for k in roots}
    want = {r["doc_id"]: (f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, roots)}
    got = S.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
    assert len(got) == len(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (None, "One two", None), (4, "one\ttwo", None), (4, "one\ttwo", None), (5, long, "y"), (6, long + " end", "y"), (None, "zeta eta", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs).collect()), key=str)
    zero = "0" * 16
    assert [(d, c) for d, f, c in got if f == zero] == [(1, 1), (2, 1), (3, 1)]
    assert sum(c == 4 for _, _, c in got) == 3
    assert [c for d, _, c in got if d in (5, 6)] == [5, 5]
    assert [c for d, f, c in got if d is None] in ([4, None], [None, 4])
    assert S.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [("Ab Cd", "ab cd"), ("É É", "É É")])
def test_lower_case_is_ascii_only(text, want):
    assert S.fingerprint(text) & (2**64 - 1) == xxhash.xxh64_intdigest(want.encode(), 42)
