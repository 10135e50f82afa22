import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from askweave.llm import layout_queries, mixing, sharding

SF = "/root/testdata/sf0.01"


def targets_by_hand(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (Fraction(3, 2) * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not more:
            break
        capped.update(more)
    return {s: float(2 * sizes[s] if s in capped else level * weight[s]) for s in names}


def test_mix_against_targets(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = layout_queries.op2_mix_sources(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    sizes = Counter()
    for d in docs.values():
        sizes[d["source"]] += len((d["text"] or "").encode().split())
    want, taken, longest = targets_by_hand(sizes), Counter(), Counter()
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == len((docs[r["doc_id"]]["text"] or "").encode().split()) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s], s
    assert sorted(map(tuple, got)) == sorted(map(tuple, layout_queries.op2_mix_sources(spark, SF).collect()))


def test_mix_odd_rows(spark):
    rows = [(i, "a b c", "s1", 1) for i in range(40)] + [(100, None, None, 1), (101, "", None, 2), (None, "x " * 500, None, 3), (102, "q w", "Z", 1), (102, "q w", "Z", 1), (103, "", "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").withColumn("row", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and {r["copies"] for r in got} <= {0, 1, 2}
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    want = targets_by_hand(sizes)
    assert {r["row"]["source"]: round(r["target"], 6) for r in got} == {s: round(t, 6) for s, t in want.items()}
    assert len({r["copies"] for r in got if r["row"]["doc_id"] == 102}) == 1
    taken = mixing.take(mixing.mix(docs))
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_longer_documents_are_likelier(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c d").otherwise(F.repeat(F.lit("w "), 200)).alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(docs, share=0.5).groupBy((F.col("row.doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("c")).collect()
    mean = {r["odd"]: r["c"] for r in rows}
    assert 0.1 < mean[0] < mean[1] < 0.7


@pytest.mark.parametrize("bucket_bytes", [sharding.BUCKET_BYTES, 200_000])
def test_shards(spark, bucket_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shuffled_shards(docs, bucket_bytes=bucket_bytes).select("doc_id", "text", "shard", "slot").collect()
    again = sharding.shuffled_shards(docs, bucket_bytes=bucket_bytes).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(got) == sorted(again) and len(got) == docs.count()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a < b for a, b in zip(order, order[1:])) in range(400, 600)


def test_shard_query_and_odd_rows(spark, tmp_path):
    want = {r["doc_id"]: (len(r["text"].encode()) + 16, zlib.crc32(r["text"].encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in layout_queries.op8_shuffle_shards(spark, SF).collect()} == want
    rows = [(None, None, "x"), (1, "", None), (1, "", None), (2, "y " * 100000, "x")] + [(7, "same", "k")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("_at", F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit(1))))
    got = sharding.shuffled_shards(docs, shards=4, bucket_bytes=1000)
    assert got.columns == ["doc_id", "text", "_at", "shard", "slot"]
    assert Counter(r["shard"] for r in got.collect()) == Counter({0: 24, 1: 23, 2: 24, 3: 23})
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((a, b) for a, b, _ in rows)
    assert sharding.shuffled_shards(docs.limit(0)).count() == 0
    sharding.write_shards(got, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
