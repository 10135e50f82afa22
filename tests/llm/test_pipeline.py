from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline as P
from askweave.llm import sharding

SF = "/root/testdata/sf0.01"


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_stages_one_after_another(spark):
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = source, []
    for name, stage in P.STAGES[:4]:
        docs = P.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == source.columns
        seen.append(docs.collect())
    start = source.collect()
    clean, single, fresh, taken = seen
    assert {r["doc_id"] for r in single} <= {r["doc_id"] for r in clean} and {r["doc_id"] for r in fresh} <= {r["doc_id"] for r in single}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r["doc_id"] for r in start} - {r["doc_id"] for r in clean}
    assert len(gone & toxic) >= 0.6 * len(toxic) and len(gone) <= 1.6 * len(toxic) * len(start) / 399
    # near copies against exact similarity
    held = {r["doc_id"]: five(r["text"]) for r in clean}
    by = defaultdict(list)
    for d, s in held.items():
        for x in s:
            by[x].append(d)
    shared = Counter((a, b) for ds in by.values() for a in ds for b in ds if a < b)
    near = {(a, b) for (a, b), n in shared.items() if n >= 0.8 * len(held[a] | held[b])}
    stays = {r["doc_id"] for r in single}
    both = sum(a in stays and b in stays for a, b in near)
    assert len(near) > 20 and both <= 0.03 * len(near)
    loose = {x for (a, b), n in shared.items() if n >= 0.5 * len(held[a] | held[b]) for x in (a, b)}
    blank_or_short = {r["doc_id"] for r in clean if len(five(r["text"])) < 2}
    assert not {r["doc_id"] for r in clean} - stays - loose - blank_or_short
    items = [five(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in single:
        worst = max(len(i & held[r["doc_id"]]) / len(i) for i in items)
        if worst >= 0.9:
            assert r["doc_id"] not in {x["doc_id"] for x in fresh}
        if worst < 0.5:
            assert r["doc_id"] in {x["doc_id"] for x in fresh}
    assert set(Counter(r["doc_id"] for r in taken).values()) <= {1, 2}
    out = P.run(spark, SF)
    assert out.columns == [*source.columns, "shard", "slot"]
    shards = Counter(r["shard"] for r in out.collect())
    assert len(shards) == sharding.SHARDS and max(shards.values()) - min(shards.values()) <= 1 and sum(shards.values()) == len(taken)


def test_empty_and_odd_documents(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "word " * 50000, "en", "s", 1), (3, "a b c", "en", None, 5)], source.schema).selectExpr("*", "'x' AS shard", "1 AS _copies")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.run(spark, str(tmp_path)).collect()
    assert rows and all(r["shard"] is not None for r in rows)
    docs = odd.limit(0)
    for _, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, str(tmp_path)), "test")
    assert docs.count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
