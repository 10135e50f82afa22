"""Vectors by content: what is encoded, when, and what survives replays, changes and lost batches."""

import pandas as pd
from pyspark.sql import functions as F

from askweave.operators import vector_store


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def _encoder(spark):
    """A pandas encoder and a counter of the texts it got."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.map(lambda t: [float(len(t)), float(t.count("a"))])

    return encode, calls


def _vectors(df, path, model="m"):
    return {r["id"]: r["vector"] for r in vector_store.with_vectors(df, "text", path, model).collect()}


def test_only_changed_texts_are_encoded(spark, tmp_path):
    encode, calls = _encoder(spark)
    path = str(tmp_path / "store")
    docs = _docs(spark, ["a", "bb", "a", "", None, "ccc"])
    assert vector_store.read_store(spark, path).count() == 0
    assert vector_store.sync(docs, "text", encode, path, "m") == 4 and calls.value == 4
    assert _vectors(docs, path) == {0: [1, 1], 1: [2, 0], 2: [1, 1], 3: [0, 0], 4: [0, 0], 5: [3, 0]}
    # The same number of rows, one of them changed: a store that compares counts would serve a stale vector.
    changed = _docs(spark, ["a", "bb", "a", "", None, "aaaa"])
    assert _vectors(changed, path)[5] is None
    assert vector_store.sync(changed, "text", encode, path, "m") == 1 and calls.value == 5
    assert _vectors(changed, path)[5] == [4, 4] and _vectors(docs, path)[5] == [3, 0]
    assert vector_store.sync(changed, "text", encode, path, "m") == 0 and calls.value == 5
    assert vector_store.sync(changed, "text", encode, path, "other") == 4 and calls.value == 9


def test_a_batch_without_its_mark_is_written_again(spark, tmp_path):
    encode, calls = _encoder(spark)
    path = tmp_path / "store"
    vector_store.sync(_docs(spark, ["a", "b"]), "text", encode, str(path), "m")
    vector_store.sync(_docs(spark, ["c"]), "text", encode, str(path), "m")
    (path / "generation=0" / "batch=1" / "_SUCCESS").rename(tmp_path / "mark")
    assert vector_store.read_store(spark, str(path)).count() == 2
    assert vector_store.sync(_docs(spark, ["a", "c", "d"]), "text", encode, str(path), "m") == 2
    assert vector_store.read_store(spark, str(path)).groupBy("key").count().where("count > 1").count() == 0
    assert vector_store.read_store(spark, str(path)).count() == 4


def test_compaction_keeps_the_live_texts(spark, tmp_path):
    encode, calls = _encoder(spark)
    path = tmp_path / "store"
    docs = _docs(spark, ["a", "b", "c", None])
    vector_store.sync(docs, "text", encode, str(path), "m")
    vector_store.sync(_docs(spark, ["d"]), "text", encode, str(path), "m")
    assert vector_store.compact(docs.where("id <> 1"), "text", str(path), "m") == 3
    assert _vectors(docs, str(path)) == {0: [1, 1], 1: None, 2: [1, 0], 3: [0, 0]}
    # A generation whose first part is not complete does not count.
    (path / "generation=2" / "batch=0").mkdir(parents=True)
    assert vector_store.read_store(spark, str(path)).count() == 3
    assert vector_store.sync(docs, "text", encode, str(path), "m") == 1 and _vectors(docs, str(path))[1] == [1, 0]
    assert vector_store.sync(_docs(spark, []), "text", encode, str(path), "m") == 0


def test_columns_of_the_rows_stay(spark, tmp_path):
    encode, _ = _encoder(spark)
    path = str(tmp_path / "store")
    df = _docs(spark, ["a"]).withColumn("key", F.lit(7))
    vector_store.sync(df, "text", encode, path, "m")
    row = vector_store.with_vectors(df, "text", path, "m", name="v").first()
    assert row["key"] == 7 and row["v"] == [1, 1] and set(row.asDict()) == {"id", "text", "key", "v"}
