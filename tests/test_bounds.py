"""Bounds, guarded joins and rows that must not get lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from askweave import session
from askweave.operators import dense, feedback, followups, gold, metrics, quantiles, sampling, spans


def test_windows_keep_every_row_and_raise_without_room(spark):
    df = spark.createDataFrame([(1, 300, 200), (2, 10, 200), (3, 0, 5), (4, 500, 20)], "id long, n int, q int")
    df = df.withColumn("t", F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")))
    got = spans.windows(df.where("id <> 1"), "t", F.col("q"), 256, 80, ["id"]).collect()
    by = {i: sorted((r["window_start"], r["window_end"]) for r in got if r["id"] == i) for i in (2, 3, 4)}
    assert by[2] == [(0, 10)] and by[3] == [(0, 0)] and by[4][0] == (0, 232) and by[4][-1][1] == 500
    with pytest.raises(Exception, match="no progress"):
        spans.windows(df.where("id = 1"), "t", F.col("q"), 256, 80, ["id"]).collect()
    with pytest.raises(Exception, match="no room"):
        spans.windows(df.where("id = 1"), "t", F.col("q"), 200, 80, ["id"]).collect()


def test_fits_counts_rows_and_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100, ["a"] * 3) for i in range(50)], "i long, s string, a array<string>")
    assert session.fits(df) and not session.fits(df, max_rows=49) and not session.fits(df, max_bytes=5000)


def test_stored_tables_need_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Session())


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_dense_blocks_against_all_scores(spark, monkeypatch, metric):
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (700, 6)).astype(float)  # few values, so many ties
    frame = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vector array<double>")
    q, d = frame.where("id % 9 = 0").withColumnRenamed("id", "query_id"), frame.withColumnRenamed("id", "doc_id")
    for name, value in (("SCORE_ROWS", 7), ("SCORE_COLUMNS", 50), ("LEAST_CELL", 100)):
        monkeypatch.setattr(dense, name, value)
    row, ids, scores = dense._block_top_k(*[(lambda m: dense._unit(m) if metric == "cosine" else m)(x) for x in (v[::9], v)], np.arange(700), metric, 5)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in dense.dense_top_k(q, d, 5, metric).collect()}
    unit = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
    for i in range(0, 700, 9):
        s = np.round({"cosine": unit @ unit[i], "ip": v @ v[i], "l2": ((v - v[i]) ** 2).sum(1)}[metric], 6) + 0.0
        order = sorted(range(700), key=lambda j: (s[j] if metric == "l2" else -s[j], j))[:5]
        want = [(j, s[j]) for j in order if metric != "cosine" or s[j] > 0]
        assert [got[i, k + 1] for k in range(len(want))] == [(j, pytest.approx(x)) for j, x in want]
        mine = row == i // 9
        assert ids[mine].tolist() == order and np.allclose(scores[mine], s[order])


def test_guarded_joins_agree_on_both_branches(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(t.split()[3:15])) for i, t in rows[::4]] + [(99, "w5 w6")], "query_id long, context string")
    one = sorted(map(tuple, gold.gold_mapping(asked, docs).collect()))
    values = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    two = sorted(map(tuple, quantiles.quantiles(values, "x", [0.25, 0.9], by=["g"]).collect()))
    monkeypatch.setattr(gold, "SMALL_TEXT", -1)
    monkeypatch.setattr(gold, "maybe_broadcast", lambda df, *a: df)
    monkeypatch.setattr(quantiles, "broadcast_if_fits", lambda df, *a: df)
    assert sorted(map(tuple, gold.gold_mapping(asked, docs).collect())) == one and len(one) == 16
    assert sorted(map(tuple, quantiles.quantiles(values, "x", [0.25, 0.9], by=["g"]).collect())) == two


def test_equal_questions_pair_with_the_first(spark):
    rows = [(1, "Ai là tác giả bài thơ?"), (2, "ai LÀ tác giả  bài thơ?"), (3, "Ai là tác giả bài thơ?"), (4, "là"), (5, "là"), (6, ""), (7, "")]
    got = {(r["left"], r["right"], r["similarity"]) for r in followups.similar_questions(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.6).collect()}
    assert got == {(1, 2, 1.0), (1, 3, 1.0), (4, 5, 1.0)}


def test_rebalance_takes_the_first_keys(spark):
    df = spark.range(3000).select("id", (F.col("id") % 10 == 0).alias("flag"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    got = sampling.rebalance(df, "flag", "key").collect()
    rest = sorted(r["key"] for r in df.where("not flag").collect())
    assert sum(r["flag"] for r in got) == 300 and sorted(r["key"] for r in got if not r["flag"]) == rest[:600]
    assert sampling.rebalance(df, "flag", "key", ratio=20.0).count() == 3000


def test_run_comparison_needs_all_parts(spark):
    runs = spark.createDataFrame([("a", 1e-5, 3, 256, 80), ("b", 2e-5, 3, 256, 80)], "run string, learning_rate double, epochs int, max_length int, stride int")
    reports = spark.createDataFrame([("a", 50.0, 60.0, 55.0, 65.0, 40.0, 5.0)], "run string, overall_em double, overall_f1 double, answerable_em double, answerable_f1 double, unanswerable_accuracy double, answerable_predicted_empty_rate double")
    best = spark.createDataFrame([("a", 0.5), ("b", 0.4)], "run string, best_threshold double")
    assert [r["run"] for r in metrics.compare_runs(runs, reports, best).collect()] == ["a"]


def test_feedback_length_rules_and_repeated_rows(spark):
    schema = ("feedback_id long, question string, feedback_type string, corrected_answer string, selected_passage_id string, corrected_passage_id string, "
              "corrected_start_char int, corrected_end_char int, retrieved_passage_ids array<string>, note string")
    rows = [(1, "q", "CORRECT", None, None, None, None, None, ["p"], None), (2, "q", "CORRECT", None, "p" * 301, None, None, None, None, None),
            (3, "q", "CORRECT", None, None, None, None, None, None, "n" * 4001), (1, "q", "CORRECT", None, None, None, None, None, ["p"], None)]
    good, bad = feedback.validate(spark.createDataFrame(rows, schema), spark.createDataFrame([("p", "text")], "passage_id string, text string"))
    assert sorted(r["feedback_id"] for r in good.collect()) == [1, 1] and sorted(r["feedback_id"] for r in bad.collect()) == [2, 3]
