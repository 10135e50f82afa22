import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from askweave.operators import dense, feedback, gold, metrics, quantiles, ranking, retrieval, sampling
from askweave.operators.text_index import load_index, postings, query_terms, save_index, tokenized


def test_combine_and_normalise(spark):
    row = spark.range(1).select(
        ranking.combine(F.lit(.95), F.lit(.10), F.lit(0.0), 0.0, .5, .3, .2).alias("a"), ranking.combine(F.lit(.75), F.lit(.80), F.lit(1.0), 0.0, .5, .3, .2).alias("b"),
        ranking.candidate_count(10).alias("n")).first()
    assert (round(row.a, 6), round(row.b, 6), row.n) == (0.505, 0.815, 20)
    with pytest.raises(ValueError):
        ranking.combine(F.lit(1.0), F.lit(1.0), F.lit(1.0), 0.0, .9, .3, .2, 0.0)
    hits = spark.createDataFrame([(1, 1, 5.0), (1, 2, 10.0), (1, 3, 15.0), (2, 1, 3.0)], "query_id int, doc_id int, score double")
    assert [r.score_norm for r in ranking.min_max(hits).orderBy("query_id", "doc_id").collect()] == [0.0, 0.5, 1.0, 1.0]


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (1, 13, 3)], "query_id int, doc_id int, rank int")
    left, right = (sorted((r.doc_id, r.score, r["rank"]) for r in ranking.rrf(x, y, 5).collect()) for x, y in ((a, b), (b, a)))
    assert left == right
    assert left[1][1] == round(1 / 62 + 1 / 61, 6)
    assert left[0][1] == round(1 / 61 + 1 / 64, 6)


def docs(spark):
    texts = ["red fish blue fish", "one fish", "green eggs ham", "blue sky over red hills", "red red red"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), texts


def test_bm25_against_formula_and_salted_join(spark, tmp_path, monkeypatch):
    d, texts = docs(spark)
    q = spark.createDataFrame([(7, "red red fish"), (8, "nothing")], "query_id int, question string")
    split = [t.split() for t in texts]
    avg = sum(map(len, split)) / 5

    def score(i):
        total = 0.0
        for term in "red red fish".split():
            if term in split[i]:
                n = sum(term in s for s in split)
                total += math.log(1 + (5 - n + .5) / (n + .5)) * 2.5 / (1 + 1.5 * (.25 + .75 * len(split[i]) / avg))
        return round(total, 6)

    want = sorted(((7, i, score(i)) for i in range(5) if score(i) > 0), key=lambda x: (-x[2], x[1]))
    rows = lambda df: [(r.query_id, r.doc_id, r.score) for r in df.orderBy("query_id", "rank").collect()]
    assert rows(retrieval.bm25(d, q, 10)) == want
    monkeypatch.setattr(retrieval, "fits", lambda *_: False)
    assert rows(retrieval.bm25(d, q, 10)) == want
    tok = tokenized(d)
    save_index(tok, str(tmp_path))
    post, stats = load_index(spark, str(tmp_path))
    assert rows(retrieval.bm25_over(tok, post, query_terms(q, "query_id", "question"), 10, stats=stats)) == want
    assert postings(tok).count() == post.count()
    with pytest.raises(ValueError):
        retrieval.validate_retriever("pyserini")


def test_dense_grid_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (40, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vector array<double>")
    want = []
    for i in range(40):
        s = np.round(v @ v[i], 6)
        order = sorted(range(40), key=lambda j: (-s[j], j))[:5]
        want += [(i, j, s[j]) for j in order]
    monkeypatch.setattr(dense, "CELL_BYTES", 8 * 4 * 7)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 9)
    got = dense.dense_top_k(df, df, 5, "ip", "id", "vector", "id", "vector").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == want


def test_gold_strategies_and_metrics(spark):
    d = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c d e y"), (3, "same text here"), (4, "same text here"), (5, "k l m n o p q r s t"), (6, "hi")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "same text here"), (2, "b c d"), (3, "k l m n o p q r s z"), (4, "oh hi you all"), (5, "zz"), (6, "c d")], "query_id int, context string")
    got = {r.query_id: (r.doc_id, r.strategy) for r in gold.gold_mapping(q, d).collect()}
    assert got == {1: (4, "exact"), 2: (1, "substring"), 3: (5, "jaccard"), 4: (6, "substring"), 6: (1, "substring")}
    hits = spark.createDataFrame([(1, 9, 1), (1, 4, 2), (2, 1, 1)], "query_id int, doc_id int, rank int")
    m = gold.retrieval_metrics(hits, gold.gold_mapping(q, d), [1, 3]).first()
    assert (m.evaluated, m.recall_1, m.recall_3, m.mrr) == (5, 0.2, 0.4, 0.3)


def test_f1_and_sweep(spark):
    rows = [(1, "a b b", "b b c", True, 2.0), (2, "", "", False, -1.0), (3, "x", "", True, 0.0), (4, "", "q", False, 1.0)]
    df = metrics.score_predictions(spark.createDataFrame(rows, "id int, gold_answer string, predicted_answer string, is_answerable boolean, score_margin double"))
    assert [round(r.f1, 6) for r in df.orderBy("id").collect()] == [0.666667, 1.0, 0.0, 0.0]
    sweep = {r.threshold: r for r in metrics.threshold_sweep(df, thresholds=[-5.0, 1.5, 9.0]).collect()}
    assert sweep[-5.0].unanswerable_accuracy == 50.0 and sweep[1.5].unanswerable_accuracy == 100.0
    assert sweep[1.5].answerable_f1 == round(200 / 3 / 2, 6) and sweep[9.0].answerable_f1 == 0.0


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles(spark, method):
    values = [((i * 37) % 101) / 7 for i in range(150)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {round(r.ratio, 2): r["quantile"] for r in quantiles.quantiles(df, "v", [.1, .5, .95], method=method, buckets=8).collect()}
    for p in (.1, .5, .95):
        want = float(np.quantile(values, p)) if method == "linear" else sorted(values)[round((len(values) - 1) * p)]
        assert abs(got[p] - want) < 1e-9


def feedback_frame(spark, rows):
    names = ("feedback_id, question, predicted_answer, feedback_type, selected_passage_id, corrected_passage_id, corrected_answer, corrected_start_char, corrected_end_char, "
             "retrieved_passage_ids, rejection_reason, corpus_support_found, status, synthetic, timestamp, semantic_relation").split(", ")
    kinds = "string string string string string string string int int array<string> string boolean string boolean string string".split()
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def row(i, kind="CORRECT", answer=None, start=None, end=None, status="PENDING", question="Q?"):
    return (f"f{i}", question, None, kind, "p", "p" if answer else None, answer, start, end, None, None, None, status, False, f"2024-01-0{i % 9 + 1}", "CAUSE")


def test_feedback(spark):
    df = feedback_frame(spark, [row(1), row(2, question=" q? "), row(3, "SPAN_CORRECTION", "ab", 0, 2), row(4, "SPAN_CORRECTION", "bc", 1, 3), row(5, "SPAN_CORRECTION", "bc", 1, 3, "APPROVED", "other")])
    store = feedback.deduplicate(df)
    assert {r.feedback_id: r.duplicate_count for r in store.collect()} == {"f1": 2, "f3": 1, "f4": 1, "f5": 1}
    assert {r.feedback_id for r in feedback.mark_conflicts(store).where("conflict").collect()} == {"f3", "f4"}
    passages = spark.createDataFrame([("p", "abc")], "passage_id string, text string")
    assert [r.feedback_id for r in feedback.export_corrections(store, passages).collect()] == ["f5"]
    good, bad = feedback.validate(feedback_frame(spark, [row(1, "SPAN_CORRECTION", "AB", 0, 2), row(2, "SPAN_CORRECTION", "zz", 0, 2), row(3, "BOGUS")]), passages)
    assert [(r.feedback_id, r.corrected_answer) for r in good.collect()] == [("f1", "ab")]
    assert {r.feedback_id: r.error for r in bad.collect()} == {"f2": "the answer is not the passage's text at the offsets", "f3": "unknown type of feedback"}


def test_blind_spot(spark):
    df = feedback_frame(spark, [row(i, question=str(i)) for i in range(6)] + [row(i, "INCORRECT", question=str(i)) for i in range(6, 10)]).withColumn("duplicate_count", F.lit(1))
    r = feedback.buckets(df, "semantic_relation").first()
    assert (r.total, r.correct, r.incorrect, r.failure_rate, r.blind_spot_score) == (10, 6, 4, 0.4, round(0.4 * math.log(11), 6))


def test_sampling(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("s")).withColumn("key", sampling.stable_key("x", F.col("id")))
    assert sampling.quota_sample(df, "s", {"0": 5, "1": 2}, "key").groupBy("s").count().count() == 2
    with pytest.raises(ValueError):
        sampling.quota_sample(df, "s", {"0": 500}, "key")
    turns = [r.turn for r in sampling.round_robin(df, ["s"], "key", 7).orderBy("position").collect()]
    assert turns == [1, 1, 1, 2, 2, 2, 3]


def test_document_norms_however_the_terms_are_split(spark, monkeypatch):
    d, texts = docs(spark)
    tok = tokenized(d)
    stats = retrieval.statistics(tok)
    df = {t: sum(t in s.split() for s in texts) for s in texts for t in s.split()}
    want = {i: round(sum(((1 + math.log(s.split().count(t))) * math.log(1 + (5 - df[t] + .5) / (df[t] + .5))) ** 2 for t in set(s.split())), 9) for i, s in enumerate(texts)}
    for split in (None, 0, 1, 2, 8):
        assert {r.doc_id: round(r.dn, 9) for r in retrieval.document_norms(postings(tok), stats, split).collect()} == want
    assert retrieval._split_frequency(stats.frequency) == 0
    for rows, split in ((12, 0), (4, 1), (1, 2), (0, 4)):
        monkeypatch.setattr(retrieval, "BROADCAST_ROWS", rows)
        assert retrieval._split_frequency(stats.frequency) == split
    # a shuffle of postings is planned only where rare terms need their own idf
    plan = lambda split: retrieval.document_norms(postings(tok), stats, split)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan(1)


def test_tasks_grow_in_number_and_other_terms_are_not_counted(spark, monkeypatch):
    from askweave.operators import text_index

    d, _ = docs(spark)
    few = tokenized(d).rdd.getNumPartitions()
    monkeypatch.setattr(text_index, "TASK_BYTES", 5)
    assert tokenized(d).rdd.getNumPartitions() == 15 > few
    assert tokenized(d.limit(0)).count() == 0
    wanted = spark.createDataFrame([("red",), ("none",)], "term string")
    assert {(r.doc_id, r.term, r.tf, r.first_pos) for r in postings(tokenized(d), wanted).collect()} == {(0, "red", 1, 0), (3, "red", 1, 3), (4, "red", 3, 0)}


def test_overlap_meets_the_plain_comparison_with_few_candidates(spark, monkeypatch):
    """Texts that share common words only are dropped before their words are compared; the result is that of all pairs."""
    import random

    from askweave.operators import gold

    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{int(200 * rng.random() ** 2)}" for _ in range(rng.choice([3, 10, 60]))]
        texts += [" ".join(words), " ".join([*words[1:], f"x{len(texts)}"]), " ".join(w for w in words if rng.random() < 0.93)]
    texts += ["", "  ", "w1"]
    sets = {i: {w for w in t.lower().split() if w} for i, t in enumerate(texts)}
    want = {}
    for i, a in sets.items():
        scored = [(-len(a & b) / len(a | b), j) for j, b in sets.items() if j != i and a and b]
        best = min(scored, default=(0, 0))
        if -best[0] >= 0.8:
            want[i] = (best[1], round(-best[0], 6))
    stored = {}
    plain = gold.materialize

    def kept(df, label):
        stored[label] = plain(df, label)
        return stored[label]

    monkeypatch.setattr(gold, "materialize", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = gold.best_overlap(docs.selectExpr("doc_id AS query_id", "text AS context"), docs, 0.8, others_only=True)
    assert {r["query_id"]: (r["doc_id"], r["overlap"]) for r in out.collect()} == want
    assert stored["overlap-alive"].count() < len(texts) * 4
