import time

import pytest
from pyspark.sql import functions as F

from askweave.functions import subjects
from askweave.operators import followups, text_index
from askweave.operators.validation import add_subject_consistency

CONTEXT = ("question_id int, question string, answer string, subject string, relation string, target string, predicate string, passage_id string, "
           "context string, relevance double, is_selected boolean, position int")


@pytest.mark.parametrize("text,want", [
    ("  Trần Hưng Đạo là ai? ", "Trần Hưng Đạo"), ("vai trò của  rừng ngập mặn", "rừng ngập mặn"), ("Vai trò của", "Vai trò của"), ("điều này", None), ("là gì?", None), ("", None),
    (None, None), ("x" * 130, None), ("Thành phố Huế nằm như thế nào trong nước", "Thành phố Huế nằm"), ("ai", None), ('"Chùa Một Cột"?!', "Chùa Một Cột")])
def test_subject_focus(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(subjects.focus_subject(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("question,want", [
    ("Trần Hưng Đạo là ai?", "tran hung dao"), ("Nguyễn Trãi sinh năm nào?", "nguyen trai"), ("Chiến tranh nổ ra khi nào", "chien tranh"), ("Vì sao lũ lụt gia tăng?", "lu lut"),
    ("Mục đích của hội nghị là gì?", "muc dich cua hoi nghi"), ("Bao nhiêu người?", None), (None, None)])
def test_subject_inference(spark, question, want):
    row = spark.createDataFrame([(question,)], "q string").select(subjects.infer_subject(F.col("q")), subjects.subject_of(F.lit(None).cast("string"), F.col("q"))).first()
    assert row[0] == want and row[1] == want


def contexts(spark, rows):
    return spark.createDataFrame(rows, CONTEXT)


def index(spark, folder, passages):
    frame = spark.createDataFrame(passages, "passage_id string, context string")
    text_index.save_index(text_index.tokenized(frame, "passage_id", "context"), folder)
    return frame, *text_index.load_index(spark, folder)


def test_probe_confirms_replaces_and_refuses(spark, tmp_path):
    """A weak candidate passes by its own passage or by another that supports it; without either it is refused."""
    own = "Trần An Nam qua đời năm 1960 tại Huế."
    rows = [(1, "Trần An Nam là ai?", "nhà thơ", "Trần An Nam", "IDENTITY", None, None, "P1", own, 0.0, False, 9),
            (2, "Lê Văn Tám là ai?", "nhà báo", "Lê Văn Tám", "IDENTITY", None, None, "P9", "Lê Văn Tám qua đời năm 1950.", 0.0, False, 9)]
    gated = followups.gate(followups.discover(contexts(spark, rows)))
    # make every candidate weak, whatever its score
    gated = gated.withColumns({"topic": F.lit(0.2), "rejection": F.lit("TOPIC_DRIFT")})
    others = [(f"N{i}", f"chuyện khác số {i} về biển và núi") for i in range(8)]
    frame, post, stats = index(spark, f"{tmp_path}/a", [("P1", own), *others])
    got = {(r["question_id"], r["followup"]): r for r in followups.probe(gated, frame, post, stats).collect()}
    mine = got[1, "DEATH_TIME"]
    assert (mine["rejection"], mine["tier"], mine["passage_id"], mine["topic"]) == (None, "TIER_2_BM25", "P1", 0.5) and mine["relevance"] > 0
    assert got[2, "DEATH_TIME"]["rejection"] == "BM25_PROBE_FAILED" and got[2, "DEATH_TIME"]["tier"] is None
    # another passage that tells the same about the subject takes the candidate's place
    frame, post, stats = index(spark, f"{tmp_path}/b", [("P7", "Lê Văn Tám qua đời vào ngày 3 tháng 2 năm 1951 tại Hà Nội."), *others])
    got = {(r["question_id"], r["followup"]): r for r in followups.probe(gated, frame, post, stats).collect()}
    new = got[2, "DEATH_TIME"]
    assert (new["rejection"], new["passage_id"], new["relevance"]) == (None, "P7", 1.0) and new["sentence"].startswith("Lê Văn Tám qua đời vào ngày")
    assert got[1, "DEATH_TIME"]["rejection"] == "BM25_PROBE_FAILED"


def test_probe_stops_after_three(spark, tmp_path):
    text = "Trần An Nam sinh năm 1901 tại Huế. Trần An Nam qua đời năm 1960 tại Hà Nội."
    rows = [(1, "Trần An Nam là ai?", "nhà thơ", "Trần An Nam", "IDENTITY", None, None, "P1", text, 0.0, False, 9)]
    gated = followups.gate(followups.discover(contexts(spark, rows))).withColumns({"topic": F.lit(0.2), "rejection": F.lit("ANSWERABILITY_LOW")})
    frame, post, stats = index(spark, str(tmp_path), [("P1", text), ("P2", "biển và núi")])
    got = sorted((r["ordinal"], r["rejection"]) for r in followups.probe(gated, frame, post, stats).collect())
    assert len(got) >= 4 and [x for _, x in got] == [None] * 3 + ["ANSWERABILITY_LOW"] * (len(got) - 3)


def test_echoes_of_accepted_questions_are_duplicates(spark):
    rows = [(1, "ROLE", 1, "An giữ vai trò gì trong phong trào này?", None), (1, "ROLE", 2, "An giữ vai trò gì trong phong trào nay?", None),
            (1, "ROLE", 3, "An giữ vai trò gì trong phong trào nầy?", "TOPIC_DRIFT"), (1, "TIME", 4, "An giữ vai trò gì trong phong trào này?", None),
            (2, "ROLE", 1, "An giữ vai trò gì trong phong trào này?", "TOPIC_DRIFT"), (2, "ROLE", 2, "An giữ vai trò gì trong phong trào nay?", None)]
    got = {(r["question_id"], r["ordinal"]): r["rejection"] for r in followups._without_echoes(spark.createDataFrame(rows, "question_id int, _rel string, ordinal int, text string, rejection string")).collect()}
    assert got == {(1, 1): None, (1, 2): "DUPLICATE_QUESTION", (1, 3): "DUPLICATE_QUESTION", (1, 4): None, (2, 1): "TOPIC_DRIFT", (2, 2): None}


def test_similar_questions_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = [f"tu{i}" for i in range(14)]
    texts = sorted({" ".join(rng.sample(words, rng.randrange(1, 9))) for _ in range(160)})
    sets = [set(t.split()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for threshold in (0.5, 0.6, 0.75, 1.0):
        want = {(i, j): round(len(a & b) / len(a | b), 6) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= threshold * len(a | b)}
        assert {(r.left, r.right): r.similarity for r in followups.similar_questions(df, "id", "text", threshold).collect()} == want
    # a pair whose first common word comes too late is not proposed
    far = spark.createDataFrame([(1, list("abcde"), 5), (2, list("xycde"), 5)], "id long, words array<string>, n int")
    assert [(r.left, r.right) for r in followups._proposed(far, "id", 0.6).collect()] == []
    assert {(r.left, r.right) for r in followups._proposed(far, "id", 0.4).collect()} == {(1, 2)}


def test_previous_sentence_in_linear_time(spark):
    """A run of 300 000 characters without a stop is read once, not once from each of its characters."""
    long = "a b c d e f " * 25_000
    rows = spark.createDataFrame([("Quang Trung", "Ông lập kinh đô.", f"{long}. Quang Trung ra Bắc… Ông lập kinh đô. Hết."), ("Lê Lợi", "Ông lập kinh đô.", "Lê Lợi lên ngôi\r\n Ông lập kinh đô.")], "subject string, sentence string, context string")
    began = time.perf_counter()
    out = add_subject_consistency(rows).select("subject_status", "subject_reason").collect()
    assert time.perf_counter() - began < 30
    assert [tuple(r) for r in out] == [("VALID", "PREVIOUS_SENTENCE_COREFERENCE")] * 2


def test_heads_of_sentences_are_those_of_the_plain_pattern(spark):
    texts = ["", "abc", "ab. cd", "ab.", "ab\ncd", "ab\n", "ab.\n", "ab\r\n", "a!b?c", "\n", "x ", "a.b\r", "é!ü\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for stops in (r".!?", r".!?\n"):
        plain, quick = (F.regexp_extract("t", rf"(?s){ahead}([^{stops}]*)$", 1) for ahead in ("", f"(?<![^{stops}])"))
        assert df.where(plain != quick).count() == 0


def test_sentences_do_not_carry_their_passage(spark):
    """A passage of many sentences is split over tasks by question, and its text is not repeated in every sentence."""
    body = "Nhà thơ Nguyễn Du sinh năm 1766 tại Thăng Long. Ông viết truyện."
    rows = [(i, "Nguyễn Du là ai?", "", "Nguyễn Du", None, None, None, f"p{i}", body, 1.0, True, 1) for i in range(20)]
    contexts = spark.createDataFrame(rows, "question_id long, question string, answer string, subject string, relation string, target string, predicate string, passage_id string, context string, relevance double, is_selected boolean, position int").coalesce(1)
    stored = {}
    plain = followups.materialize

    def kept(df, label):
        stored[label] = df
        return plain(df, label)

    followups.materialize = kept
    try:
        found = followups.discover(contexts)
    finally:
        followups.materialize = plain
    assert "context" not in stored["followup-sentences"].columns
    assert stored["followup-contexts"].rdd.getNumPartitions() > 1
    assert {"BIRTH_TIME", "BIRTH_LOCATION"} <= {r["followup"] for r in found.where("question_id = 3").collect()}
