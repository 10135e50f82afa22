import pytest
from pyspark.sql import functions as F

from askweave.functions import answers as A
from askweave.functions import questions as Q
from askweave.operators import extraction, followups
from askweave.plans import answering

CASES = [
    ("Vì sao hệ thống Z phát triển vượt bậc?", "CAUSE", "hệ thống Z", "phát triển vượt bậc"),
    ("Vì đâu doanh nghiệp Z suy giảm?", "CAUSE", "doanh nghiệp Z", "suy giảm"),
    ("Điều gì dẫn tới việc tổ chức Z sụp đổ?", "CAUSE", "tổ chức Z", "sụp đổ"),
    ("Nguyễn Văn An chào đời vào năm nào?", "BIRTH_TIME", "Nguyễn Văn An", "chào đời"),
    ("Năm sinh của Nguyễn Văn An là bao nhiêu?", "BIRTH_TIME", "Nguyễn Văn An", "sinh"),
    ("Hội nghị Z được tổ chức tại địa điểm nào?", "EVENT_LOCATION", "Hội nghị Z", "được tổ chức tại"),
    ("Đoàn nghiên cứu Z được thành lập nhằm mục tiêu gì?", "PURPOSE", "Đoàn nghiên cứu Z", "được thành lập"),
    ("Tên gọi khác của tổ chức Z là gì?", "IDENTITY", "Tên gọi khác của tổ chức Z", "là gì"),
    ("Hồ Chí Minh là ai?", "DEFINITION", "Hồ Chí Minh", "là"),
]


def test_question_semantics(spark):
    df = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(CASES)], "id int, question string")
    rows = Q.annotate_questions(df).orderBy("id").collect()
    assert [(r.question, r.relation, r.subject, r.predicate) for r in rows] == CASES


PHRASES = [
    ("Vì sao Paris phát triển mạnh?", "Do khí hậu ôn hòa khiến Paris phát triển mạnh.", "khí hậu ôn hòa", "cause_clause_pattern"),
    ("Nguyễn Văn An sinh vào năm nào?", "Nguyễn Văn An sinh năm 1990 tại Hà Nội.", "năm 1990", "temporal_expression_pattern"),
    ("Chùa Một Cột nằm ở đâu?", "Chùa Một Cột nằm ở thành phố Hà Nội từ năm 1049.", "thành phố Hà Nội", "location_relation_pattern"),
    ("Hồ Chí Minh là ai?", "Hồ Chí Minh (1890) là nhà cách mạng Việt Nam.", "nhà cách mạng Việt Nam", "person_definition_pattern"),
    ("Đoàn được thành lập để làm gì?", "Đoàn được thành lập để nghiên cứu biển, theo báo cáo.", "nghiên cứu biển", "purpose_clause_pattern"),
    ("Sự khác biệt giữa A và B là gì?", "Sự khác biệt giữa A và B là màu sắc.", "Sự khác biệt giữa A và B là màu sắc", "contrast_relation_pattern"),
]


def test_phrases_and_answers(spark):
    q = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHRASES)], "question_id int, question string")
    passages = spark.createDataFrame([(f"P{i}", p[1]) for i, p in enumerate(PHRASES)], "passage_id string, context string")
    hits = spark.createDataFrame([(i, f"P{i}", 1.0) for i in range(len(PHRASES))], "question_id int, passage_id string, retrieval_score double")
    rows = answering.answer(q, hits, passages).orderBy("question_id").collect()
    assert [(r.answer, r.fallback_method) for r in rows] == [p[2:] for p in PHRASES]
    for r, p in zip(rows, PHRASES):
        assert p[1][r.start_char:r.end_char] == r.answer and r.has_answer


def test_completeness_and_types(spark):
    rows = spark.createDataFrame([("đẹp và",), ("(mở",), ("",), ("xong",)], "a string").select(A.completeness(F.col("a")).alias("s")).collect()
    assert [r.s for r in rows] == [0.10, 0.15, 0.0, 1.0]
    df = spark.createDataFrame([("năm 1990", ["TIME"]), ("Hà Nội", ["LOCATION"]), ("xanh", ["TIME"]), ("năm 1990", ["TIME", "NUMBER"])], "a string, types array<string>")
    got = [(r.answer_type_score, r.answer_type_reason) for r in A.add_answer_type(df, "a", "types").collect()]
    assert got == [(1.0, "TEMPORAL_EXPRESSION"), (0.78, "NAMED_LOCATION_CANDIDATE"), (0.0, "NO_TEMPORAL_EXPRESSION"), (1.0, "TEMPORAL_EXPRESSION+MULTI_TYPE_BONUS(2/2)")]


def test_refinement(spark):
    context = "Người đứng đầu là Thiếu tướng Nguyễn Văn An, được bổ nhiệm sớm."
    start = context.index("Nguyễn")
    df = spark.createDataFrame([(context, start, start + len("Nguyễn Văn"), ["PERSON"], "FACTOID")], "context string, start_char int, end_char int, types array<string>, coarse_relation string")
    r = A.refine_spans(df).first()
    assert r.refined_text == "Thiếu tướng Nguyễn Văn An"
    assert r.refinement == "noun_phrase_expand_left+phrase_expand_right"


def test_similarity_and_follow_ups(spark):
    pairs = spark.createDataFrame([("A là gì?", "a là gì"), ("", "x")], "l string, r string")
    assert [r.s for r in pairs.select(followups.question_similarity(F.col("l"), F.col("r")).alias("s")).collect()] == [1.0, 0.0]
    rows = spark.createDataFrame(
        [(1, "An Nam sinh năm nào?", "1901", "Trần An Nam", "BIRTH_TIME", None, "sinh", "P1", "Trần An Nam sinh năm 1901 tại Huế. Trần An Nam qua đời năm 1960.", 1.0, True, 1)],
        "question_id int, question string, answer string, subject string, relation string, target string, predicate string, passage_id string, context string, relevance double, is_selected boolean, position int")
    out = {r.followup: r.text for r in followups.follow_ups(rows).collect()}
    assert out["DEATH_TIME"] == "Trần An Nam qua đời vào thời gian nào?"
    assert out["BIRTH_LOCATION"] == "Trần An Nam sinh ở đâu?"


def greedy(items):
    left, groups, order = list(items), set(), []
    while left:
        best = max(left, key=lambda x: (round(x[2] + (0.1 if x[1] not in groups else 0.0), 6), x[3], x[4], -x[0]))
        order.append(best[0])
        groups.add(best[1])
        left.remove(best)
    return order[:3]


@pytest.mark.parametrize("seed", range(3))
def test_diversity_order_equals_greedy(spark, seed):
    rows = [(i, f"g{(i * 7 + seed) % 3}", ((i * 37 + seed * 11) % 50) / 50, ((i * 13 + seed) % 9) / 9) for i in range(12)]
    df = spark.createDataFrame([(1, i, g, a, 0.0, n) for i, g, a, n in rows], "question_id int, ordinal int, group string, answerability double, relevance double, novelty double")
    got = [r.ordinal for r in followups.rank(df).orderBy("rank").collect()]
    assert got == greedy([(i, g, round(0.45 * a + 0.2 * n, 6), a, n) for i, g, a, n in rows])
