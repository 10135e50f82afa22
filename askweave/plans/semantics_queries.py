"""Registered queries: question rules, answer assessment, gates, spans, extraction, answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from askweave.functions import answers as A
from askweave.functions import fixed
from askweave.functions import questions as Q
from askweave.functions import text as T
from askweave.operators import alignment, block_search, chunking, extraction, gates, ranking, spans, text_index
from askweave.plans import answering
from askweave.plans.evaluation_queries import candidates, predictions
from askweave.session import materialize
from askweave.sources.tables import table

# Question frames around words of the given turns, one per rule family.
FRAMES = [
    ("Vì sao ", " phát triển mạnh?"), ("", " sinh vào năm nào?"), ("", " nằm ở đâu?"), ("", " là ai?"), ("", " là gì?"),
    ("", " được xây dựng để làm gì?"), ("So với ", " thì có gì khác nhau?"), ("Đặc điểm của ", " ra sao?"),
    ("", " có bao nhiêu người?"), ("Điều gì dẫn tới việc ", " suy giảm?"), ("Tên gọi khác của ", " là gì?"),
    ("", " diễn ra ở đâu?"), ("", " qua đời năm nào?"), ("", " bằng cách nào?"), ("Nguyên nhân nào khiến ", " nổi tiếng?"), ("", ""),
]
RELATIONS = [p[0] for p in fixed.RELATION_POLICIES]


def framed(spark, d):
    """Questions made of a frame around each whole user turn."""
    users = table(spark, d, "conversations").where("role = 'user'")
    words = T.squeeze(F.col("text"))
    pick = ((F.col("conv_id") + F.col("turn")) % len(FRAMES) + 1).cast("int")
    head, tail = (F.element_at(F.array(*[F.lit(f[i]) for f in FRAMES]), pick) for i in (0, 1))
    return users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(head, words, tail).alias("question"))


def question_types(spark, d):
    q = framed(spark, d).withColumn("fw", T.fold_words(F.col("question")))
    q = q.withColumn("types", Q.question_types(F.col("fw")))
    return q.select("id", F.array_join("types", ",").alias("types"), Q.coarse_relation(F.col("fw"), F.col("types")).alias("coarse_relation"),
                    Q.weak_bucket(F.col("fw")).alias("weak_bucket"))


def question_semantics(spark, d):
    q = Q.annotate_questions(framed(spark, d))
    return q.select("id", F.array_join("types", ",").alias("types"), "relation", "subject", "predicate", "target", "modifier",
                    F.array_join("matched_rules", ",").alias("matched_rules"))


def relation_rules(spark, d):
    """Relation and matched rules of every question."""
    q = Q.annotate_questions(framed(spark, d))
    return q.select("id", "relation", Q.relation_bucket(F.col("relation"), F.col("types")).alias("bucket"))


def parser_coverage(spark, d):
    """Share of questions whose relation, subject and predicate were parsed, per expected bucket."""
    q = Q.annotate_questions(framed(spark, d)).withColumn("_fw", T.fold_words(F.col("question"), percent=False))
    q = q.withColumns({"expected": Q.weak_bucket(F.col("_fw")), "bucket": Q.relation_bucket(F.col("relation"), F.col("types")),
                       "_s": T.fold_words(F.coalesce("subject", F.lit("")), percent=False)})
    leak = r"\b(?:vi sao|tai sao|nguyen nhan|ly do|dieu gi|yeu to nao|o dau|tai dau|noi nao|dia diem nao|nam nao|bao nhieu|muc dich gi|la gi|la ai|ai|nao)\b"
    needs = F.col("expected").isin(fixed.HOLDOUT_STRICT_BUCKETS)
    predicate = ~needs | F.col("predicate").isNotNull()
    subject = (F.col("_s") != "") & (F.col("_s") != F.col("_fw")) & ~Q.has(F.col("_s"), leak) & predicate
    relation = F.col("bucket") == F.col("expected")

    def rate(c):
        return F.round(100.0 * F.avg(c.cast("int")), 3)

    return q.groupBy("expected").agg(
        F.count(F.lit(1)).alias("total"), rate(relation).alias("relation_rate"), rate(subject).alias("subject_rate"),
        rate(predicate).alias("predicate_rate"), rate(relation & subject & predicate).alias("full_rate"),
        rate((F.col("expected") != "GENERAL") & (F.col("bucket") == "GENERAL")).alias("unknown_rate"))


def rule_coverage(spark, d):
    """Matches and precision of every rule; rules without matches stay in the report."""
    q = Q.annotate_questions(framed(spark, d)).withColumn("expected", Q.weak_bucket(T.fold_words(F.col("question"), percent=False)))
    hits = q.select("expected", "subject", "predicate", "modifier", F.explode_outer("matched_rules").alias("rule_id")).where("rule_id is not null")
    rules = spark.createDataFrame([(r, c, x) for r, c, x, _ in fixed.RULES], "rule_id string, category string, rule_relation string")
    j = hits.join(F.broadcast(rules), "rule_id")
    good = (
        F.when(F.col("category") == "question_relation", F.col("rule_relation") == F.col("expected"))
        .when(F.col("category") == "predicate_boundary", F.col("subject").isNotNull() & F.col("predicate").isNotNull()).otherwise(F.col("modifier").isNotNull()))
    counts = j.groupBy("rule_id").agg(F.count(F.lit(1)).alias("m"), F.sum(good.cast("int")).alias("c"))
    out = rules.join(counts, "rule_id", "left").withColumns({"matched": F.coalesce("m", F.lit(0)), "correct": F.coalesce("c", F.lit(0))})
    return out.select("rule_id", "category", "matched", "correct", (F.col("matched") - F.col("correct")).alias("incorrect"),
                      F.when(F.col("matched") > 0, F.round(F.col("correct") / F.col("matched"), 6)).alias("precision"),
                      F.when(F.col("matched") < fixed.LOW_COVERAGE, "LOW_COVERAGE_RULE").alias("warning"))


def answer_completeness(spark, d):
    rows = predictions(spark, d)
    return rows.select("id", A.completeness(F.col("predicted_answer")).alias("score"),
                       A.completeness(F.col("context")).alias("context_score"))


def answer_type_score(spark, d):
    rows = predictions(spark, d)
    kinds = F.array(*[F.lit(t) for t in ("TIME", "NUMBER", "PERSON", "LOCATION", "DEFINITION", "ENTITY", "GENERAL")])
    rows = rows.withColumn("types", F.array(F.element_at(kinds, (F.col("id") % 7 + 1).cast("int")), F.element_at(kinds, (F.col("id") % 5 + 2).cast("int"))))
    out = A.add_answer_type(rows, "predicted_answer", "types")
    return out.select("id", F.array_join("types", ",").alias("types"), "answer_type_score", "answer_type_reason")


def _spans(spark, d):
    rows = predictions(spark, d).withColumn("start_char", (F.col("id") % 23).cast("int"))
    return rows.withColumn("end_char", F.col("start_char") + 5 + (F.col("id") % 31).cast("int"))


def span_checks(spark, d):
    """Word-boundary and support checks of spans cut at fixed positions."""
    r = _spans(spark, d)
    c, s, e = F.col("context"), F.col("start_char"), F.col("end_char")
    return r.select("id", A.clean_word_boundaries(c, s, e).alias("clean"), A.is_supported(c, F.col("predicted_answer"), s, e).alias("supported"),
                    A.repeats_question(F.concat_ws(" ", "question", "context"), A.slice_of(c, s, e)).alias("echo"))


def boundary_score(spark, d):
    rows = _spans(spark, d).withColumn("types", F.when(F.col("id") % 2 == 0, F.array(F.lit("PERSON"))).otherwise(F.array(F.lit("TIME"), F.lit("ENTITY"))))
    out = A.add_boundary(rows, "context", "start_char", "end_char", "types", "question")
    return out.select("id", "boundary_score", F.array_join("boundary_reasons", ",").alias("reasons"))


def refine_spans(spark, d):
    rows = _spans(spark, d).withColumns({"types": F.array(F.lit("PERSON")), "coarse_relation": F.lit("FACTOID")})
    return A.refine_spans(rows).select("id", "refined_start", "refined_end", "refined_text", "refinement")


def gate_rows(spark, d):
    """Candidates with every input of the gate chain, derived from their ids."""
    i, c = F.col("id"), F.col("candidate_id")
    df = candidates(spark, d).withColumns({
        "relation": F.element_at(F.array(*[F.lit(r) for r in [*RELATIONS, "OTHER"]]), (i % (len(RELATIONS) + 1) + 1).cast("int")),
        "method": F.when(c % 3 == 0, "sentence_fallback").when(c % 3 == 1, "phrase_fallback").otherwise("neural_span"),
        "question_id": (i / 2).cast("long"), "passage_id": i, "relation_complete": c % 6 != 0,
        "completeness_reasons": F.when(c % 12 == 0, F.array(F.lit("DANGLING_CONNECTOR"))).otherwise(F.array(F.lit("X"))),
        "lexical_evidence": c % 7 != 0, "subject_valid": c % 5 != 0, "subject_score": F.col("subject_match_score"),
        "relation_valid": c % 4 != 0, "relation_evidence": c % 4 != 0,
        "relation_reason": F.when(c % 8 == 0, "TIME_SUBJECT_MISMATCH").when(c % 8 == 1, "RELATION_MISMATCH"),
        "raw_span_score": F.col("reader_score") * 3, "start_char": (c % 3).cast("int"), "end_char": (c % 3 + 4).cast("int"),
    }).drop("ranking_score")
    return gates.add_gates(gates.add_ranking(gates.with_policies(df)))


def gate_chain(spark, d):
    return gate_rows(spark, d).select("candidate_id", "ranking_score", *[f"gate_{g}" for g in fixed.GATE_ORDER], "rejection_reason", "relation_warning")


def select_answer(spark, d):
    return gates.select_answers(gate_rows(spark, d)).select("question_id", "candidate_id", "ranking_score")


def representatives(spark, d):
    return gates.passage_representatives(gate_rows(spark, d)).select("question_id", "passage_id", "candidate_id", "rejection_reason")


def merged_spans(spark, d):
    return gates.merge_spans(gate_rows(spark, d).withColumn("text", F.lit("t")), ["question_id"]).select("question_id", "candidate_id")


def fallback_errors(spark, d):
    rows = gate_rows(spark, d).select(
        "question_id", (F.col("question_id") % 5 != 0).alias("is_answerable"), (F.col("question_id") % 7 == 0).alias("has_answer"),
        F.col("passes_type_gate").alias("gold_in_passage"), (F.col("method") == "sentence_fallback").alias("is_sentence_fallback"),
        F.when(F.col("candidate_id") % 9 == 0, "temporal_expression_pattern").otherwise("whole_sentence").alias("fallback_method"), "rejection_reason",
        (F.col("candidate_id") % 4 == 0).alias("gold_in_fallback"), (F.col("candidate_id") % 8 == 0).alias("neural_exact"))
    return gates.fallback_errors(rows).groupBy("error").agg(F.count(F.lit(1)).alias("count"))


def _location_rows(spark, d):
    """Answers and candidates of all prediction rows, with the types of their framed questions."""
    kind = F.col("candidate_id") % 5
    rows = candidates(spark, d).select(
        F.col("id").alias("question_id"), "candidate_id", "ranking_score", "relation_score", "passes_reader_threshold",
        F.when(kind < 3, "sentence_fallback").otherwise("neural_span").alias("method"),
        F.when(kind == 0, "whole_sentence").when(kind == 1, "location_pattern").alias("fallback_method"))
    best = rows.where("passes_reader_threshold and ranking_score > 0.5").groupBy("question_id").agg(F.max_by(
        F.struct("method", "fallback_method", "relation_score"), F.struct("ranking_score", -F.col("candidate_id"))).alias("b"))
    types = Q.question_types(T.fold_words(F.col("question")))
    asked = framed(spark, d).select(F.col("id").alias("question_id"), F.get(types, F.lit(0)).alias("question_type"))
    answers = predictions(spark, d).select(F.col("id").alias("question_id"), "is_answerable", "gold_answer", "predicted_answer")
    answers = answers.join(asked, "question_id").join(best, "question_id", "left").select(
        *answers.columns, "question_type", F.col("b.method").alias("selected_method"), F.col("b.fallback_method").alias("selected_fallback_method"),
        F.when(F.col("b.relation_score") > 0.3, "NAMED_ENTITY_LOCATION_CANDIDATE").alias("answer_type_reason"), (F.col("b.relation_score") > 0.6).alias("relation_evidence"))
    return answers, rows


def location_errors(spark, d):
    return gates.location_errors(*_location_rows(spark, d))


def location_counters(spark, d):
    return gates.location_counters(_location_rows(spark, d)[0])


def ranking_combine(spark, d):
    c = candidates(spark, d)
    signal = ranking.reader_signal(F.col("reader_score"), F.col("fallback_penalty"), F.col("boundary_score"), F.col("completeness_score"))
    return c.select("candidate_id", F.round(ranking.combine(F.col("retrieval_score"), signal, F.col("answer_type_score")), 6).alias("score"),
                    F.round(ranking.combine(F.col("retrieval_score"), F.col("reader_score"), F.col("answer_type_score"), F.col("relation_score"), 0.4, 0.3, 0.2, 0.1), 6).alias("plain"))


def _features(spark, d):
    """Embeddings as reader output: half of the values are start scores, half end scores."""
    token = F.sequence(F.lit(0), F.lit(31))
    offsets = F.transform(token, lambda i: F.when(i >= 4, F.struct((i * 5).alias("s"), (i * 5 + 4).alias("e"))))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("feature"), (F.col("vec_id") / 2).cast("long").alias("sample"), F.slice("embedding", 1, 32).alias("start_logits"),
        F.slice("embedding", 33, 32).alias("end_logits"), offsets.alias("offsets"))


def span_decode(spark, d):
    out = spans.decode_spans(_features(spark, d), ["feature"], max_tokens=8, limit=5)
    return out.select("feature", "start_char", "end_char", F.round("score", 6).alias("score"), "rank")


def window_merge(spark, d):
    """Best spans per sample over its two windows."""
    rows = spans.decode_spans(_features(spark, d), ["sample", "feature"], max_tokens=8).withColumns(
        {"start_score": F.lit(0.0), "end_score": F.lit(0.0)})
    out = spans.best_spans(rows, ["sample"], 3)
    return out.select("sample", "start_char", "end_char", F.round("score", 6).alias("score"), "rank")


def no_answer_margin(spark, d):
    f = _features(spark, d)
    best = spans.decode_spans(f, ["sample", "feature"], max_tokens=8, limit=1)
    out = spans.no_answer(f, best, "sample", 0.5)
    return out.select("sample", F.round("null_score", 6).alias("null_score"), F.round("score_margin", 6).alias("score_margin"), "has_answer",
                      F.round("confidence", 6).alias("confidence"))


def window_slices(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split(T.squeeze(F.col("text")), " ").alias("tokens"))
    return spans.windows(docs, "tokens", (F.col("doc_id") % 20).cast("int"), 256, 80, ["doc_id"])


def char_span_tokens(spark, d):
    rows = predictions(spark, d).select("id", F.col("context").alias("c"))
    rows = rows.withColumn("offsets", spans.token_offsets(F.col("c")))
    rows = rows.withColumn("t", spans.map_char_span(F.col("offsets"), (F.col("id") % 40).cast("int"), (F.col("id") % 40 + 25).cast("int")))
    return rows.select("id", F.size("offsets").alias("n_tokens"), "t.start_token", "t.end_token")


def span_integrity(spark, d):
    rows = predictions(spark, d).select(
        (F.col("id") % 3).alias("split"), "context", F.col("gold_answer").alias("answer_text"),
        F.when(F.col("is_answerable"), F.when(F.col("id") % 4 == 0, 0).otherwise((F.instr("context", F.col("gold_answer")) - 1) + (F.col("id") % 2))).cast("int").alias("answer_start"))
    return spans.integrity_report(rows, ["split"])


def line_alignment(spark, d):
    """Every line of every document in a spelling that joins words in pairs by ``_``, and back."""
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn(
        "model", F.regexp_replace(T.squeeze(F.col("text")), r"([^ ]+) ([^ ]+)", "$1_$2"))
    rows = alignment.line_spans(alignment.add_tokens(alignment.add_alignment(docs, "text", "model"), "text"))
    raw, model = F.col("raw_kept"), F.col("model_kept")
    there = rows.select("doc_id", "aligned", "raw_kept", "model_kept", F.transform("spans", lambda s: F.struct(
        s["start"].alias("raw_start"), s["end"].alias("raw_end"), alignment.map_span(raw, model, s["start"], s["end"]).alias("m"))).alias("there"))
    back = there.select("doc_id", "aligned", F.explode_outer(F.transform("there", lambda s: F.struct(
        s["raw_start"].alias("raw_start"), s["raw_end"].alias("raw_end"), s["m"].alias("m"),
        alignment.map_span(model, raw, s["m"]["start"], s["m"]["end"]).alias("b")))).alias("x"))
    return back.where("x is not null").select("doc_id", "aligned", "x.raw_start", "x.raw_end", F.col("x.m.start").alias("model_start"), F.col("x.m.end").alias("model_end"),
                       F.col("x.b.start").alias("back_start"), F.col("x.b.end").alias("back_end"))


def window_integrity(spark, d):
    """Every line of every document as an annotated answer, without its final stop, in windows of 256 tokens."""
    docs = alignment.line_spans(alignment.add_tokens(table(spark, d, "documents").select("doc_id", "text"), "text"))
    docs = docs.withColumn("chars", alignment.characters(F.col("text")))

    def stop(s):
        last = F.get("chars", s["end"] - 1)
        return ((last == ".") | (last == "!") | (last == "?")) & (s["end"] - s["start"] > 1)

    docs = docs.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (s["end"] - stop(s).cast("int")).alias("end"))))
    return alignment.window_reasons(docs, ["doc_id"], F.lit(12))


def extract_phrases(spark, d):
    """Phrases from sentences that wrap the reply into the relation each question asks for."""
    asked = Q.annotate_questions(framed(spark, d)).select("id", "question", "types", "coarse_relation", "relation", "subject", "predicate")
    frames = ["Do {w} khiến {s} phát triển mạnh.", "{s} sinh năm 1990 tại thành phố Hà Nội.", "{s} nằm ở thành phố Huế từ năm 1805.",
              "{s} là nhà nghiên cứu {w}.", "{s} được xây dựng để nghiên cứu {w}, theo báo cáo."]
    pick = (F.col("id") % len(frames) + 1).cast("int")
    body = F.element_at(F.array(*[F.lit(f) for f in frames]), pick)
    words = table(spark, d, "conversations").where("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("id"), F.lower(T.squeeze(F.col("text"))).alias("w"))
    pairs = asked.join(words, "id").withColumn("context", F.replace(F.replace(body, F.lit("{w}"), F.col("w")), F.lit("{s}"), F.coalesce(F.col("subject"), F.lit("Hà Nội"))))
    out = extraction.sentence_fallback(pairs, ["id"])
    return out.select("id", "answer", "fallback_method", "confidence", "start_char", "end_char")


def answer_questions(spark, d):
    """The whole job over all turns and all passages."""
    q = framed(spark, d).withColumnRenamed("id", "question_id")
    docs = table(spark, d, "documents")
    parts = text_index.parts_for(docs, "text")
    # Written once: the search reads the passages, and so do the pairs it finds.
    passages = materialize(chunking.chunk_documents(docs.repartition(parts)).select("passage_id", "text"), "passages")
    hits = ranking.min_max(block_search.bm25(passages, q, 3, doc_id="passage_id", query_id="question_id", parts=parts))
    hits = hits.select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("passage_id"), F.col("score_norm").alias("retrieval_score"))
    return answering.answer(q, hits, passages.withColumnRenamed("text", "context")).select(
        "question_id", "passage_id", "answer", "has_answer", "rejection_reason", "ranking_score")


QUERIES = {f.__name__: f for f in (
    question_types, question_semantics, relation_rules, parser_coverage, rule_coverage, answer_completeness, answer_type_score, span_checks,
    boundary_score, refine_spans, gate_chain, select_answer, representatives, merged_spans, fallback_errors, location_errors, location_counters, ranking_combine, span_decode,
    window_merge, no_answer_margin, window_slices, char_span_tokens, span_integrity, line_alignment, window_integrity, extract_phrases, answer_questions)}
