"""Registered queries: text functions, corpus building, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from askweave.functions import fixed
from askweave.functions import questions as Q
from askweave.functions import text as T
from askweave.operators import chunking, corpus
from askweave.sources.tables import content_digest, pending, table


def fold_accents(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded_md5"),
                       F.md5(T.fold_keep_length(F.col("text"))).alias("kept_md5"))


def tokenize_stats(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.raw_tokens(F.col("text")).alias("raw"))
    docs = docs.select("doc_id", F.size("raw").alias("n_raw"), T.content_only(F.col("raw")).alias("tokens"))
    return docs.select("doc_id", "n_raw", F.size("tokens").alias("n_tokens"),
                       F.size(F.array_distinct("tokens")).alias("n_distinct"),
                       F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def normalize_answers(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", T.normalize_answer(F.col("text")).alias("normalized"))


def clean_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("clean_text"))


def sentence_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def chunk_passages(spark, d):
    chunks = chunking.chunk_documents(table(spark, d, "documents"))
    return chunks.select("doc_id", "passage_id", "paragraph_id", "sentence_start", "sentence_end",
                         F.md5("text").alias("text_md5"), T.count_words(F.col("text")).alias("n_words"))


def fingerprints(spark, d):
    talk = table(spark, d, "conversations")
    parts = [F.col("conv_id").cast("string"), F.col("turn").cast("string"),
             T.normalize_feedback(F.col("role")), T.normalize_feedback(F.col("text"))]
    return talk.select("conv_id", "turn",
                       F.sha2(F.concat_ws(fixed.FINGERPRINT_SEPARATOR, *parts), 256).alias("fingerprint"))


def question_class_share(spark, d):
    users = table(spark, d, "conversations").where(F.col("role") == "user")
    return corpus.shares(users.select(Q.question_class(F.col("text")).alias("question_class")), "question_class")


def word_count_profile(spark, d):
    docs = table(spark, d, "documents").select("lang", T.count_words(F.col("text")).alias("words"))
    return corpus.describe_numbers(docs, "words", ["lang"])


def distinct_documents(spark, d):
    docs = table(spark, d, "documents").select("lang", "text", "doc_id")
    out = corpus.distinct_corpus(docs, ["lang", "text"], "doc_id", "text")
    return out.select("doc_id", "id", "lang", F.md5("text").alias("text_md5"))


def leakage(spark, d):
    return corpus.split_leakage(table(spark, d, "documents"), "source", "text")


def reanchored_answers(spark, d):
    """Every benchmark text as the answer of its own cleaned context, with a shifted stored start."""
    rows = table(spark, d, "benchmark").select(
        "item_id", T.clean_html(F.col("text")).alias("context"), F.col("text").alias("raw"))
    answer = F.regexp_extract("context", r"^(?:\S+\s+){2}(\S+\s+\S+)", 1)
    start = (F.col("item_id") % 3 * 7 - 1).cast("int")
    rows = rows.select("item_id", "context", answer.alias("answer"), start.alias("stored"))
    return rows.select("item_id", "answer", "stored",
                       corpus.reanchor(F.col("context"), F.col("answer"), F.col("stored")).alias("answer_start"))


def resume_pending(spark, d):
    done = table(spark, d, "labels")
    return pending(table(spark, d, "documents").select("doc_id", "lang"), done, "doc_id")


def table_digest(spark, d):
    return content_digest(table(spark, d, "labels"))


def union_splits(spark, d):
    """Text rows of three tables in one schema, counted per origin and distinct text."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("origin"), "text")
    items = table(spark, d, "benchmark").select(F.lit("benchmark").alias("origin"), "text")
    talk = table(spark, d, "conversations").select(F.lit("conversations").alias("origin"), "text")
    rows = docs.unionByName(items).unionByName(talk)
    per_text = rows.groupBy("origin", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per_text.groupBy("origin").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_texts"))


def source_titles(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return Q.add_source_titles(docs, "doc_id", "text").select("doc_id", "title")


QUERIES = {
    "fold_accents": fold_accents,
    "tokenize_stats": tokenize_stats,
    "normalize_answer": normalize_answers,
    "clean_html": clean_pages,
    "sentence_split": sentence_split,
    "chunk_documents": chunk_passages,
    "fingerprint": fingerprints,
    "question_class_share": question_class_share,
    "word_count_profile": word_count_profile,
    "distinct_corpus": distinct_documents,
    "split_leakage": leakage,
    "reanchor_answers": reanchored_answers,
    "resume_anti_join": resume_pending,
    "content_digest": table_digest,
    "union_splits": union_splits,
    "source_titles": source_titles,
}
