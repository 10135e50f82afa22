"""Span decoding from logits, windows over long texts, offset mapping and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askweave.functions import text as T


def _top(logits: str, n: int) -> Column:
    """Positions and values of the largest logits; equal values put the later position first."""
    return F.slice(F.sort_array(F.transform(logits, lambda x, i: F.struct(x.cast("double").alias("v"), i.alias("i"))), asc=False), 1, n)


def decode_spans(df: DataFrame, keys: list[str], top_n: int = 20, max_tokens: int = 40, limit: int = 20) -> DataFrame:
    """Best valid spans per feature row.

    Needs ``start_logits, end_logits, offsets`` (array of structs ``s, e``; null
    where a token is not part of the context).  At most ``top_n`` starts meet
    ``top_n`` ends inside the row, so nothing is joined.
    """
    df = df.withColumns({"_a": _top("start_logits", top_n), "_b": _top("end_logits", top_n)})
    pairs = F.flatten(F.transform("_a", lambda a: F.transform("_b", lambda b: F.struct(
        a["i"].alias("start_token"), b["i"].alias("end_token"), a["v"].alias("start_score"), b["v"].alias("end_score"),
        (a["v"] + b["v"]).alias("score")))))
    ordered = F.filter(pairs, lambda p: (p["end_token"] >= p["start_token"]) & (p["end_token"] - p["start_token"] + 1 <= max_tokens))
    rows = df.select(*keys, "offsets", F.explode_outer(ordered).alias("p")).where("p is not null").select(
        *keys, "p.*", F.get("offsets", F.col("p.start_token"))["s"].alias("start_char"),
        F.get("offsets", F.col("p.end_token"))["e"].alias("end_char"),
    ).where("start_char is not null and end_char is not null and end_char > start_char")
    return best_spans(rows, keys, limit)


def best_spans(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """One row per character span (highest score, also across windows), ranked per key."""
    value = F.struct("score", F.col("start_token").alias("st"), F.col("end_token").alias("et"), "start_score", "end_score")
    best = rows.groupBy(*keys, "start_char", "end_char").agg(F.max(value).alias("b"))
    w = Window.partitionBy(*keys).orderBy(F.desc("b.score"), "start_char", "end_char")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.select(*keys, "start_char", "end_char", F.col("b.st").alias("start_token"), F.col("b.et").alias("end_token"),
                         F.col("b.score").alias("score"), "rank")


def no_answer(features: DataFrame, best: DataFrame, sample: str, threshold: float, scale: float = 10.0) -> DataFrame:
    """Decision per sample: best span against the smallest first-token score over its windows."""
    null = features.groupBy(sample).agg(F.min(F.get("start_logits", F.lit(0)).cast("double") + F.get("end_logits", F.lit(0)).cast("double")).alias("null_score"))
    top = best.groupBy(sample).agg(F.max("score").alias("best_span_score"))
    j = null.join(top, sample, "left")
    margin = F.coalesce(F.col("best_span_score") - F.col("null_score"), F.lit(float("-inf")))
    j = j.withColumn("score_margin", margin)
    shifted = (F.col("score_margin") - threshold) / max(0.01, scale)
    return j.withColumns({
        "has_answer": F.col("best_span_score").isNotNull() & (F.col("score_margin") >= threshold),
        "confidence": F.when(F.col("best_span_score").isNull(), 0.0).otherwise(1.0 / (1.0 + F.exp(-shifted))),
    })


def windows(df: DataFrame, tokens: str, question_tokens: Column, max_length: int, stride: int, keys: list[str]) -> DataFrame:
    """Overlapping windows ``[window_start, window_end)`` over a token array.

    A window holds ``max_length - question - 4`` tokens; the next one starts
    ``stride`` tokens before its end.  No row is left out: an empty or null token
    array has one empty window, and a question that leaves no room, or no progress
    where a second window is needed, is an error.
    """
    room = (F.lit(max_length) - question_tokens - 4).cast("int")
    df = df.withColumns({"_n": F.coalesce(F.size(tokens), F.lit(0)), "_room": room}).withColumn("_n", F.greatest("_n", F.lit(0)))
    count = (
        F.when(F.col("_room") <= 0, F.raise_error(F.lit("the question leaves no room for a window")).cast("int"))
        .when(F.col("_n") <= F.col("_room"), 1)
        .when(F.col("_room") <= stride, F.raise_error(F.lit("the stride leaves no progress between windows")).cast("int"))
        .otherwise(1 + F.ceil((F.col("_n") - F.col("_room")) / (F.col("_room") - stride)).cast("int")))
    rows = df.select(*keys, "_n", "_room", F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    start = F.col("window") * (F.col("_room") - stride)
    return rows.select(*keys, "window", start.alias("window_start"), F.least(start + F.col("_room"), F.col("_n")).alias("window_end"))


def token_offsets(text: Column) -> Column:
    """Character ranges of blank-separated tokens."""
    words = F.regexp_extract_all(text, F.lit(r"[^\s\p{Z}]+\s*"), F.lit(0))
    lead = F.length(text) - F.length(F.ltrim(text, F.lit(T.SPACES)))
    start = F.struct(lead.alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc, w):
        size = F.length(F.rtrim(w, F.lit(T.SPACES)))
        return F.struct((acc["at"] + F.length(w)).alias("at"), F.concat(
            acc["out"], F.array(F.struct(acc["at"].alias("s"), (acc["at"] + size).alias("e")))).alias("out"))

    return F.aggregate(words, start, step, lambda acc: acc["out"])


def map_char_span(offsets: Column, start: Column, end: Column) -> Column:
    """Token range covering a character range; the first token (0, 0) when it is not inside."""
    inside = (start >= F.get(offsets, F.lit(0))["s"]) & (end <= F.try_element_at(offsets, F.lit(-1))["e"])
    first = F.size(F.filter(offsets, lambda o: o["s"] <= start)) - 1
    last = F.size(F.filter(offsets, lambda o: o["e"] < end))
    return F.when(inside, F.struct(first.alias("start_token"), last.alias("end_token"))).otherwise(
        F.struct(F.lit(0).alias("start_token"), F.lit(0).alias("end_token")))


def restore_offset(text: Column, compact: Column) -> Column:
    """Position in ``text`` of the ``compact``-th character that is neither blank nor ``_`` (0-based)."""
    places = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: ~F.substring(text, i, F.lit(1)).rlike(r"[\s\p{Z}_]"))
    return F.get(places, compact) - 1


def is_aligned(raw: Column, model: Column) -> Column:
    """Both spellings agree after blanks and ``_`` are taken out."""
    def compact(x):
        return F.regexp_replace(T.nfc(x), r"[\s\p{Z}_]", "")

    return compact(raw) == compact(model)


def integrity_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Per split: answerable rows, exact slices, first-match rate and failure reasons.

    Needs ``context, answer_text, answer_start``.
    """
    a, s, c = F.col("answer_text"), F.col("answer_start"), F.col("context")
    yes = (F.coalesce(s, F.lit(-1)) >= 0) & (F.coalesce(a, F.lit("")) != "")
    exact = F.substring(c, s + 1, F.length(a)) == a
    found = F.instr(c, a) - 1

    def n(cond):
        return F.count(F.when(cond, 1))

    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"), n(yes).alias("answerable"), n(yes & exact).alias("valid"),
        n(yes & (s + F.length(a) > F.length(c))).alias("outside_context"), n(yes & ~exact & (found < 0)).alias("not_in_context"),
        n(yes & ~exact & (found >= 0)).alias("shifted"), n(yes & (found >= 0)).alias("first_match"), n(yes & (found == s)).alias("first_match_exact"),
    )
    return out.withColumn("accuracy", F.when(F.col("answerable") > 0, F.round(100.0 * F.col("valid") / F.col("answerable"), 6)).otherwise(0.0))
