"""Positions of one text in another spelling of it, and windows that hold annotated spans.

All lookups use sorted position arrays and a binary search inside the row, so a
text of n characters with m spans costs n + m log n, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askweave.functions import text as T
from askweave.operators.spans import windows

#: Tokens of a bucket of the interval join between spans and windows.
BUCKET = 256


def characters(text: Column) -> Column:
    """The code points of a text."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _blank(c: Column) -> Column:
    return c.isin(list(T.SPACES))


def upper_bound(values: Column, x: Column) -> Column:
    """How many elements of the rising array ``values`` are at most ``x``.

    ``values`` has to be a stored column: an expression would be computed anew in each step.
    """
    start = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def step(a, _):
        middle, more = F.shiftright(a["lo"] + a["hi"], 1), a["lo"] < a["hi"]
        right = F.get(values, middle) <= x
        return F.struct(F.when(more & right, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(more & ~right, middle).otherwise(a["hi"]).alias("hi"))

    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(values))))
    return F.aggregate(halvings, start, step, lambda a: a["lo"])


def kept_positions(text: Column) -> Column:
    """Positions of the characters that are neither blank nor ``_``; rising, 0-based."""
    return F.array_compact(F.transform(characters(text), lambda c, i: F.when(~_blank(c) & (c != "_"), i)))


def add_alignment(df: DataFrame, raw: str, model: str) -> DataFrame:
    """Add ``raw_kept, model_kept, aligned``: the position maps of two spellings of a text.

    The k-th kept character of one text is the k-th of the other.  ``aligned`` is
    false where characters other than blanks and ``_`` differ, compared without
    case; null texts are aligned with nothing.
    """
    def kept(x):
        return F.lower(F.regexp_replace(x, r"[\s\p{Z}\x0b\x1c-\x1f\x85_]", ""))

    df = df.withColumns({"raw_kept": kept_positions(F.col(raw)), "model_kept": kept_positions(F.col(model))})
    same = (kept(F.col(raw)) == kept(F.col(model))) & (F.size("raw_kept") == F.size("model_kept"))
    return df.withColumn("aligned", F.coalesce(same, F.lit(False)))


def map_span(here: Column, there: Column, start: Column, end: Column) -> Column:
    """The range in the other text of a range in this one; ``(-1, -1)`` for a range without kept characters.

    ``here`` and ``there`` are the position maps, stored columns both.
    """
    first, stop = upper_bound(here, start - 1), upper_bound(here, end - 1)
    found = (start >= 0) & (end > start) & (first < stop)
    return F.struct(F.when(found, F.get(there, first)).otherwise(-1).alias("start"), F.when(found, F.get(there, stop - 1) + 1).otherwise(-1).alias("end"))


def restore_offsets(kept: Column, offsets: Column) -> Column:
    """Character ranges of ``offsets`` that count kept characters only; empty or outside ones become ``(0, 0)``."""
    def restore(o):
        known = (o["e"] > o["s"]) & (o["s"] < F.size(kept))
        return F.struct(F.when(known, F.get(kept, o["s"])).otherwise(0).alias("s"),
                        F.when(known, F.get(kept, F.least(o["e"], F.size(kept)) - 1) + 1).otherwise(0).alias("e"))

    return F.transform(offsets, restore)


def add_tokens(df: DataFrame, text: str) -> DataFrame:
    """Add ``token_starts, token_ends`` of the blank-separated tokens, and ``line_ends``, where lines stop."""
    df = df.withColumn("_chars", F.coalesce(characters(F.col(text)), F.array().cast("array<string>")))
    chars = F.col("_chars")

    def edge(step):
        return F.transform(chars, lambda c, i: F.when(~_blank(c) & F.coalesce(_blank(F.get(chars, i + step)), F.lit(True)), i))

    # F.get is null outside of the array, also at -1, and a text's ends count as blank.
    ends = F.transform(F.array_compact(edge(1)), lambda i: i + 1)
    lines = F.array_append(F.array_compact(F.transform(chars, lambda c, i: F.when(c == "\n", i))), F.size(chars))
    return df.withColumns({"token_starts": F.array_compact(edge(-1)), "token_ends": ends, "line_ends": lines}).drop("_chars")


def line_spans(df: DataFrame) -> DataFrame:
    """Add ``spans``: the trimmed range ``(start, end)`` of every line that has a token.  After :func:`add_tokens`."""
    lines, starts, ends = F.col("line_ends"), F.col("token_starts"), F.col("token_ends")

    def span(stop, i):
        begin = F.when(i == 0, 0).otherwise(F.get(lines, i - 1) + 1)
        return F.struct(F.get(starts, upper_bound(starts, begin - 1)).alias("start"), F.get(ends, upper_bound(ends, stop) - 1).alias("end"))

    return df.withColumn("spans", F.filter(F.transform(lines, span), lambda s: s["start"] < s["end"]))


def window_reasons(df: DataFrame, keys: list[str], question_tokens: Column, max_length: int = 256, stride: int = 80) -> DataFrame:
    """Which annotated spans survive the cut of their text into overlapping windows, and why the others do not.

    Input: ``keys`` (unique), ``token_starts, token_ends`` and ``spans``, an array of
    character ranges.  One row per span: ``keys, start, end, n_tokens, covered, reason``.
    A span is whole when one window holds all its tokens and their outer characters
    are the span's.  The reasons of the others, the first that holds:
    ``ANSWER_EXCEEDS_WINDOW``, ``ANSWER_LONGER_THAN_STRIDE``, ``TOKENIZER_BOUNDARY``
    (a window holds it, but with more characters), ``CHUNK_OR_TOKENIZER_MAPPING``.
    Equal spans of a text are one row.  Null or empty spans and texts give no row.

    Spans and windows meet by bucket of token positions: a span looks in the bucket
    of its first token, a window lies in each bucket it touches, so a text with many
    of both is neither paired in full nor handled by one task.
    """
    starts, ends = F.col("token_starts"), F.col("token_ends")
    room = (F.lit(max_length) - question_tokens - 4).cast("int")

    def place(s):
        first = F.greatest(upper_bound(starts, s["start"]) - 1, F.lit(0))
        last = upper_bound(ends, s["end"] - 1)
        inside = (s["start"] >= F.get(starts, F.lit(0))) & (s["end"] <= F.get(ends, F.size(ends) - 1))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), first.alias("first"), last.alias("last"), inside.alias("inside"),
                        ((F.get(starts, first) == s["start"]) & (F.get(ends, last) == s["end"])).alias("exact"))

    real = F.filter(F.array_distinct("spans"), lambda s: s["end"] > s["start"])
    found = df.select(*keys, room.alias("_room"), F.explode_outer(F.transform(real, place)).alias("_p")).where(F.col("_p").isNotNull())
    found = found.select(*keys, "_room", "_p.*").withColumn("_bucket", F.floor(F.col("first") / BUCKET))
    cut = windows(df, "token_starts", question_tokens, max_length, stride, keys).where("window_end > window_start")
    touched = F.sequence(F.floor(F.col("window_start") / BUCKET), F.floor((F.col("window_end") - 1) / BUCKET))
    cut = cut.select(*keys, "window_start", "window_end", F.explode(touched).alias("_bucket"))
    holds = F.col("inside") & (F.col("window_start") <= F.col("first")) & (F.col("last") < F.col("window_end"))
    met = found.join(cut, [*keys, "_bucket"], "left").groupBy(*keys, "start", "end").agg(
        F.first("_room").alias("_room"), F.first("first").alias("first"), F.first("last").alias("last"), F.first("exact").alias("exact"),
        F.coalesce(F.max(holds), F.lit(False)).alias("covered"))
    n = F.col("last") - F.col("first") + 1
    reason = F.when(F.col("covered") & F.coalesce("exact", F.lit(False)), None).when(n > F.col("_room"), "ANSWER_EXCEEDS_WINDOW").when(
        n > stride, "ANSWER_LONGER_THAN_STRIDE").when(F.col("covered"), "TOKENIZER_BOUNDARY").otherwise("CHUNK_OR_TOKENIZER_MAPPING")
    return met.select(*keys, "start", "end", n.alias("n_tokens"), "covered", reason.alias("reason"))
