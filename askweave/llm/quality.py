"""Quality rules whose cut-offs are certified on labelled rows.

Each rule is a score that is high for bad text.  For every stratum, rule and
cut-off of a fixed grid, the good labelled rows above the cut-off are counted.
The hypothesis that the cut-off rejects more than ``risk / rules`` of good
documents is tested by the exact binomial tail, at ``doubt`` divided by the number
of all tests (Bonferroni), so with probability ``1 - doubt`` no stratum loses more
than ``risk`` of its good documents to the certified cut-offs of all rules
together, whichever of them are chosen.  Of these, each stratum and rule takes the
one that best parts the labelled bad rows from the good ones, or none.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from askweave.llm.common import materialize, trimmed, words

RISK = 0.05
DOUBT = 0.05
#: Rules and the cut-offs tested for each.
GRID = {
    "symbols": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "dup_lines": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeats": (0.05, 0.1, 0.2, 0.3, 0.4),
    "capitals": (0.1, 0.2, 0.3, 0.5, 0.7),
    "long_words": (8.0, 10.0, 12.0, 15.0, 20.0),
    "short_words": (-3.5, -3.0, -2.5, -2.0, -1.5),
}


def _repeat_words(words_: Column, windows: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``windows`` are the windows' hashes."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, k - 1)["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    # a one-element array holds an intermediate value, so that it is computed once
    spots = F.element_at(F.transform(F.array(ordered), places), 1)
    covered = F.element_at(F.transform(F.array(spots), lambda p: F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals)`` of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"), words(F.col(text_col)).alias("w"))
    last = F.size("w") - 3
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda x: trimmed(x) != "")
    base = base.select("doc_id", "stratum", "text", "w", windows.alias("windows"), lines.alias("lines"))
    length = F.length("text")
    return base.select(
        "doc_id", "stratum", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w"), F.col("windows")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_capitals"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def scores() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "long_words": F.col("word_chars") / n,
        "short_words": -F.col("word_chars") / n,
    }


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of n trials at ``rate``; 1 where k is above the mean, which no test needs."""
    step = log(rate / (1 - rate))
    start = n * log(1 - rate)
    zero = F.struct(start.cast("double").alias("term"), F.exp(start).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + step
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * rate, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(terms, zero, add, lambda a: a["sum"])))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """``(stratum, rule, cutoff, good, rejected_good, rejected_bad)``: the chosen certified cut-offs, from all labelled rows."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.where(~base_failed()).join(labels, "doc_id").select(
        "stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), s.alias("score"), F.array(*map(F.lit, GRID[r])).alias("grid")) for r, s in scores().items()])).alias("x"))
    rows = rows.select("stratum", "quality", "x.rule", "x.score", F.explode("x.grid").alias("cutoff"))
    above = F.col("score") > F.col("cutoff")
    counts = rows.groupBy("stratum", "rule", "cutoff").agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.sum(F.when((F.col("quality") == 1) & above, 1).otherwise(0)).alias("rejected_good"),
        F.sum(F.when((F.col("quality") == 0) & above, 1).otherwise(0)).alias("rejected_bad"))
    counts = materialize(counts, "quality-counts")
    tests = max(1, counts.count())
    sure = counts.where(binomial_tail(F.col("rejected_good"), F.col("good"), risk / len(GRID)) <= doubt / tests)
    gain = F.col("rejected_bad") - F.col("rejected_good")
    best = F.row_number().over(Window.partitionBy("stratum", "rule").orderBy(F.desc(gain), F.desc("cutoff")))
    return sure.where(gain > 0).withColumn("at", best).where("at = 1").drop("at")


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` of each row.

    A null text has no words and fails the base rules, like an empty one.  Null
    is a stratum of its own; a stratum with too few labelled good rows for a
    certificate has no cut-off and loses rows to the base rules only.  Null ids
    and repeated rows are judged like others; of repeated labels the lowest
    counts, null labels do not.  Empty tables give empty results or no cut-offs.
    """
    measured = materialize(measures(docs, id_col, text_col, stratum_col), "quality-measures")
    chosen = materialize(cutoffs(measured, labels, risk, doubt), "quality-cutoffs")
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in GRID])
    rows = measured.join(wide.withColumnRenamed("stratum", "_stratum"), F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    fine = F.lit(True)
    for rule, score in scores().items():
        fine = fine & F.coalesce(score <= F.col(f"_{rule}"), F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & fine).alias("kept"))
