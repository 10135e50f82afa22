"""Answer metrics: EM / F1, reports, error classes, threshold sweeps, grid search, ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askweave.functions import fixed
from askweave.functions import text as T
from askweave.operators.quantiles import quantile_columns, threshold_grid

E12 = 1e-12


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum over common words of the smaller of both counts."""
    def times(words: Column, w: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == w))

    return F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda acc, w: acc + F.least(times(a, w), times(b, w))
    )


def f1(gold: Column, predicted: Column) -> Column:
    """Token F1 of two word arrays; both empty gives 1, one empty gives 0."""
    n, m = F.size(gold), F.size(predicted)
    common = multiset_overlap(gold, predicted)
    return (
        F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (common == 0), 0.0)
        .otherwise(2.0 * common / (n + m))
    )


def set_f1(gold: Column, predicted: Column) -> Column:
    """Variant that counts common distinct words over list lengths."""
    n, m = F.size(gold), F.size(predicted)
    common = F.size(F.array_intersect(gold, predicted))
    return (
        F.when((n == 0) | (m == 0), F.when(n == m, 1.0).otherwise(0.0)).when(common == 0, 0.0)
        .otherwise(2.0 * common / (n + m))
    )


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(common / union)


def score_predictions(df: DataFrame, gold: str = "gold_answer", predicted: str = "predicted_answer") -> DataFrame:
    """Add ``em``, ``f1``, normalized lengths and emptiness; the normal forms are computed once."""
    df = df.withColumns({
        "_g": T.split_words(T.normalize_answer(F.col(gold))), "_p": T.split_words(T.normalize_answer(F.col(predicted)))
    })
    return df.withColumns({
        "em": (F.col("_g") == F.col("_p")).cast("int"),
        "f1": f1(F.col("_g"), F.col("_p")),
        "gold_words": F.size("_g"),
        "predicted_words": F.size("_p"),
        "empty": T.strip(F.coalesce(F.col(predicted), F.lit(""))) == "",
    }).drop("_g", "_p")


def percent(condition: Column | None, value: Column) -> Column:
    """100 * mean of ``value`` where ``condition`` holds; 0 for an empty group."""
    picked = value if condition is None else F.when(condition, value)
    return F.round(F.coalesce(100.0 * F.avg(picked), F.lit(0.0)), 6)


def report(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overall, answerable and unanswerable figures in one aggregate."""
    yes = F.col("is_answerable")
    empty = F.col("empty").cast("int")
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("overall_count"),
        percent(None, F.col("em")).alias("overall_em"),
        percent(None, F.col("f1")).alias("overall_f1"),
        F.count(F.when(yes, 1)).alias("answerable_count"),
        percent(yes, F.col("em")).alias("answerable_em"),
        percent(yes, F.col("f1")).alias("answerable_f1"),
        F.count(F.when(yes & F.col("empty"), 1)).alias("answerable_predicted_empty"),
        percent(yes, empty).alias("answerable_predicted_empty_rate"),
        F.count(F.when(~yes, 1)).alias("unanswerable_count"),
        percent(~yes, empty).alias("unanswerable_accuracy"),
        F.count(F.when(F.col("empty"), 1)).alias("predicted_no_answer"),
        percent(None, empty).alias("predicted_no_answer_rate"),
        F.count(F.when(~yes & ~F.col("empty"), 1)).alias("false_positive"),
        F.count(F.when(yes & F.col("empty"), 1)).alias("false_negative"),
    )


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no predictions to score")
    return df


def error_class() -> Column:
    """Error class of a scored prediction."""
    yes, empty = F.col("is_answerable"), F.col("empty")
    return (
        F.when(~yes & empty, "CORRECT_NO_ANSWER").when(~yes, "UNANSWERABLE_FALSE_POSITIVE")
        .when(empty, "ANSWERABLE_PREDICTED_EMPTY").when(F.col("em") == 1, "CORRECT")
        .when(F.col("f1") <= 0, "WRONG_SPAN")
        .when(F.col("predicted_words") < F.col("gold_words"), "SPAN_TOO_SHORT")
        .when(F.col("predicted_words") > F.col("gold_words"), "SPAN_TOO_LONG").otherwise("PARTIAL_SPAN")
    )


def result_note(gold: Column, predicted: Column) -> Column:
    gold, predicted = (T.strip(F.coalesce(c, F.lit(""))) for c in (gold, predicted))
    return (
        F.when((F.col("em") == 1) & (gold != ""), "Khớp chính xác").when(F.col("em") == 1, "Đúng khi không trả lời")
        .when((gold != "") & (predicted == ""), "Không trả lời")
        .when((gold == "") & (predicted != ""), "Trả lời khi câu không có đáp án")
        .otherwise("Không khớp đáp án chuẩn")
    )


def length_class(n: Column) -> Column:
    return (
        F.when(n == 0, "0").when(n <= 4, "1-4").when(n <= 8, "5-8").when(n <= 16, "9-16").when(n <= 32, "17-32")
        .otherwise("33+")
    )


def length_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(length_class(F.col(column)).alias("length_class")).agg(F.count(F.lit(1)).alias("count"))


def span_ratio_class(ratio: Column) -> Column:
    return (
        F.when(ratio < 0.5, "SEVERE_UNDER_SPAN").when(ratio < 0.8, "UNDER_SPAN").when(ratio <= 1.25, "ROUGHLY_CORRECT")
        .when(ratio <= 2.0, "OVER_SPAN").otherwise("SEVERE_OVER_SPAN")
    )


def span_ratio_buckets(scored: DataFrame) -> DataFrame:
    rows = scored.where(F.col("is_answerable") & (F.col("gold_words") > 0))
    ratio = F.col("predicted_words") / F.col("gold_words")
    return rows.groupBy(span_ratio_class(ratio).alias("span_class")).agg(F.count(F.lit(1)).alias("count"))


def refinement_outcome(raw: Column, refined: Column, changed: Column) -> Column:
    return (
        F.when(refined > raw + E12, "IMPROVED").when(refined + E12 < raw, "WORSENED").when(changed, "BOUNDARY_FIXED")
        .otherwise("UNCHANGED")
    )


# --- thresholds --------------------------------------------------------------------

_SUMS = ("rows", "em", "f1", "yes", "yes_em", "yes_f1", "yes_empty", "no", "no_empty", "empty")


def _row_values(em: Column, f1_: Column, yes: Column, empty: Column) -> list[Column]:
    e, y = empty.cast("double"), yes.cast("double")
    one = F.lit(1.0)
    return [one, em.cast("double"), f1_, y, y * em, y * f1_, y * e, 1 - y, (1 - y) * e, e]


def _metric_columns(df: DataFrame) -> DataFrame:
    def rate(value: str, count: str) -> Column:
        return F.when(F.col(count) > 0, 100.0 * F.col(value) / F.col(count)).otherwise(0.0)

    cols = {
        "overall_em": rate("em", "rows"), "overall_f1": rate("f1", "rows"),
        "answerable_em": rate("yes_em", "yes"), "answerable_f1": rate("yes_f1", "yes"),
        "unanswerable_accuracy": rate("no_empty", "no"), "predicted_no_answer_rate": rate("empty", "rows"),
        "answerable_predicted_empty_rate": rate("yes_empty", "yes"),
    }
    df = df.withColumns(cols).drop(*_SUMS)
    f, u = F.col("answerable_f1"), F.col("unanswerable_accuracy")
    df = df.withColumns({
        "false_positive_rate": 100.0 - u, "false_negative_rate": F.col("answerable_predicted_empty_rate"),
        "balanced_score": 0.5 * f + 0.5 * u,
        "reader_priority_score": fixed.PRIORITY_F1 * f + fixed.PRIORITY_NO_ANSWER * u,
    })
    derived = [*cols, "false_positive_rate", "false_negative_rate", "balanced_score", "reader_priority_score"]
    return df.withColumns({c: F.round(c, 6) for c in derived})


def _sweep(rows: DataFrame, margin: str, kept: list[Column], dropped: list[Column], thresholds: list[float],
           by: list[str]) -> DataFrame:
    """Metric sums for every threshold without pairing rows with thresholds.

    A row counts with its ``kept`` values for all thresholds up to its margin and
    with its ``dropped`` values beyond.  Rows are summed per interval between
    thresholds; running sums over the few intervals give every threshold.
    """
    cuts = sorted(set(float(t) for t in thresholds))
    passed = F.size(F.filter(F.lit(cuts), lambda t: t <= F.col(margin)))
    passed = F.when(F.col(margin).isNull() | F.isnan(margin), 0).otherwise(passed)
    sums = rows.withColumn("_i", passed).groupBy(*by, "_i").agg(
        *[F.sum(c).alias(f"k_{n}") for n, c in zip(_SUMS, kept)],
        *[F.sum(c).alias(f"d_{n}") for n, c in zip(_SUMS, dropped)],
    )
    # A row with ``_i`` thresholds passed is kept at cuts 0.._i-1.  Every group gets
    # one empty row per cut, so a running frame over the cuts sees all of them.
    spark = rows.sparkSession
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(cuts)], "_at int, threshold double")
    groups = sums.select(*by).distinct() if by else None
    axis = F.array(*[F.struct(F.lit(i).alias("_at"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)])
    marks = (groups.select(*by, F.explode(axis).alias("a")).select(*by, "a._at", "a.threshold") if by else grid)
    zeros = [F.lit(0.0).alias(c) for c in sums.columns if c not in (*by, "_i")]
    stacked = sums.select(*by, F.col("_i").alias("_at"), F.lit(None).cast("double").alias("threshold"),
                          *[c for c in sums.columns if c not in (*by, "_i")]).unionByName(
        marks.select(*by, "_at", "threshold", *zeros))
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    above = order.orderBy("_at").rangeBetween(1, Window.unboundedFollowing)
    upto = order.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    total = {
        n: F.coalesce(F.sum(f"k_{n}").over(above), F.lit(0.0)) + F.coalesce(F.sum(f"d_{n}").over(upto), F.lit(0.0))
        for n in _SUMS
    }
    swept = stacked.select(*by, "threshold", *[c.alias(n) for n, c in total.items()]).where("threshold is not null")
    return _metric_columns(swept)


def threshold_sweep(scored: DataFrame, margin: str = "score_margin", thresholds: list[float] | None = None,
                    by: list[str] | None = None) -> DataFrame:
    """Metrics of "answer if margin >= threshold" for every threshold.

    ``scored`` comes from :func:`score_predictions` on the best spans.
    """
    if thresholds is None:
        thresholds = threshold_grid(scored, margin)
    if not thresholds:
        raise ValueError("no thresholds given")
    yes = F.col("is_answerable")
    no_gold = (F.col("gold_words") == 0).cast("int")
    kept = _row_values(F.col("em"), F.col("f1"), yes, F.col("empty"))
    dropped = _row_values(no_gold, no_gold.cast("double"), yes, F.lit(True))
    return _sweep(scored, margin, kept, dropped, thresholds, by or [])


def best_row(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def select_threshold(sweep: DataFrame, metric: str = "reader_priority_score") -> DataFrame:
    if metric not in sweep.columns:
        raise ValueError(f"no such selection measure: {metric}")
    return best_row(sweep, [F.desc(metric), F.desc("answerable_f1"), F.desc("overall_f1"), F.asc("threshold")])


OBJECTIVES = [
    ("maximize_overall_f1", "overall_f1"),
    ("maximize_answerable_f1", "answerable_f1"),
    ("reader_priority_0.7_answerable_f1_0.3_unanswerable_accuracy", "reader_priority_score"),
]


def threshold_objectives(sweep: DataFrame) -> DataFrame:
    """Best threshold per objective, with the published tie chain."""
    out = None
    for name, metric in OBJECTIVES:
        best = best_row(sweep, [F.desc(metric), F.desc("answerable_f1"), F.desc("unanswerable_accuracy"),
                                F.desc("overall_f1"), F.asc("threshold")]).withColumn("objective", F.lit(name))
        out = best if out is None else out.unionByName(best)
    return out


# --- score distributions ---------------------------------------------------------------

def display_confidence(margin: Column, threshold: float = 0.0, scale: float = 10.0) -> Column:
    shifted = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (margin - threshold) / max(0.01, scale)))
    return 1.0 / (1.0 + F.exp(-shifted))


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def score_distribution(df: DataFrame, columns: list[str], by: str = "is_answerable") -> DataFrame:
    """Count, mean, population deviation and percentiles per class and score."""
    parts = F.array(*[F.struct(F.lit(c).alias("metric"), finite_or_null(F.col(c).cast("double")).alias("value")) for c in columns])
    long = df.select(by, F.explode(parts).alias("x")).select(by, "x.metric", "x.value").where("value is not null")
    basic = long.groupBy(by, "metric").agg(
        F.count("value").alias("count"), F.round(F.mean("value"), 6).alias("mean"),
        F.round(F.stddev_pop("value"), 6).alias("std"),
    )
    marks = quantile_columns(long, "value", {"p10": 0.10, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.90}, [by, "metric"])
    return basic.join(marks, [by, "metric"])


# --- re-ranking grid ----------------------------------------------------------------------

def hard_gates() -> Column:
    return (
        (F.coalesce(F.col("text"), F.lit("")) != "") & F.col("valid_span") & F.col("passes_evidence_gate")
        & F.col("passes_type_gate") & F.col("passes_relation_gate") & F.col("passes_completeness_gate")
    )


def strong_cause() -> Column:
    return (
        (F.col("relation_type") == "CAUSE") & (F.col("cause_pattern_score") >= 0.85)
        & (F.col("subject_match_score") >= 0.75) & (F.col("target_relation_score") >= 0.55)
        & (F.col("relation_score") >= 0.80)
    )


def grid_search(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Metrics of every (weights, phrase penalty, threshold) setting.

    ``questions``: ``id, gold_answer, is_answerable``.  ``candidates``: scores, flags
    and ``text`` per ``id`` with a unique ``candidate_id``.

    For a fixed weighting, the selected candidate is the best one passing the
    hard gates while its score reaches the threshold, and below that the best
    strong causal one.  Both are found once; thresholds then only cut.
    """
    settings = F.array(*[
        F.struct(F.lit(name).alias("config"), F.lit(r).alias("wr"), F.lit(d).alias("wd"), F.lit(t).alias("wt"),
                 F.lit(x).alias("wx"), F.lit(p).alias("penalty"))
        for name, r, d, t, x in fixed.GRID_WEIGHTS for p in fixed.GRID_PENALTIES
    ])
    passing = candidates.where(hard_gates()).withColumn("_strong", strong_cause())
    named = score_predictions(
        passing.join(questions.select("id", "gold_answer", "is_answerable"), "id").withColumn("predicted_answer", F.col("text"))
    )
    each = named.withColumn("s", F.explode(settings))
    penalty = F.when(F.col("method") == "phrase_fallback", F.col("s.penalty")).otherwise(F.col("fallback_penalty"))
    signal = F.col("reader_score") * penalty * (0.5 + 0.5 * F.col("boundary_score")) * (0.5 + 0.5 * F.col("completeness_score"))
    total = (
        F.col("s.wr") * F.col("retrieval_score") + F.col("s.wd") * signal + F.col("s.wt") * F.col("answer_type_score")
        + F.col("s.wx") * F.col("relation_score")
    )
    each = each.withColumn("score", F.round(total, 9))
    key = F.struct("score", "evidence_score", (-F.col("candidate_id")).alias("c"))
    value = F.struct("score", "em", "f1", "empty")
    chosen = each.groupBy("id", F.col("s.config").alias("config"), F.col("s.penalty").alias("penalty")).agg(
        F.max_by(value, key).alias("top"), F.max_by(F.when(F.col("_strong"), value), F.when(F.col("_strong"), key)).alias("strong")
    )
    plain = questions.select("id", "is_answerable", (F.size(T.split_words(T.normalize_answer(F.col("gold_answer")))) == 0).cast("int").alias("no_gold"))
    pairs = plain.withColumn("s", F.explode(settings)).select("id", "is_answerable", "no_gold", "s.config", "s.penalty")
    rows = pairs.join(chosen, ["id", "config", "penalty"], "left").withColumn(
        "margin", F.coalesce(F.col("top.score"), F.lit(float("-inf")))
    )
    yes = F.col("is_answerable")
    kept = _row_values(F.coalesce(F.col("top.em"), F.col("no_gold")), F.coalesce(F.col("top.f1"), F.col("no_gold").cast("double")),
                       yes, F.coalesce(F.col("top.empty"), F.lit(True)))
    dropped = _row_values(F.coalesce(F.col("strong.em"), F.col("no_gold")), F.coalesce(F.col("strong.f1"), F.col("no_gold").cast("double")),
                          yes, F.coalesce(F.col("strong.empty"), F.lit(True)))
    low, high, step = fixed.GRID_THRESHOLD_STEPS
    thresholds = [round(i / step, 3) for i in range(low, high + 1)]
    return _sweep(rows, "margin", kept, dropped, thresholds, ["config", "penalty"])


def grid_winners(grid: DataFrame) -> DataFrame:
    """Per weighting: the unconstrained best setting and the best within one answerable-F1 point of its maximum."""
    order = [F.desc("reader_priority_score"), F.desc("overall_f1"), F.desc("unanswerable_accuracy"), F.asc("penalty"), F.asc("threshold")]
    peak = F.max("answerable_f1").over(Window.partitionBy("config"))
    marked = grid.withColumn("best_answerable_f1", peak)
    free = best_row(marked, order, ["config"]).withColumn("selection", F.lit("unconstrained"))
    safe = best_row(marked.where(F.col("answerable_f1") >= F.col("best_answerable_f1") - 1.0), order, ["config"])
    return free.unionByName(safe.withColumn("selection", F.lit("constrained")))


def overall_winner(winners: DataFrame) -> DataFrame:
    relation = F.create_map(*[F.lit(v) for name, _, _, _, x in fixed.GRID_WEIGHTS for v in (name, x)])
    return best_row(winners.where("selection = 'constrained'").withColumn("relation_weight", relation[F.col("config")]),
                    [F.desc("reader_priority_score"), F.desc("overall_f1"), F.desc("relation_weight"), F.asc("config")])


# --- ablation -----------------------------------------------------------------------------------

VARIANTS = ["reader_only", "reader_plus_refinement", "reader_refinement_subject",
            "reader_refinement_subject_relation", "full_pipeline"]


def ablation(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Metrics of five predictor variants, in total and per relation bucket.

    ``questions``: ``id, gold_answer, is_answerable, bucket, production_answer``.
    One pass over the candidates finds the choice of every variant.
    """
    reader = (F.col("method") == "neural_span") & F.col("valid_span") & F.col("passes_reader_threshold")
    refined = reader & F.col("passes_completeness_gate")
    subject = refined & (~F.col("require_subject_match") | (F.col("subject_match_score") >= F.col("min_subject_score")))
    joined = candidates.join(questions.select("id", "bucket"), "id")
    relation = subject & (~F.col("bucket").isin(fixed.HOLDOUT_STRICT_BUCKETS) | F.col("passes_relation_gate"))
    key = F.struct("reader_score", "ranking_score", (-F.col("candidate_id")).alias("c"))

    def pick(gate: Column, text: Column) -> Column:
        return F.coalesce(F.max_by(F.when(gate, text), F.when(gate, key)), F.lit(""))

    shown = F.coalesce(F.nullif("display_text", F.lit("")), F.col("text"))
    raw = F.coalesce(F.nullif("raw_text", F.lit("")), F.col("text"))
    chosen = joined.groupBy("id").agg(*[
        pick(gate, text).alias(name)
        for name, gate, text in zip(VARIANTS, (reader, refined, subject, relation), (raw, shown, shown, shown))
    ])
    wide = questions.join(chosen, "id", "left").withColumn("full_pipeline", F.col("production_answer"))
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.coalesce(F.col(v), F.lit("")).alias("predicted_answer")) for v in VARIANTS])
    long = wide.select("id", "gold_answer", "is_answerable", "bucket", F.explode(variants).alias("v")).select("*", "v.*").drop("v")
    scored = score_predictions(long)
    total = report(scored, ["variant"]).withColumn("bucket", F.lit("ALL"))
    return total.unionByName(report(scored, ["variant", "bucket"]))


def ranking_counters(df: DataFrame, high_score: float = 0.8) -> DataFrame:
    """One row: how often the right passage was there, was taken, and what the answer was worth.

    Needs ``is_answerable, gold_answer, predicted_answer, passages`` (the text of
    all retrieved passages), ``selected`` (the text of the chosen one, null for
    none) and ``ranking_score``.
    """
    gold = T.normalize_answer(F.col("gold_answer"))
    answered = F.coalesce(F.col("predicted_answer"), F.lit("")) != ""
    holds = F.coalesce((gold != "") & F.contains(T.normalize_answer(F.col("selected")), gold), F.lit(False))
    wrong = answered & (gold != T.normalize_answer(F.col("predicted_answer"))) & (F.coalesce("ranking_score", F.lit(0.0)) >= high_score)
    events = {
        "gold_passage_available": F.col("is_answerable") & (gold != "") & F.contains(T.normalize_answer(F.col("passages")), gold),
        "gold_passage_selected": F.col("is_answerable") & holds,
        "wrong_passage_selected": F.col("is_answerable") & F.col("selected").isNotNull() & ~holds,
        "no_answer_correctly_emitted": ~F.col("is_answerable") & ~answered,
        "false_positive_answer_emitted": ~F.col("is_answerable") & answered,
        "high_score_wrong_answer": wrong,
    }
    out = df.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(c) for c, x in events.items()])
    rate = F.when(F.col("total") > 0, F.round(100.0 * F.col("high_score_wrong_answer") / F.col("total"), 6)).otherwise(0.0)
    return out.withColumn("high_score_wrong_answer_rate", rate)


def compare_runs(runs: DataFrame, reports: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row for each run that has its settings, its report and its best threshold; others are left out.

    ``runs``: ``run, learning_rate, epochs, max_length, stride``; ``reports``: ``run``
    and the columns of ``report``; ``thresholds``: ``run, best_threshold``.
    """
    both = runs.join(reports, "run").join(thresholds, "run")
    return both.select("run", "learning_rate", "epochs", "max_length", "stride", "overall_em", "overall_f1", "answerable_em", "answerable_f1",
                       "unanswerable_accuracy", "best_threshold", "answerable_predicted_empty_rate")
