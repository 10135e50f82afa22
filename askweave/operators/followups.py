"""Follow-up questions grounded in the passages around an answer."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from askweave.functions import fixed
from askweave.functions import text as T
from askweave.functions.questions import cases, has
from askweave.functions.subjects import subject_of
from askweave.operators import ranking
from askweave.operators.retrieval import bm25_over
from askweave.operators.text_index import Statistics, parts_for, query_terms
from askweave.operators.validation import add_subject_consistency
from askweave.session import materialize

CONF = fixed.FOLLOWUP
#: Longs of a question's word marks.
MARKS = 8


def content_words(x: Column) -> Column:
    words = T.split_words(T.fold_words(x))
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(fixed.FOLLOWUP_STOPWORDS))


@F.pandas_udf(DoubleType())
def _sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)])


def question_similarity(left: Column, right: Column) -> Column:
    """Larger of word Jaccard and character-sequence ratio; 1 for equal, 0 for empty questions."""
    a, b = T.fold_words(left), T.fold_words(right)
    wa, wb = F.array_distinct(content_words(left)), F.array_distinct(content_words(right))
    union = F.size(F.array_union(wa, wb))
    jaccard = F.when(union > 0, F.size(F.array_intersect(wa, wb)) / union).otherwise(0.0)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(jaccard, _sequence_ratio(a, b)))


def _word_marks(words: Column) -> list[Column]:
    """``MARKS`` longs in which each word sets one bit."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int"))
    return [F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(MARKS)) == i), F.lit(0).cast("long"), lambda out, h: out.bitwiseOR(bit(h))).alias(f"m{i}")  # noqa: B023
            for i in range(MARKS)]


def _proposed(listed: DataFrame, key: str, threshold: float) -> DataFrame:
    """Distinct ``left, right`` of ``listed(key, words, n)`` that share a word of their prefixes and can be similar.

    A row of a prefix carries the marks of all words, so that a pair is dropped
    where its rows meet: a bit set on one side only stands for a word of that side alone.
    """
    marks = [f"m{i}" for i in range(MARKS)]
    prefix = F.slice("words", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    p = materialize(listed.select(key, "n", F.transform(prefix, lambda w: F.xxhash64(w)).alias("prefix"), *_word_marks(F.col("words"))), "question-prefixes")
    p = p.select(F.col(key).alias("left"), F.col("n").alias("ln"), *marks, F.posexplode_outer("prefix").alias("la", "w")).where("w is not null")
    b = p.withColumnsRenamed({"left": "right", "ln": "rn", "la": "ra", **{m: f"r{m}" for m in marks}})
    near = (F.col("left") < F.col("right")) & (F.col("ln") >= F.col("rn") * threshold - 1e-9) & (F.col("rn") >= F.col("ln") * threshold - 1e-9)
    # A similar pair meets at its first common word; what both have from there on bounds its common words.
    rest = F.least(F.col("ln") - F.col("la"), F.col("rn") - F.col("ra"))
    both = F.col("ln") + F.col("rn")
    enough = rest * (1 + threshold) >= both * (threshold - 1e-6)
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"r{m}"))) for m in marks), F.lit(0))
    close = (both - apart) * (1 + threshold) >= 2 * both * (threshold - 1e-6)
    return p.join(b, "w").where(near & enough & close).select("left", "right").distinct()


def similar_questions(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Pairs of similar questions, found by shared words instead of by pairing everything.

    Only Jaccard candidates are formed: a prefix filter on the rarest words of each
    question (long words first) keeps the join selective and loses no pair at or
    above ``threshold``.  Questions without content words have no Jaccard and pair
    with equal ones only; blank questions pair with none.
    """
    words = F.array_sort(F.transform(F.array_distinct(content_words(F.col(text))), lambda w: F.struct((-F.length(w)).alias("o"), w.alias("w"))))
    normed = df.select(F.col(key).alias("_key"), T.fold_words(F.col(text)).alias("_norm"), F.col(text).alias("_text"))
    unique = normed.groupBy("_norm").agg(F.min("_key").alias(key), F.min("_text").alias(text))
    # Equal questions pair with their smallest id only; a group of copies stays linear.
    equal = normed.where("_norm <> ''").join(unique.where("_norm <> ''").select("_norm", F.col(key).alias("left")), "_norm").where(F.col("_key") != F.col("left")).select(
        "left", F.col("_key").alias("right"), F.lit(1.0).alias("similarity"))
    listed = unique.select(key, F.transform(words, lambda x: x["w"]).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    listed = materialize(listed, "question-words")
    pairs = materialize(_proposed(listed, key, threshold), "question-pairs")
    j = pairs.join(listed.select(F.col(key).alias("left"), F.col("words").alias("lw")), "left").join(
        listed.select(F.col(key).alias("right"), F.col("words").alias("rw")), "right")
    common = F.size(F.array_intersect("lw", "rw"))
    near = j.select("left", "right", F.round(common / (F.size("lw") + F.size("rw") - common), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    return near.unionByName(equal)


def context_passages(hits: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected passage first, then retrieved ones in rank order, without repeats, up to the limit.

    ``hits``: ``question_id, passage_id, rank, relevance``; ``selected``: ``question_id, passage_id``.
    """
    chosen = selected.select("question_id", "passage_id", F.lit(0).alias("rank"), F.lit(1.0).alias("relevance"))
    both = chosen.unionByName(hits.select("question_id", "passage_id", "rank", F.col("relevance").cast("double")))
    one = both.groupBy("question_id", "passage_id").agg(F.min("rank").alias("rank"), F.max("relevance").alias("relevance"))
    w = Window.partitionBy("question_id").orderBy("rank", "passage_id")
    kept = one.withColumn("position", F.row_number().over(w)).where(F.col("position") <= CONF["max_context_passages"])
    return kept.withColumn("is_selected", F.col("rank") == 0)


def _phrase_share(subject_words: Column, words: Column) -> Column:
    """1 when the subject words stand together, else their share, capped for several words."""
    together = F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(subject_words, " "), F.lit(" ")))
    distinct = F.array_distinct(subject_words)
    share = F.size(F.array_intersect(distinct, words)) / F.greatest(F.size(distinct), F.lit(1))
    return F.when(F.size(subject_words) == 0, 0.0).when(together, 1.0).when(F.size(subject_words) > 1, F.least(F.lit(0.6), share)).otherwise(share)


def discover(contexts: DataFrame) -> DataFrame:
    """Follow-up opportunities: one row per rule that a sentence supports.

    ``contexts``: ``question_id, question, answer, subject, relation, passage_id,
    context, relevance, is_selected``.  The subject is reduced to its focus, or
    inferred from the question where there is none.
    """
    spread = contexts.repartition(parts_for(contexts, "context"), "question_id")
    known = spread.withColumn("subject", subject_of(F.col("subject"), F.col("question")))
    rows = materialize(known, "followup-contexts").where(F.coalesce(F.col("subject"), F.lit("")) != "")

    def rx(*parts) -> Column:
        return F.concat(F.lit("(?U)"), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    # What a whole passage says about its subject is found once, before the passage is split.
    rows = rows.withColumns({"_s": T.split_sentences(F.col("context")), "_fs": T.squeeze(T.fold_case(F.col("subject")))})
    literal = F.concat(F.lit(r"\Q"), F.col("_fs"), F.lit(r"\E"))
    rows = rows.withColumn("_cued", F.rlike(T.squeeze(T.fold_case(F.col("context"))), rx(
        rf"(?:\b{fixed.FU_PERSON_CUE}\b.{{0,18}}", literal, "|", literal, rf".{{0,55}}\b{fixed.FU_PERSON_CUE}\b)")))
    rows = rows.select("*", F.posexplode_outer("_s").alias("sentence_no", "sentence")).where("sentence is not null").drop("_s")
    rows = add_subject_consistency(rows).drop("context")
    rows = rows.withColumns({
        "_f": T.squeeze(T.fold_case(F.col("sentence"))), "_o": F.lower("sentence"),
        "_sw": content_words(F.col("subject")), "_ww": content_words(F.col("sentence")), "_aw": F.array_distinct(content_words(F.coalesce("answer", F.lit("")))),
    })
    f, o, sub = F.col("_f"), F.col("_o"), F.col("_fs")
    surface = F.rlike(o, rx(r"(?<!\w)\Q", F.lower("subject"), r"\E(?!\w)"))
    pronoun = has(f, fixed.FU_PRONOUN)
    mismatch = (F.size("_sw") == 1) & ~surface & ~pronoun
    level = (
        F.when(mismatch, "NO_SUBJECT_MATCH").when((F.col("subject_status") == "VALID") & (F.col("subject_reason") == "PREVIOUS_SENTENCE_COREFERENCE"), "COREFERENCE_SUBJECT")
        .when(F.col("subject_status") == "VALID", "DIRECT_SUBJECT").otherwise("NO_SUBJECT_MATCH"))
    # Written tables between the stages keep each plan small; nested conditions
    # would otherwise be substituted into one another by the optimizer.
    rows = materialize(rows.withColumn("subject_match", level), "followup-sentences")
    direct, coref = F.col("subject_match") == "DIRECT_SUBJECT", F.col("subject_match") == "COREFERENCE_SUBJECT"

    def near(pattern: str, d: int) -> Column:
        gap = f".{{0,{d}}}"
        return (coref & has(f, pattern)) | (direct & F.rlike(f, rx("(?:", literal, gap, pattern, "|", pattern, gap, literal, ")")))

    def before(pattern: str, d: int) -> Column:
        return (coref & has(f, pattern)) | (direct & F.rlike(f, rx(literal, f".{{0,{d}}}", pattern)))

    rows = rows.withColumns({
        "_birth": has(f, r"\b(?:chao doi|ra doi)\b|(?<!\bsan )\bsinh\b(?!\s+vien\b)"), "_death": has(o, r"\b(?:mất|qua đời|từ trần|mat|qua doi|tu tran)\b"),
        "_date": has(o, fixed.FU_DATE_SURFACE), "_place": has(o, fixed.FU_PLACE_SURFACE), "_nb": near(fixed.FU_BIRTH, 40), "_nd": near(fixed.FU_DEATH, 40),
        "_event": has(sub, fixed.FU_EVENT_SUBJECT) & near(fixed.FU_EVENT, 60), "_timed": before(fixed.FU_TIMED_ACTION, 65),
        "_life": F.rlike(f, rx(literal, r"\s*\([^)]*\b(?:1\d{3}|20\d{2})\b[^)]*(?:-|–|—|den)\s*[^)]*\b(?:1\d{3}|20\d{2})\b[^)]*\)")),
        "_person": ~has(sub, fixed.FU_NOT_PERSON) & ((F.size(F.array_distinct("_sw")) >= 2) | F.col("_cued")),
    })

    def clause(pattern: str, x: Column) -> Column:
        """Original text before the first match of a marker, from the last clause break on."""
        at = F.regexp_instr(x, F.lit("(?U)" + pattern))
        left = F.btrim(F.regexp_replace(F.substring("sentence", F.lit(1), at - 1), r"(?s)^.*[.;:]", ""), F.lit(" ,;:-"))
        usable = (at > 0) & F.length(left).between(3, 130) & (_phrase_share(F.col("_sw"), content_words(left)) >= 0.75)
        tidy = ~T.fold_case(left).rlike(r"(?U)\b(?:cua|tai|o|tu|den|vao|rang)\s*$") & (F.length(left) - F.length(F.replace(left, F.lit(","), F.lit(""))) <= 2)
        return F.when(usable & tidy, left)

    keep = T.fold_keep_length(F.col("sentence"))
    rows = rows.withColumns({
        "_t_cause": clause(fixed.FU_CAUSE_SURFACE, o), "_t_purpose": clause(fixed.FU_PURPOSE_SURFACE, o), "_t_result": clause(fixed.FU_CONSEQUENCE, keep),
        "_t_time": F.when(F.col("_event"), F.col("subject")).otherwise(
            F.btrim(F.regexp_replace(clause(fixed.FU_DATE_FOLDED, keep), r"(?iU)\s+(?:vào|từ|đến)\s*$", ""), F.lit(" ,;:-"))),
    })
    rows = materialize(rows, "followup-facts")
    role = (coref & F.rlike(f, F.lit(rf"(?U){fixed.FU_PRONOUN}.{{0,65}}(?:{fixed.FU_ROLE_VERB}.{{0,30}})?{fixed.FU_ROLE_NOUN}\b"))) | (direct & (
        F.rlike(f, rx(literal, rf".{{0,95}}{fixed.FU_ROLE_VERB}\s+(?:(?:mot|cac|nhung|nguoi)\s+)?{fixed.FU_ROLE_NOUN}\b"))
        | F.rlike(f, rx(rf"\b{fixed.FU_ROLE_NOUN}\b.{{0,20}}", literal)) | F.rlike(f, rx(literal, r".{0,45}\b(?:giu chuc|dam nhiem|duoc bau|duoc bo nhiem)\b"))))
    any_activity = rf"(?:{fixed.FU_ACTIVITY}|{fixed.FU_ACTIVITY_MORE})"
    activity = (coref & F.rlike(f, F.lit(rf"(?U)\b(?:ong|ba|ho|nguoi nay|nhan vat nay|vi nay)\b.{{0,55}}{any_activity}"))) | (
        direct & F.rlike(f, rx(literal, r".{0,55}", any_activity)))
    c = F.col
    new_words = F.size(F.array_except("_ww", "_sw")) >= 3
    told = F.size(F.array_intersect("_aw", "_ww")) / F.greatest(F.size("_aw"), F.lit(1))
    normal_answer = T.fold_words(F.coalesce("answer", F.lit("")))
    fresh = ~((normal_answer != "") & F.contains(T.fold_words(c("sentence")), normal_answer)) & ~((F.size("_aw") >= 3) & (told >= 0.80))
    found = {
        "BIRTH_TIME": (c("_person") & ((c("_birth") & c("_nb") & c("_date")) | c("_life")), None),
        "BIRTH_LOCATION": (c("_person") & c("_birth") & c("_nb") & c("_place"), None),
        "DEATH_TIME": (c("_person") & ((c("_death") & c("_nd") & c("_date")) | c("_life")), None),
        "DEATH_LOCATION": (c("_person") & c("_death") & c("_nd") & c("_place"), None),
        "EVENT_TIME": (c("_date") & has(f, fixed.FU_DATE_VALUE) & ~c("_birth") & ~c("_death") & (c("_event") | c("_timed")) & c("_t_time").isNotNull()
                       & (c("_event") | (T.fold_words(c("_t_time")) != T.fold_words(c("subject")))), c("_t_time")),
        "EVENT_LOCATION": (c("_event") & c("_place"), c("subject")),
        "OBJECT_LOCATION": (has(o, fixed.FU_OBJECT_PLACE_SURFACE) & near(fixed.FU_OBJECT_PLACE, 55), None),
        "PROCESS_LOCATION": (near(fixed.FU_SPATIAL, 55), None),
        "CAUSE": (c("_t_cause").isNotNull(), c("_t_cause")), "PURPOSE": (c("_t_purpose").isNotNull(), c("_t_purpose")),
        "CONSEQUENCE": (c("_t_result").isNotNull(), c("_t_result")),
        "CONTEXT": (has(f, fixed.FU_CONTEXT) & (c("_event") | near(fixed.FU_ACTIVITY, 60)), None),
        "ROLE": (c("_person") & role, None), "EVENT": (c("_person") & activity, None), "ATTRIBUTE": (near(fixed.FU_HEIGHT, 45), F.lit("độ cao")),
        "COMPARISON": (near(fixed.FU_COMPARISON, 55), None), "IDENTITY": (F.rlike(f, rx(r"(?:^|[.;]\s*)", literal, r"\s+(?:la|duoc xem la)\b")), None),
        "EVIDENCE_DETAIL": ((_phrase_share(c("_sw"), c("_ww")) >= 0.75) & ~has(f, fixed.FU_LOW_DETAIL) & new_words & fresh, None),
    }
    spatial = cases([(has(f, rf"\b{p}\b"), word) for p, word in fixed.FU_SPATIAL_WORDS], "xuất hiện")
    none = F.lit(None).cast("string")
    options = []
    for name, (condition, target) in found.items():
        strength, rule, predicate = fixed.FU_STRENGTH[name]
        kind, group, _ = fixed.FOLLOWUP_RELATIONS[name]
        options.append(F.when(condition, F.struct(
            F.lit(name).alias("followup"), F.lit(kind).alias("question_type"), F.lit(group).alias("group"), F.lit(strength).alias("strength"),
            F.lit(rule).alias("rule"), (target if target is not None else none).alias("followup_target"),
            (spatial if name == "PROCESS_LOCATION" else F.lit(predicate)).alias("followup_predicate"))))
    grounded = F.col("subject_match") != "NO_SUBJECT_MATCH"
    overlap = F.greatest(_phrase_share(c("_sw"), c("_ww")), F.when(F.size("_aw") > 0, told).otherwise(0.0))
    rows = rows.withColumns({
        "_options": F.when(grounded, F.array_compact(F.array(*options))),
        "topic": F.least(F.lit(1.0), 0.45 * c("subject_score") + 0.25 * c("relevance") + 0.20 * F.when(c("is_selected"), 1.0).otherwise(0.65) + 0.10 * overlap),
    })
    base = ["question_id", "question", "subject", "relation", "target", "predicate", "passage_id", "sentence", "sentence_no", "position", "relevance",
            "is_selected", "subject_match", "subject_score", "topic"]
    listed = rows.select(*[x for x in base if x in rows.columns], F.explode_outer("_options").alias("o")).where("o is not null")
    return materialize(listed.select("*", "o.*").drop("o"), "followup-options")


def canonical(relation: Column) -> Column:
    relation = F.upper(F.trim(F.coalesce(relation, F.lit("GENERAL"))))
    return cases([(relation == a, b) for a, b in fixed.RELATION_EQUIVALENTS.items()], relation)


def followup_text() -> Column:
    """Question text of an opportunity row."""
    subject = F.trim(F.col("subject"))
    target = F.btrim(F.coalesce(F.col("followup_target"), subject), F.lit(" .?!,;:"))
    same = T.fold_words(target) == T.fold_words(subject)
    cased = F.when(F.col("followup") == "CAUSE", F.concat(F.lower(F.substring(target, 1, 1)), F.substring(target, F.lit(2), F.length(target)))).otherwise(target)
    upper = F.concat(F.upper(F.substring(subject, 1, 1)), F.substring(subject, F.lit(2), F.length(subject)))
    who = F.when(F.col("followup") == "PROCESS_LOCATION", upper).otherwise(subject)
    template = cases([(F.col("followup") == name, spec[2]) for name, spec in fixed.FOLLOWUP_RELATIONS.items()], F.lit(None).cast("string"))
    template = F.when((F.col("followup") == "EVENT_TIME") & same, "{subject} diễn ra vào thời gian nào?").otherwise(template)
    text = F.replace(template, F.lit("{subject}"), who)
    return F.replace(F.replace(text, F.lit("{target}"), cased), F.lit("{predicate}"), F.col("followup_predicate"))


def gate(opportunities: DataFrame, asked: DataFrame | None = None, probe: DataFrame | None = None) -> DataFrame:
    """Opportunities with their question, scores and ``rejection`` (null when they pass).

    The detail rule is a last resort: it stays only when no typed rule offers a
    relation other than the asked one.  ``asked``: ``question_id, text`` of earlier
    questions.  ``probe``: ``question_id, passage_id`` pairs a second retrieval
    confirmed for weak candidates.
    """
    o = opportunities.withColumns({"_rel": canonical(F.col("followup")), "_now": canonical(F.col("relation"))})
    goal = F.coalesce(F.col("followup_target"), F.col("followup_predicate"), F.lit(""))
    o = o.withColumn("_sig", F.sha2(F.concat_ws("␟", "_rel", T.fold_words(F.col("subject")), T.fold_words(goal)), 256))
    per = Window.partitionBy("question_id")
    typed = (F.col("followup") != "EVIDENCE_DETAIL") & (F.col("_rel") != F.col("_now"))
    o = o.withColumn("_typed", F.max(typed.cast("int")).over(per))
    detail = F.col("followup") == "EVIDENCE_DETAIL"
    o = o.where(~detail | (F.col("_typed") == 0))
    best_detail = Window.partitionBy("question_id", "followup").orderBy(F.desc("is_selected"), F.desc("topic"), F.desc("relevance"), "position", "sentence_no")
    o = o.withColumn("_d", F.row_number().over(best_detail)).where((F.col("followup") != "EVIDENCE_DETAIL") | (F.col("_d") == 1)).drop("_d")
    same_sentence = Window.partitionBy("question_id", "_sig", T.fold_words(F.col("sentence"))).orderBy("position", "sentence_no")
    o = o.withColumn("_k", F.row_number().over(same_sentence)).where("_k = 1")
    order = [F.desc("strength"), F.desc("topic"), F.desc("relevance"), F.col("position"), F.col("sentence_no"), F.col("followup")]
    o = o.withColumns({"ordinal": F.row_number().over(per.orderBy(*order)), "text": followup_text()})
    o = materialize(o, "followup-ordered")
    similar = question_similarity(F.col("text"), F.col("question"))
    if asked is not None:
        past = o.select("question_id", "ordinal", "text").join(asked.select("question_id", F.col("text").alias("_past")), "question_id")
        worst = past.groupBy("question_id", "ordinal").agg(F.max(question_similarity(F.col("text"), F.col("_past"))).alias("_past_similarity"))
        o = o.join(worst, ["question_id", "ordinal"], "left")
        similar = F.greatest(similar, F.coalesce(F.col("_past_similarity"), F.lit(0.0)))
    o = materialize(o.withColumn("similarity", similar), "followup-similarity")
    first = Window.partitionBy("question_id", "_sig").orderBy("ordinal")
    now = T.fold_words(F.coalesce(F.col("target"), F.col("predicate"), F.lit("")))
    then = T.fold_words(goal)
    repeats = (F.col("_rel") == F.col("_now")) & ((F.col("similarity") >= CONF["surface_similarity"]) | (now == "") | (now == then))
    score = F.least(F.lit(1.0), 0.58 * F.col("strength") + 0.22 * F.col("subject_score") + 0.14 * F.col("topic") + F.when(F.col("is_selected"), 0.06).otherwise(0.0))
    o = o.withColumns({"answerability": F.round(score, 6), "_same": F.row_number().over(first)})
    weak_topic, weak = F.col("topic") < CONF["min_topic"], F.col("answerability") < CONF["min_answerability"]
    confirmed = F.lit(False)
    if probe is not None:
        o = o.join(probe.select("question_id", "passage_id", F.lit(True).alias("_probe")).distinct(), ["question_id", "passage_id"], "left")
        tried = F.sum((weak_topic | weak).cast("int")).over(per.orderBy("ordinal"))
        confirmed = F.coalesce(F.col("_probe"), F.lit(False)) & (tried <= CONF["max_probes"])
    o = o.withColumn("_ok", confirmed)
    o = o.withColumn("rejection", F.when(F.col("ordinal") > CONF["max_internal_candidates"], "LOW_RANKING_SCORE").when(repeats, "SAME_RELATION")
                     .when((F.col("similarity") >= CONF["surface_similarity"]) | (F.col("_same") > 1), "DUPLICATE_QUESTION")
                     .when(F.col("subject_match") == "NO_SUBJECT_MATCH", "SUBJECT_RELEVANCE_LOW")
                     .when(weak_topic & ~F.col("_ok"), "TOPIC_DRIFT").when(weak & ~F.col("_ok"), "ANSWERABILITY_LOW"))
    return _without_echoes(o)


def _without_echoes(gated: DataFrame) -> DataFrame:
    """A question almost equal to an accepted earlier one of its relation is a duplicate, too.

    Which earlier ones are accepted depends on this very rule, so a question's few
    candidates are gone through in order, inside an array.
    """
    o = materialize(gated, "followup-gated")
    few = o.where(F.col("ordinal") <= CONF["max_internal_candidates"]).select("question_id", "_rel", "ordinal", "text")
    earlier = few.select("question_id", "_rel", F.col("ordinal").alias("_before"), F.col("text").alias("_text"))
    pairs = few.join(earlier, ["question_id", "_rel"]).where(F.col("_before") < F.col("ordinal"))
    echoes = materialize(pairs.withColumn("_s", question_similarity(F.col("text"), F.col("_text"))), "followup-pairs").where(F.col("_s") >= CONF["surface_similarity"])
    echoes = echoes.groupBy("question_id", "ordinal").agg(F.collect_set("_before").alias("_echoes"))
    marked = o.select("question_id", "ordinal", "rejection").join(echoes, ["question_id", "ordinal"], "left")
    listed = marked.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rejection", F.coalesce("_echoes", F.array().cast("array<int>")).alias("echoes")))).alias("x"))
    accepted = F.aggregate("x", F.array().cast("array<int>"), lambda done, x: F.when(
        x["rejection"].isNull() & (F.size(F.array_intersect(x["echoes"], done)) == 0), F.concat(done, F.array(x["ordinal"]))).otherwise(done))
    found = listed.select("question_id", F.explode("x").alias("x"), accepted.alias("done")).where(F.size(F.array_intersect("x.echoes", "done")) > 0)
    found = found.select("question_id", "x.ordinal", F.lit(True).alias("_echo"))
    later = F.col("rejection").isNull() | ~F.col("rejection").isin("LOW_RANKING_SCORE", "SAME_RELATION", "DUPLICATE_QUESTION")
    joined = o.join(found, ["question_id", "ordinal"], "left")
    return joined.withColumn("rejection", F.when(F.col("_echo") & later, "DUPLICATE_QUESTION").otherwise(F.col("rejection"))).drop("_echo")


def probe(gated: DataFrame, passages: DataFrame, post: DataFrame, stats: Statistics, top_k: int = fixed.PROBE_HITS) -> DataFrame:
    """``gated`` with its weak candidates confirmed or refused by a second retrieval round.

    The first ``max_probes`` candidates of a question that fail on topic or
    answerability become queries against the stored index ``post, stats``.  The
    first hit decides that is the candidate's own passage, or that supports an
    opportunity of the same relation about the subject; in the second case the
    candidate takes that opportunity's place, text and evidence.  Candidates
    without such a hit, and those beyond the limit, are rejected.

    ``passages``: ``passage_id, context``; the index's ``doc_id`` is ``passage_id``.
    """
    gated = materialize(gated, "probe-gated")
    weak = F.coalesce(F.col("rejection").isin("TOPIC_DRIFT", "ANSWERABILITY_LOW"), F.lit(False))
    tried = gated.where(weak).withColumn("_try", F.row_number().over(Window.partitionBy("question_id").orderBy("ordinal"))).where(F.col("_try") <= CONF["max_probes"])
    tried = materialize(tried.withColumn("probe_id", F.concat_ws(":", "question_id", "ordinal")).drop("_try"), "probe-tried")
    hits = ranking.min_max(bm25_over(None, post, query_terms(tried, "probe_id", "text"), top_k, "binary", stats))
    hits = materialize(hits.select(F.col("query_id").alias("probe_id"), F.col("doc_id").alias("_hit"), F.col("rank").alias("_rank"), F.col("score_norm").alias("_near")), "probe-hits")
    own = hits.join(tried.select("probe_id", "passage_id"), "probe_id").where(F.col("_hit") == F.col("passage_id")).select("probe_id", "_rank", "_near")
    asked = tried.select("probe_id", F.col("text").alias("question"), "subject", F.col("_rel").alias("_wanted"))
    contexts = hits.join(asked, "probe_id").join(passages.select(F.col("passage_id").alias("_hit"), "context"), "_hit").select(
        F.concat_ws(":", "probe_id", "_rank").alias("question_id"), "question", F.lit("").alias("answer"), "subject", F.lit(None).cast("string").alias("relation"),
        F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("predicate"), F.col("_hit").alias("passage_id"), "context", F.lit(1.0).alias("relevance"),
        F.lit(True).alias("is_selected"), F.lit(1).alias("position"))
    options = discover(contexts).where(F.col("subject_match") != "NO_SUBJECT_MATCH").withColumn("_found", canonical(F.col("followup")))
    fields = ["followup", "question_type", "group", "strength", "rule", "followup_target", "followup_predicate", "sentence", "subject_match", "subject_score", "topic", "passage_id"]
    best = Window.partitionBy("question_id", "_found").orderBy(F.desc("strength"), F.desc("topic"), "sentence_no", "followup")
    options = options.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(
        F.regexp_extract("question_id", r"^(.*):\d+$", 1).alias("probe_id"), F.regexp_extract("question_id", r":(\d+)$", 1).cast("int").alias("_rank"), "_found",
        F.struct(*fields).alias("_new"))
    other = options.join(asked.select("probe_id", "_wanted"), "probe_id").where(F.col("_found") == F.col("_wanted")).select("probe_id", "_rank", "_new")
    none = F.lit(None).cast(other.schema["_new"].dataType)
    either = own.select("probe_id", "_rank", "_near", none.alias("_new")).unionByName(other.select("probe_id", "_rank", F.lit(None).cast("double").alias("_near"), "_new"))
    # At one rank the candidate's own passage goes before what it supports.
    first = Window.partitionBy("probe_id").orderBy("_rank", F.col("_near").isNull())
    decided = either.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("probe_id", "_near", "_new")
    known = tried.select("question_id", "ordinal", "probe_id").join(decided, "probe_id", "left")
    rows = gated.join(known, ["question_id", "ordinal"], "left")
    rows = rows.withColumns({c: F.coalesce(F.col("_new")[c], F.col(c)) if c not in ("followup_target", "followup_predicate") else F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in fields})
    passed = F.col("_near").isNotNull() | F.col("_new").isNotNull()
    rows = rows.withColumns({
        "relevance": F.when(F.col("_new").isNotNull(), 1.0).otherwise(F.greatest("relevance", F.coalesce("_near", F.lit(0.0)))),
        "topic": F.when(F.col("_near").isNotNull(), F.greatest("topic", F.lit(CONF["min_topic"]))).otherwise(F.col("topic"))})
    score = F.least(F.lit(1.0), 0.58 * F.col("strength") + 0.22 * F.col("subject_score") + 0.14 * F.greatest("topic", F.lit(CONF["min_topic"])))
    rows = rows.withColumns({"answerability": F.when(passed, F.round(score, 6)).otherwise(F.col("answerability")), "text": F.when(F.col("_new").isNotNull(), F.coalesce(followup_text(), "text")).otherwise(F.col("text"))})
    refused = F.col("probe_id").isNotNull() & ~passed
    rejection = F.when(passed, F.lit(None).cast("string")).when(refused, "BM25_PROBE_FAILED").otherwise(F.col("rejection"))
    tier = F.when(rejection.isNull(), F.when(passed, "TIER_2_BM25").otherwise("TIER_1"))
    return _without_echoes(rows.withColumns({"tier": tier, "rejection": rejection}).drop("probe_id", "_near", "_new"))


def follow_ups_probed(contexts: DataFrame, passages: DataFrame, post: DataFrame, stats: Statistics, asked: DataFrame | None = None, limit: int = CONF["max_followups"]) -> DataFrame:
    """Like :func:`follow_ups`, with a second retrieval round for weak candidates."""
    passed = probe(gate(discover(contexts), asked), passages, post, stats).where("rejection is null")
    scored = passed.withColumn("novelty", F.round(F.greatest(F.lit(0.0), 1.0 - F.col("similarity")), 6))
    return rank(scored, min(CONF["max_followups"], max(0, limit))).select(
        "question_id", "rank", "text", "followup", "tier", "passage_id", "answerability", "novelty", "relevance", "ranking_score")


def rank(df: DataFrame, limit: int = CONF["max_followups"], query: str = "question_id") -> DataFrame:
    """Best follow-ups with a bonus for the first of each diversity group.

    Picking greedily gives the bonus to a group until one of its members is taken.
    All members carry the same bonus until then, so the leader of a group always
    goes first; giving the bonus to leaders only is the same order in one sort.
    """
    base = F.round(CONF["w_answerability"] * F.col("answerability") + CONF["w_relevance"] * F.col("relevance") + CONF["w_novelty"] * F.col("novelty"), 6)
    df = df.withColumn("_base", base)
    leader = Window.partitionBy(query, "group").orderBy(F.desc("_base"), F.desc("answerability"), F.desc("novelty"), "ordinal")
    df = df.withColumn("_lead", F.row_number().over(leader))
    df = df.withColumn("ranking_score", F.round(F.col("_base") + F.when(F.col("_lead") == 1, CONF["w_diversity"]).otherwise(0.0), 6))
    w = Window.partitionBy(query).orderBy(F.desc("ranking_score"), F.desc("answerability"), F.desc("novelty"), "ordinal")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("_base", "_lead")


def follow_ups(contexts: DataFrame, asked: DataFrame | None = None, probe: DataFrame | None = None, limit: int = CONF["max_followups"]) -> DataFrame:
    passed = gate(discover(contexts), asked, probe).where("rejection is null")
    scored = passed.withColumn("novelty", F.round(F.greatest(F.lit(0.0), 1.0 - F.col("similarity")), 6))
    return rank(scored, min(CONF["max_followups"], max(0, limit))).select(
        "question_id", "rank", "text", "followup", "question_type", "subject", "passage_id", "answerability", "novelty", "relevance", "ranking_score", "rule")


def funnel(gated: DataFrame) -> DataFrame:
    """Rejections by reason over all questions."""
    return gated.groupBy(F.coalesce("rejection", F.lit("PASSED")).alias("outcome")).agg(F.count(F.lit(1)).alias("count"))


def recommendation_report(graded: DataFrame) -> DataFrame:
    """Coverage, duplicate and off-topic rates and mean grade per relation.  ``graded``: ``question_id, relation, grade, duplicate, off_topic``."""
    return graded.groupBy("relation").agg(
        F.count_distinct("question_id").alias("questions"), F.count(F.lit(1)).alias("suggestions"), F.round(F.avg("grade"), 6).alias("mean_grade"),
        F.round(F.avg(F.col("duplicate").cast("int")), 6).alias("duplicate_rate"), F.round(F.avg(F.col("off_topic").cast("int")), 6).alias("off_topic_rate"))
