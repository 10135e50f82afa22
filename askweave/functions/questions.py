"""Question understanding as columns: types, relations, subject / predicate / target, titles.

Rules are matched on folded text.  Where a piece of the question has to be
returned in its original spelling, the match is made on the length-preserving
fold and the offsets are applied to the original text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askweave.functions import fixed
from askweave.functions import text as T

_TRAIL = r"(?U)\s*[?!.]*$"


def has(x: Column, pattern: str) -> Column:
    return x.rlike("(?U)" + pattern)


def has_any(x: Column, patterns: list[str]) -> Column:
    return has(x, "|".join(patterns))


def has_term(x: Column, terms: list[str]) -> Column:
    return has(x, r"\b(?:" + "|".join(terms) + r")\b")


def cases(pairs: list[tuple[Column, object]], otherwise: object) -> Column:
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def kept(pairs: list[tuple[Column, object]]) -> Column:
    """Array of the values whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]))


def question_class(x: Column) -> Column:
    lower = F.lower(x)
    return cases(
        [(has(lower, rf"\b(?:{words})\b"), name) for name, words in fixed.QUESTION_CLASSES],
        fixed.QUESTION_CLASS_OTHER,
    )


def weak_bucket(folded: Column) -> Column:
    return cases([(has(folded, p), name) for name, p in fixed.WEAK_BUCKETS], "GENERAL")


def question_types(folded: Column, classifier: Callable[[Column], Column] | None = None) -> Column:
    """Types of a question; causal wording is GENERAL, otherwise every matching type.

    ``classifier`` (column to array of types) is asked only when no rule matches.
    """
    found = kept([(has_any(folded, patterns), name) for name, patterns in fixed.TYPE_PATTERNS.items()])
    general = F.array(F.lit("GENERAL"))
    fallback = classifier(folded) if classifier else general
    return F.when(has(folded, fixed.CAUSE_TYPE_PATTERN), general).when(F.size(found) > 0, found).otherwise(fallback)


def coarse_relation(folded: Column, types: Column) -> Column:
    pairs = [(has(folded, p), name) for name, p in fixed.COARSE_RELATIONS]
    pairs[-1] = (pairs[-1][0] | F.array_contains(types, "DEFINITION"), "DEFINITION")
    return cases(pairs, "FACTOID")


def relation_bucket(relation: Column, types: Column | None = None) -> Column:
    entity = relation.isin("IDENTITY", "ATTRIBUTE", "CONTRAST")
    if types is not None:
        entity = entity | F.arrays_overlap(types, F.array(F.lit("ENTITY"), F.lit("PERSON")))
    rest = F.lit("GENERAL") if types is not None else relation
    return (
        F.when(relation.isin("BIRTH_TIME", "DEATH_TIME", "EVENT_TIME"), "TIME")
        .when(relation.endswith("_LOCATION"), "LOCATION")
        .when(relation.isin("CAUSE", "PURPOSE", "DEFINITION"), relation)
        .when(entity, "ENTITY")
        .otherwise(rest)
    )


def surface(text: Column, start: Column, end: Column) -> Column:
    """Trimmed slice [start, end) of the original text; null when nothing is left."""
    piece = F.substring(text, start + 1, end - start)
    piece = F.rtrim(F.ltrim(piece, F.lit(T.SPACES + ",;:-")), F.lit(T.SPACES + "?!.,;:"))
    return F.nullif(piece, F.lit(""))


def _body(text: Column, folded: Column, patterns: list[tuple[str, bool]]) -> Column:
    """Original spelling of group 1 of the first matching pattern.

    Each pattern is anchored on both sides, so the group either starts the text
    (``leading``) or ends it up to closing punctuation; its offset follows.
    """
    core = F.length(F.regexp_replace(folded, _TRAIL, ""))
    out = F.lit(None).cast("string")
    for pattern, leading in reversed(patterns):
        found = F.regexp_extract(folded, "(?U)" + pattern, 1)
        start = F.lit(0) if leading else core - F.length(found)
        out = F.when(found != "", surface(text, start, start + F.length(found))).otherwise(out)
    return out


def _is_leading(pattern: str) -> bool:
    return pattern.startswith("^(.+?)")


def cause_body(text: Column, folded: Column) -> Column:
    return _body(text, folded, [(p, _is_leading(p)) for p in fixed.CAUSE_BODY_PATTERNS])


def cause_target(text: Column, folded: Column) -> Column:
    return _body(text, folded, [(p, _is_leading(p)) for p in fixed.CAUSE_TARGET_PATTERNS])


def _without_tail(text: Column, folded: Column, relation: Column) -> Column:
    length = F.length(text)
    pairs = []
    for name, tails in fixed.INTERROGATIVE_TAILS.items():
        ends = [F.length(F.regexp_replace(folded, "(?U)" + t, "")) for t in tails]
        pairs.append((relation == name, F.least(length, *ends)))
    return F.btrim(F.substring(text, F.lit(1), cases(pairs, length)), F.lit(" ?!.,;:"))


_PREDICATE = "|".join(p for _, category, _, p in fixed.RULES if category == "predicate_boundary")
_MODIFIER = next(p for _, category, _, p in fixed.RULES if category == "predicate_modifier")
_PATTERN = {rule: pattern for rule, _, _, pattern in fixed.RULES}


def annotate_questions(df: DataFrame, column: str = "question", classifier=None) -> DataFrame:
    """Add ``types``, ``coarse_relation``, ``relation``, ``subject``, ``predicate``, ``target``,
    ``modifier`` and ``matched_rules`` for every question.

    Intermediate texts become columns of their own so that each fold is computed once.
    """
    df = df.withColumn("_q", T.strip(F.coalesce(F.col(column), F.lit("")))).withColumns(
        {"_fw": T.fold_words(F.col("_q")), "_fk": T.fold_keep_length(F.col("_q"))}
    )
    q, fk, fw = F.col("_q"), F.col("_fk"), F.col("_fw")
    df = df.withColumns({"_types": question_types(fw, classifier), "_cause": cause_body(q, fk)})
    types, cause = F.col("_types"), F.col("_cause")
    birth = has(fk, _PATTERN["TIME_BIRTH_MARKER"])
    time = F.array_contains(types, "TIME") | birth
    df = df.withColumn("coarse_relation", coarse_relation(fw, types))
    coarse = F.col("coarse_relation")
    relation = (
        F.when(cause.isNotNull(), "CAUSE")
        .when(birth | (F.array_contains(types, "TIME") & has(fk, fixed.TIME_BIRTH)), "BIRTH_TIME")
        .when(time & has(fk, fixed.TIME_DEATH), "DEATH_TIME")
        .when(time, "EVENT_TIME")
        .when(
            F.array_contains(types, "LOCATION"),
            cases([(has(fk, p), name) for name, p in fixed.LOCATION_RELATIONS], "GENERIC_LOCATION"),
        )
        .when(has(fk, _PATTERN["PURPOSE_INTERROGATIVE"]) | (coarse == "PURPOSE"), "PURPOSE")
        .when(coarse.isin("CONTRAST", "ATTRIBUTE"), coarse)
        .when(has(fk, _PATTERN["IDENTITY_INTERROGATIVE"]), "IDENTITY")
        .when(coarse == "DEFINITION", "DEFINITION")
        .otherwise("GENERAL")
    )
    df = df.withColumn("relation", relation)
    rel = F.col("relation")
    is_time = rel.isin("BIRTH_TIME", "DEATH_TIME", "EVENT_TIME")
    df = df.withColumn("types", F.when(is_time, F.array(F.lit("TIME"))).otherwise(types))
    nominal = F.regexp_extract(fk, "(?U)" + fixed.NOMINAL_TIME_SUBJECT, 1)
    nominal_start = F.length(F.regexp_extract(fk, r"(?U)^((?:nam sinh|ngay sinh)\s+cua\s+)", 1))
    defined = F.regexp_extract(fk, "(?U)" + fixed.DEFINITION_SUBJECT, 1)
    body = (
        F.when(rel == "CAUSE", cause)
        .when(is_time | rel.endswith("_LOCATION") | (rel == "PURPOSE"), _without_tail(q, fk, rel))
        .otherwise(F.btrim(q, F.lit(" ?!.")))
    )
    df = df.withColumns({
        "_body": body,
        "_nominal": F.when(is_time & (nominal != ""), surface(q, nominal_start, nominal_start + F.length(nominal))),
        "_defined": F.when(defined != "", surface(q, F.lit(0), F.length(defined))),
    }).withColumn("_fb", T.fold_keep_length(F.col("_body")))
    b, fb = F.col("_body"), F.col("_fb")
    at = F.regexp_instr(fb, F.lit("(?U)" + _PREDICATE)) - 1
    df = df.withColumn("_at", at).withColumn(
        "_end", F.col("_at") + F.length(F.regexp_extract(fb, "(?U)" + _PREDICATE, 0))
    )
    rest = F.substring(fb, F.col("_end") + 1, F.length(fb))
    df = df.withColumn("_mod", F.regexp_instr(rest, F.lit("(?U)" + _MODIFIER)) - 1)
    split = F.col("_at") > 0
    mod = F.when(F.col("_mod") >= 0, F.col("_end") + F.col("_mod"))
    parts = {
        "subject": F.when(split, surface(b, F.lit(0), F.col("_at"))).otherwise(F.nullif(T.strip(b), F.lit(""))),
        "predicate": F.when(split, surface(b, F.col("_at"), F.coalesce(mod, F.length(b)))),
        "modifier": F.when(split & mod.isNotNull(), surface(b, mod, F.length(b))),
    }
    by_name, definition = F.col("_nominal").isNotNull(), rel == "DEFINITION"
    matched_on = T.fold_keep_length(F.coalesce(cause, F.btrim(q, F.lit(" ?!.,;:"))))
    df = df.withColumn("_fm", matched_on)
    rules = kept([
        (has(F.col("_fk") if category == "question_relation" else F.col("_fm"), pattern), rule)
        for rule, category, _, pattern in fixed.RULES
    ])
    return df.withColumns({
        "subject": F.when(by_name, F.col("_nominal")).when(definition, F.col("_defined")).otherwise(parts["subject"]),
        "predicate": F.when(by_name, F.when(rel == "BIRTH_TIME", "sinh")).when(definition, "là")
        .otherwise(parts["predicate"]),
        "modifier": F.when(~by_name & ~definition, parts["modifier"]),
        "target": F.when(rel == "CAUSE", b),
        "matched_rules": rules,
    }).drop("_q", "_fw", "_fk", "_types", "_cause", "_body", "_nominal", "_defined", "_fb", "_at", "_end", "_mod", "_fm")


def definition_subject(folded: Column) -> Column:
    """Subject of a "what is / who is" question in folded form; empty when it is none."""
    core = F.btrim(folded, F.lit(" ?!."))
    subject = F.regexp_extract(
        core,
        r"(?U)^(?:cho biet\s+)?(.+?)\s+(?:la ai|la gi|co nghia la gi|duoc dinh nghia nhu the nao)$",
        1,
    )
    return T.squeeze(subject)


# --- source titles --------------------------------------------------------------

_YEARS = r"\b(?:1\d{3}|20\d{2})\b"
_TITLE_EDGE = " \t\r\n-–—,:;."
_PREDICATES = "là|có|được|từng|thuộc|nằm|sinh|mất|giữ|đảm nhiệm"
_NOT_ENTITY = r"(?iU)^(?:năm|ngày|tháng|sau|trước|khi|trong|tại|theo|đến|từ|có)\b"


def is_lifespan(x: Column) -> Column:
    """Two years plus a range mark, full dates or a life word."""
    x = T.squeeze(x)
    months = (F.regexp_count(F.lower(x), F.lit("năm")) >= 2) & F.lower(x).contains("tháng")
    return (F.regexp_count(x, F.lit("(?U)" + _YEARS)) >= 2) & (
        x.rlike("[–—-]") | months | x.rlike(r"(?iU)\b(?:sinh|mất|qua đời)\b")
    )


def clean_title(x: Column) -> Column:
    x = F.regexp_replace(T.squeeze(F.coalesce(x, F.lit(""))), r"^#{1,6}\s*", "")
    inner = F.regexp_extract(x, r"\s*\(([^()]*)\)\s*$", 1)
    x = F.when(is_lifespan(inner), F.regexp_replace(x, r"\s*\([^()]*\)\s*$", "")).otherwise(x)
    return F.btrim(x, F.lit(_TITLE_EDGE))


def _plausible(title: Column) -> Column:
    return (
        (title != "") & (T.count_words(title) <= 14) & (F.length(title) <= 100)
        & ~title.rlike(_NOT_ENTITY) & ~title.rlike(" (?:ông|bà|họ|nó)$")
    )


def add_source_titles(
    df: DataFrame, id_col: str, text_col: str, title_col: str | None = None, heading_col: str | None = None
) -> DataFrame:
    """Add ``title``: metadata, else an entity at the start, else the first sentence, else the id."""
    explicit = [F.nullif(clean_title(F.col(c)), F.lit("")) for c in (title_col, heading_col) if c]
    paren = r"(?iU)^([^()\n]{2,100}?)\s*\(([^()]{1,140})\)\s*.*$"
    verb = rf"(?iU)^(.{{2,100}}?)\s+(?:{_PREDICATES})\b"
    edge = F.lit(T.SPACES)
    df = df.withColumn("_clean", T.squeeze(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumns({
        "_lead": F.substring("_clean", 1, 360),
        "_first": F.regexp_extract("_clean", r"(?U)^(.*?[.!?…])\s", 1),
    })
    df = df.withColumn("_first", F.when(F.col("_first") == "", F.col("_clean")).otherwise(F.col("_first")))
    df = df.withColumns({
        "_life": clean_title(F.regexp_extract("_lead", paren, 1)),
        "_dates": F.regexp_extract("_lead", paren, 2),
        "_verb": clean_title(F.regexp_extract("_lead", verb, 1)),
        "_short": F.rtrim(F.regexp_replace(F.substring("_first", 1, 89), " [^ ]*$", ""), edge),
    })
    short = F.col("_short")
    opened = F.regexp_count(short, F.lit(r"\(")) > F.regexp_count(short, F.lit(r"\)"))
    before = F.rtrim(F.regexp_replace(short, r"\([^(]*$", ""), edge)
    df = df.withColumn("_short", F.when(opened & (before != ""), before).otherwise(short))
    by_sentence = F.when(F.length("_first") <= 88, clean_title(F.col("_first"))).otherwise(
        F.concat(clean_title(F.col("_short")), F.lit("…"))
    )
    return df.withColumn(
        "title",
        F.coalesce(
            *explicit,
            F.when(is_lifespan(F.col("_dates")) & _plausible(F.col("_life")), F.col("_life")),
            F.when(_plausible(F.col("_verb")), F.col("_verb")),
            F.nullif(by_sentence, F.lit("")),
            F.col(id_col).cast("string"),
        ),
    ).drop("_clean", "_lead", "_first", "_life", "_dates", "_verb", "_short")
