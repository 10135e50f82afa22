"""The subject a question or a noun phrase is about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askweave.functions import fixed
from askweave.functions import text as T


def _through(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(x: Column) -> Column:
    return T.squeeze(T.fold_case(x))


def _folded_words(words: Column) -> Column:
    return F.transform(words, lambda w: F.btrim(_fold(w), F.lit(fixed.SUBJECT_WORD_STRIP)))


def _before_asking(words: Column, folded: Column) -> Column:
    """The words before the first asking phrase."""
    starts = lambda i: F.lit(False)
    for phrase in fixed.ASKING_WORDS:
        starts = lambda i, p=phrase, s=starts: s(i) | (F.array_join(F.slice(folded, i + 1, F.lit(len(p.split()))), " ") == p)
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: starts(i))
    return F.slice(words, F.lit(1), F.coalesce(F.get(places, F.lit(0)), F.size(words)))


def _content(x: Column) -> Column:
    return F.filter(T.words(T.fold_case(x), T.WORD_PERCENT), lambda t: (F.length(t) > 1) & ~t.isin(fixed.FOLLOWUP_STOPWORDS))


def clean_subject(value: Column) -> Column:
    """A subject without its asking phrase and outer punctuation; null where it is blank, too long, or names nothing."""
    clean = F.btrim(T.squeeze(F.coalesce(value, F.lit(""))), F.lit(fixed.SUBJECT_STRIP))
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))
    cut = _through(words, lambda w: _through(_folded_words(w), lambda f: F.when(F.size(w) > 0, F.btrim(F.array_join(_before_asking(w, f), " "), F.lit(fixed.SUBJECT_STRIP))).otherwise("")))
    return _through(cut, lambda s: F.when((s != "") & (F.length(s) <= fixed.SUBJECT_MOST) & ~_fold(s).isin(fixed.WEAK_SUBJECTS) & (F.size(_content(s)) > 0), s))


def focus_subject(value: Column) -> Column:
    """A cleaned subject without a leading frame such as "the role of", where something is left behind it."""
    def focused(subject: Column) -> Column:
        words = F.split(subject, " ")
        frame = F.array_join(_folded_words(F.slice(words, 1, 3)), " ")
        rest = clean_subject(F.array_join(F.slice(words, F.lit(4), F.size(words)), " "))
        return F.when(frame.isin(fixed.FOCUS_FRAMES), F.coalesce(rest, subject)).otherwise(subject)

    return _through(clean_subject(value), lambda s: F.when(s.isNotNull(), focused(s)))


def infer_subject(question: Column) -> Column:
    """The subject that a question's form gives away, in folded letters; the first fitting form decides."""
    def first(folded: Column) -> Column:
        found = F.lit(None).cast("string")
        for pattern in reversed(fixed.SUBJECT_PATTERNS):
            found = F.when(folded.rlike(pattern), F.regexp_extract(folded, pattern, 1)).otherwise(found)
        return found

    folded = F.btrim(_fold(F.coalesce(question, F.lit(""))), F.lit(" ?!.,;:"))
    return _through(_through(folded, first), lambda s: F.when(s.isNotNull(), clean_subject(s)))


def subject_of(subject: Column, question: Column) -> Column:
    """The focus of the parsed subject; without one, what the question gives away."""
    return F.coalesce(focus_subject(subject), infer_subject(question))
