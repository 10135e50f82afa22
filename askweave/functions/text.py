"""Text columns: folding, tokens, answer normalisation, HTML cleaning, sentences.

Every function takes and returns Spark columns and stays inside the JVM, so the
expressions can be pushed next to a scan and need no Python worker.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from askweave.functions import fixed

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
SPACES = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
WORD = r"[\p{L}\p{N}_]"
WORD_PERCENT = r"[\p{L}\p{N}_%]"


def _letters():
    """Basic-plane letters before the surrogates, without Hangul syllables."""
    for code in range(0xC0, 0x2000):
        char = chr(code)
        if unicodedata.category(char).startswith("L"):
            yield char


@lru_cache(None)
def fold_table() -> tuple[str, str]:
    """Rule-made pair (accented, base): lower-case letters with exactly one base letter."""
    accented, base = ["đ"], ["d"]
    for char in _letters():
        if char != char.lower():
            continue
        parts = unicodedata.normalize("NFD", char)
        rest = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(parts) > 1 and len(rest) == 1:
            accented.append(char)
            base.append(rest[0])
    return "".join(accented), "".join(base)


@lru_cache(None)
def compose_table() -> tuple[tuple[str, str], ...]:
    """Rule-made pairs (decomposed spelling, composed letter) for canonical composition."""
    pairs = {}
    for char in _letters():
        full = unicodedata.normalize("NFD", char)
        if len(full) == 1 or unicodedata.normalize("NFC", full) != char:
            continue
        spellings = {full}
        if len(full) == 3:
            spellings.add(full[0] + full[2] + full[1])
            for first, second in ((full[1], full[2]), (full[2], full[1])):
                half = unicodedata.normalize("NFC", full[0] + first)
                if len(half) == 1:
                    spellings.add(half + second)
        for spelling in spellings:
            if unicodedata.normalize("NFC", spelling) == char:
                pairs[spelling] = char
    return tuple(sorted(pairs.items()))


def _is_ascii(x: Column) -> Column:
    return F.octet_length(x) == F.length(x)


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def nfc(x: Column) -> Column:
    """Canonical composition; rows without combining marks take the identity branch."""
    # One foldable node instead of thousands of literals keeps planning fast.
    table = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in compose_table())), F.lit(","), F.lit(":"))
    composed = F.array_join(
        F.transform(
            F.regexp_extract_all(x, F.lit(r"(?s)\P{M}\p{M}*|\p{M}"), F.lit(0)),
            lambda g: F.coalesce(F.try_element_at(table, g), g),
        ),
        "",
    )
    return F.when(_is_ascii(x) | ~x.rlike(r"\p{M}"), x).otherwise(composed)


def fold(x: Column) -> Column:
    """Lower-cased, accent-free text (decomposed marks are dropped)."""
    accented, base = fold_table()
    rich = F.regexp_replace(F.translate(F.lower(x), accented, base), r"\p{Mn}", "")
    return F.when(_is_ascii(x), F.lower(x)).otherwise(rich)


def fold_keep_length(x: Column) -> Column:
    """Accent-free text with one output character per input character.

    Offsets found in the result can be used on the original text.
    """
    accented, base = fold_table()
    return F.when(_is_ascii(x), F.lower(x)).otherwise(
        F.translate(F.lower(x), accented + "ß", base + "s")
    )


def fold_case(x: Column) -> Column:
    """Like :func:`fold` but with full case folding (ß becomes ss)."""
    return F.replace(fold(x), F.lit("ß"), F.lit("ss"))


def words(x: Column, pattern: str = WORD_PERCENT) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern + "+"), F.lit(0))


def raw_tokens(x: Column) -> Column:
    return words(fold(x))


def content_only(tokens: Column) -> Column:
    """Tokens longer than one character that are not stop words."""
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(fixed.STOPWORDS))


def tokenize(x: Column) -> Column:
    return content_only(raw_tokens(x))


def fold_words(x: Column, percent: bool = True) -> Column:
    """Folded word sequence joined by single blanks; the form all question rules match on."""
    return F.array_join(words(fold_case(x), WORD_PERCENT if percent else WORD), " ")


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, WS + "+", " "))


def strip(x: Column, chars: str = SPACES) -> Column:
    return F.btrim(x, F.lit(chars))


def normalize_answer(x: Column) -> Column:
    """Comparison form of an answer: composed, case-folded, punctuation to blanks, squeezed."""
    plain = F.regexp_replace(casefold(nfc(F.coalesce(x, F.lit("")))), r"[\p{P}_]", " ")
    return squeeze(plain)


def split_words(x: Column) -> Column:
    """Blank-separated words of an already squeezed text; empty text gives an empty array."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " "))


def normalize_feedback(x: Column) -> Column:
    return casefold(squeeze(nfc(F.coalesce(x, F.lit("")))))


def normalize_offline(x: Column) -> Column:
    return squeeze(nfc(x))


def place_accents(x: Column, legacy: bool = False) -> Column:
    """Move tone marks to their current position; ``legacy`` keeps the transposed entries."""
    for old, new in fixed.ACCENT_PLACEMENT:
        if legacy:
            new = fixed.LEGACY_ACCENTS.get(old, new)
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def clean_html(x: Column, legacy_accents: bool = False) -> Column:
    """Markup, scripts and control characters out; composed text; tidy blanks and punctuation."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    x = place_accents(nfc(x), legacy_accents)
    return F.regexp_replace(squeeze(x), WS + r"+([,.:?!;])", "$1")


# --- sentences -----------------------------------------------------------------

CUT = "\u001f"
_BOUNDARY = rf"([.!?…])[\"'”’)]*{WS}+(?=[\"'“‘(]*[\p{{L}}\p{{N}}])"
_SHORT = "|".join(a.replace(".", r"\.") for a in fixed.ABBREVIATIONS) + r"|[^\s\p{Z}\x1c-\x1f]|[0-9]{1,18}"
_FALSE_CUT = rf"(?i)\.{CUT}(?<=(?:^|{WS})(?:{_SHORT})\.{CUT})"


def split_sentences(x: Column) -> Column:
    """Sentences of a text.

    Cuts are marked first; a cut behind an abbreviation, a single character or
    a number with a full stop is then taken back.  Both steps are one pass.
    """
    clean = F.regexp_replace(strip(F.translate(x, CUT, " ")), r"[ \t]+", " ")
    marked = F.regexp_replace(clean, _BOUNDARY, "$1" + CUT)
    return F.filter(F.split(F.regexp_replace(marked, _FALSE_CUT, ". "), CUT), lambda s: s != "")


def count_words(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[^\s\p{Z}\x0b\x1c-\x1f\x85]+"))
