"""SQL text snippets that mirror the column functions, for DuckDB."""

from __future__ import annotations

from askweave.functions import fixed
from askweave.functions.text import SPACES, fold_table

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
CUT = "chr(31)"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strs(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


_ACCENTED, _BASE = fold_table()
_SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in SPACES) + ")"


def fold(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), {q(_ACCENTED)}, {q(_BASE)}), '\\p{{Mn}}', '', 'g')"


def fold_keep(x: str) -> str:
    return f"translate(lower({x}), {q(_ACCENTED + 'ß')}, {q(_BASE + 's')})"


def fold_case(x: str) -> str:
    return f"replace({fold(x)}, 'ß', 'ss')"


def words(x: str, percent: bool = True) -> str:
    cls = r"[\p{L}\p{N}_%]+" if percent else r"[\p{L}\p{N}_]+"
    return f"regexp_extract_all({x}, '{cls}')"


def raw_tokens(x: str) -> str:
    return words(fold(x))


def tokenize(x: str) -> str:
    return f"list_filter({raw_tokens(x)}, lambda t: length(t) > 1 AND t NOT IN {strs(fixed.STOPWORDS)})"


def fold_words(x: str, percent: bool = True) -> str:
    return f"array_to_string({words(fold_case(x), percent)}, ' ')"


def strip(x: str) -> str:
    return f"trim({x}, {_SPACES})"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def nfc(x: str) -> str:
    return f"nfc_normalize({x})"


def normalize_answer(x: str) -> str:
    inner = casefold(nfc(f"coalesce({x}, '')"))
    return squeeze(f"regexp_replace({inner}, '[\\p{{P}}_]', ' ', 'g')")


def split_words(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, ' ') END"


def place_accents(x: str) -> str:
    for old, new in fixed.ACCENT_PLACEMENT:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def clean_html(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"
    x = squeeze(place_accents(nfc(x)))
    return f"regexp_replace({x}, '{WS}+([,.:?!;])', '\\1', 'g')"


_SHORT = "|".join(a.replace(".", r"\.") for a in fixed.ABBREVIATIONS) + r"|[^\s\p{Z}]|[0-9]+"


def proposed_pieces(x: str) -> str:
    """Pieces between proposed sentence cuts, before cuts behind abbreviations are undone."""
    clean = strip(f"translate({x}, {CUT}, ' ')")
    clean = f"regexp_replace({clean}, '[ \\t]+', ' ', 'g')"
    # RE2 has no look-ahead: the following character is captured and put back.
    boundary = "([.!?…])[\"''”’)]*" + WS + "+([\"''“‘(]*[\\p{L}\\p{N}])"
    return (
        f"list_filter(string_split(regexp_replace({clean}, '{boundary}', '\\1' || {CUT} || '\\2', 'g'), {CUT}), "
        "lambda s: s <> '')"
    )


def split_sentences(x: str) -> str:
    """Sentences as a list; the previous piece decides whether a cut is undone."""
    return (
        f"(SELECT list_filter(string_split(array_to_string(list_transform(pcs, lambda s, i: "
        f"CASE WHEN i = 1 THEN s WHEN regexp_matches(pcs[i - 1], '(?i)(?:^|{WS})(?:{_SHORT})\\.$') "
        f"THEN ' ' || s ELSE {CUT} || s END), ''), {CUT}), lambda s: s <> '') "
        f"FROM (SELECT {proposed_pieces(x)} AS pcs))"
    )


def count_words(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({strip(x)}, '{WS}+')) END"
