"""Column functions over titles and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from channel_signals.constants import (
    CLICKBAIT_PHRASES, DASHES, OPENING_TOKENS, VIETNAMESE_LETTERS,
)

# Java's \s and \w are ASCII, so the Unicode classes are spelled out.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
TOKEN = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}_]{2,}"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[^{SPACE}]+"))


def words(c: Column) -> Column:
    """Whitespace-separated words, lower-cased, punctuation kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"[^{SPACE}]+"), 0)


def tokens(c: Column, lang: str = "en") -> Column:
    """Word tokens: lower-cased, or in original case for Vietnamese syllables."""
    return F.regexp_extract_all(c if lang == "vi" else F.lower(c), F.lit(TOKEN), 0)


def term_tokens(c: Column) -> Column:
    """Lower-cased tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), 0)


def with_pairs(single: Column) -> Column:
    """Tokens followed by their adjacent pairs. `single` should be a plain column, so that
    its four uses do not extract it four times."""
    n = F.greatest(F.size(single) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(single, 1, n), F.slice(single, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(single, pairs)


def opening(toks: Column, n: int = OPENING_TOKENS) -> Column:
    """First n tokens joined by blanks, NULL when there is no token."""
    return F.when(F.size(toks) > 0, F.array_join(F.slice(toks, 1, n), " "))


def dash_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(DASHES))


def _class_count(c: Column, char_class: str) -> Column:
    """Characters of a class; dropping runs of the others beats matching one by one."""
    return F.length(F.regexp_replace(c, rf"[^{char_class}]+", ""))


def upper_share(c: Column) -> Column:
    """Share of upper-case among letters, NULL without letters."""
    return F.try_divide(_class_count(c, r"\p{Lu}").cast("double"), _class_count(c, r"\p{L}"))


def has_click_marker(c: Column) -> Column:
    return c.rlike(r"[?!]|\p{Nd}")


def click_phrase_pattern() -> str:
    """One alternation of all phrases; case-blind phrases stay case-blind. Those that begin at a
    word are tried together, and only where one of their first letters stands."""
    blind = r"(?i)\b"
    at_words = [p[len(blind):] for p in CLICKBAIT_PHRASES if p.startswith(blind) and p[len(blind)].isalpha()]
    rest = [p for p in CLICKBAIT_PHRASES if not (p.startswith(blind) and p[len(blind)].isalpha())]
    parts = [f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in rest]
    if at_words:
        letters = "".join(sorted({p[0] for p in at_words}))
        parts.insert(0, rf"(?i:(?=[{letters}])\b(?:{'|'.join(at_words)}))")
    return "|".join(parts)


def has_click_phrase(c: Column) -> Column:
    return c.rlike(click_phrase_pattern())


def vietnamese_letters(c: Column) -> Column:
    """None of the letters is ASCII, nor is any character an ASCII one becomes in lower case."""
    low = F.lower(F.regexp_replace(c, r"\p{ASCII}+", ""))
    return F.when(F.length(c) == F.octet_length(c), 0).otherwise(
        F.length(low) - F.length(F.translate(low, VIETNAMESE_LETTERS, "")))
