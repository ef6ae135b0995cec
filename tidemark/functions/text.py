"""Text functions as Column expressions.

Three rules of matching a term are in use: as the beginning of a word
(``prefix``), as a whole word (``whole``), anywhere (``contains``).  A word's
characters are letters and digits of any script, and the underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import py_round

WORD_CHAR = r"[\p{L}\p{N}_]"
BEGIN, END = rf"(?<!{WORD_CHAR})", rf"(?!{WORD_CHAR})"


def java(term: str) -> str:
    """A term as a pattern that matches it literally."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def _any(terms: Iterable[str]) -> str:
    return "(?:" + "|".join(map(java, terms)) + ")"


def has_prefix(low: Column, terms: Iterable[str]) -> Column:
    terms = tuple(terms)
    return low.rlike(BEGIN + _any(terms)) if terms else F.lit(False)


def has_whole(low: Column, terms: Iterable[str]) -> Column:
    terms = tuple(terms)
    return low.rlike(BEGIN + _any(terms) + END) if terms else F.lit(False)


def has_anywhere(low: Column, terms: Iterable[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t))
    return out


def squeeze(s: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def join_lines(lines: Column) -> Column:
    """Wrapped lines to one text; words broken with a hyphen at a line's end are put together."""
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.regexp_replace(F.array_join(kept, " "), r"(?U)(\w)[-‐­]\s+(\w)", "$1$2")


def sentences(text: Column) -> Column:
    """Split after . ! or ? before white space and a capital or digit; pieces trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])", -1), lambda x: F.trim(x)), lambda x: x != "")


def looks_like_sentence(s: Column) -> Column:
    return s.rlike(r"(?s)^[\p{Lu}\p{Nd}].*[.!?]\s*$")


#: Fixed patterns: cross references and addresses, rows of a table of contents, a footnote's mark.
CROSS_REFERENCE = (
    r"(?iu)\b(?:read|find|see|learn|review|more)\b[^.]{0,40}\b(?:on |at |in )?(?:pages?|section|chapter|appendix|table|figure|report)\b"
    r"|\bpages?\s+\d+|\b(?:www\.|https?://|[\w.-]+\.com/)|\bsee\s+(?:the\s+)?\w+\s+(?:report|statement|policy)\b"
)
DOT_LEADER = r"(?:\.\s*){4,}|\.{4,}|(?:·\s*){4,}|(?:…){2,}"
FOOTNOTE = r"^\s*(?:\(?\d{1,2}[).\]]|\*+|[†‡¶])\s+"


def navigational(s: Column) -> Column:
    return s.rlike(CROSS_REFERENCE) | s.rlike(DOT_LEADER)


def without_footnote_mark(s: Column) -> Column:
    return F.regexp_replace(s, FOOTNOTE, "")


def words(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("[A-Za-z][A-Za-z'-]*"), 0)


def syllables(word: Column) -> Column:
    """Groups of vowels, without any e at the end; one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.rtrim(F.lower(word), F.lit("e")), F.lit("[aeiouy]+")))


def reading_ease(s: Column) -> Column:
    """Flesch's, to one digit; null with fewer than three words."""
    w = words(s)
    n = F.size(w)
    ends = F.greatest(F.lit(1), F.regexp_count(s, F.lit("[.!?]")))
    total = F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x))
    return F.when(n >= 3, py_round(F.lit(206.835) - F.lit(1.015) * (n / ends) - F.lit(84.6) * (total / n), 1))


def prefix_hits(low: Column, terms: Iterable[str]) -> Column:
    """Each term's hits at words' beginnings, added up: a place may count for several terms.

    Terms of which none begins another share one pattern, which looks ahead
    and takes nothing, so hits may overlap; a term that another one begins
    goes to the next pattern.
    """
    layers: list[list[str]] = []
    for t in sorted(terms, key=len):
        for layer in layers:
            if not any(t.startswith(o) for o in layer):
                layer.append(t)
                break
        else:
            layers.append([t])
    out = F.lit(0)
    for layer in layers:
        out = out + F.regexp_count(low, F.lit(f"{BEGIN}(?={_any(layer)})"))
    return out


def lexicon_ratio(low: Column, terms: Iterable[str], n_words: Column) -> Column:
    """Hits per word, to four digits; 0 without words."""
    return F.when(n_words > 0, py_round(prefix_hits(low, terms) / n_words, 4)).otherwise(F.lit(0.0))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")
