"""Text Column builders: bag of words, tag / word parsing, generation
cleaning, de-numbering. All JVM-side regex functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def english_bow(tags: str | Column) -> Column:
    """G1: tags -> words, split on Unicode whitespace (leading / trailing
    whitespace yields empty words, as Python's re.split does)."""
    return F.flatten(F.transform(_c(tags), lambda t: F.split(t, r"(?U)\s+", -1)))


def chinese_bow(tags: str | Column) -> Column:
    """Tags -> characters (code points)."""
    return F.flatten(
        F.transform(_c(tags), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "", -1)))
    )


def nested_bow(tag_lists: str | Column, fn=english_bow) -> Column:
    """Apply a bag-of-words builder to every list of a list of lists."""
    return F.transform(_c(tag_lists), lambda ts: fn(ts))


def drop_first_line(text: str | Column, strip_first: bool = False) -> Column:
    """The text after its first newline (text without newline stays).
    ``strip_first`` trims surrounding whitespace first (tag parsing does)."""
    t = F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "") if strip_first else _c(text)
    return F.regexp_replace(t, r"^[^\n]*\n", "")


def parse_tags(text: str | Column, exclude_inputs: bool = False) -> Column:
    """Lower-case, find every run of letters / hyphens / spaces between
    word boundaries, strip each (empty strings are kept)."""
    t = drop_first_line(text, strip_first=True) if exclude_inputs else _c(text)
    return F.transform(F.regexp_extract_all(F.lower(t), F.lit("(?U)" + C.TAG_PATTERN), 0), lambda x: F.trim(x))


def parse_words(text: str | Column, exclude_inputs: bool = False) -> Column:
    """Lower-cased words of two or more letters / hyphens."""
    t = drop_first_line(text) if exclude_inputs else _c(text)
    return F.regexp_extract_all(F.lower(t), F.lit(C.WORD_PATTERN), 0)


def clean_generation(text: str | Column) -> Column:
    """The part after the first '[/INST]' with chat markers removed
    (case-insensitive). Text without the marker gives ''."""
    out = F.split_part(_c(text), F.lit(C.INST_CLOSE), F.lit(2))
    for pat in C.GENERATION_MARKERS:
        out = F.regexp_replace(out, "(?iU)" + pat, "")
    return out


def denumber(text: str | Column) -> Column:
    """Remove every 'digits. ' (also inside tags)."""
    return F.regexp_replace(_c(text), r"\d+\. ", "")


def first_n(arr: str | Column, n: int | Column) -> Column:
    """First n elements."""
    return F.slice(_c(arr), 1, n if isinstance(n, Column) else F.lit(n))


def last_n(arr: str | Column, n: int) -> Column:
    """Last n elements (all when shorter; ``slice(a, -n, n)`` would give [])."""
    a = _c(arr)
    return F.slice(a, F.greatest(F.size(a) - F.lit(n) + 1, F.lit(1)), F.lit(n))
