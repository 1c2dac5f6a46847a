"""String similarity scorers (G16, V3): Indel ratio, token-sort and token-set ratio.

Per-pair work is a small Python helper applied in Arrow batches; the
candidate pairs it sees come from the blocking join in ``operators.fuzzy``.
Scores follow the public fuzzy-matching convention: 100 * (1 - indel / (|a|+|b|)),
rounded half to even (Python ``round``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, one big-int
    step per character of ``b``)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def indel_ratio(a: str, b: str) -> int:
    total = len(a) + len(b)
    if total == 0:
        return 100
    dist = total - 2 * lcs_length(a, b)
    return int(round((1.0 - dist / total) * 100))


WORD = 64  # characters of a string whose positions fit the bits of a number


def _lcs_lengths(a: list[str], b: list[str], width: int) -> np.ndarray:
    """``lcs_length`` of many pairs of strings of 1 to ``width`` (8, 16, ... WORD) characters at once."""

    def chars(strings: list[str], pad: str) -> np.ndarray:
        text = "".join([s.ljust(width, pad) for s in strings]).encode("utf-32-le", "surrogatepass")
        return np.frombuffer(text, "<u4").reshape(-1, width).T.copy()

    # a row for each place; what is behind the end of a string matches nothing
    n, m = np.array([len(s) for s in a], np.uint64), np.array([len(s) for s in b])
    x, y = chars(a, " "), chars(b, " ")
    places = np.arange(width)[:, None]
    x[places >= n.astype(np.int64)], y[places >= m] = 0x110000, 0x110001
    full = np.uint64((1 << 64) - 1) >> (np.uint64(WORD) - n)
    v = full.copy()
    masks = np.zeros((len(a), 8), np.uint8)
    for j in range(width):
        masks[:, : width // 8] = np.packbits(x == y[j], axis=0, bitorder="little").T
        u = v & masks.view("<u8")[:, 0]
        v = ((v + u) | (v - u)) & full
    return n.astype(np.int64) - np.bitwise_count(v).astype(np.int64)


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``indel_ratio`` of many pairs."""
    size = np.array([[len(s) for s in a], [len(s) for s in b]], np.int64).reshape(2, -1)
    out = np.empty(len(a), np.int32)
    width = (size.max(axis=0) + 7) // 8 * 8
    width[(size.min(axis=0) == 0) | (width > WORD)] = 0
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        some = [a[i] for i in at.tolist()], [b[i] for i in at.tolist()]
        if w:
            total = size[:, at].sum(axis=0)
            out[at] = np.rint((1.0 - (total - 2 * _lcs_lengths(*some, w)) / total) * 100)
        else:
            out[at] = [indel_ratio(x, y) for x, y in zip(*some)]
    return out


def _ratio_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratios([x or "" for x in a], [x or "" for x in b]), dtype="int32")


ratio_udf = F.pandas_udf(_ratio_series, IntegerType())


def token_set_ratio(a: str, b: str) -> int:
    """Best ratio among the common words, the common words followed by the
    other words of ``a``, and by those of ``b``; ``a`` and ``b`` are strings of
    mode 'set'. A string without words scores 0, with itself too."""
    words_a, words_b = set(a.split()), set(b.split())
    if not words_a or not words_b:
        return 0
    common = sorted(words_a & words_b)
    shared = " ".join(common)
    whole_a, whole_b = " ".join(common + sorted(words_a - words_b)), " ".join(common + sorted(words_b - words_a))
    best = indel_ratio(whole_a, whole_b)
    return max(best, indel_ratio(shared, whole_a), indel_ratio(shared, whole_b)) if common else best


def _set_ratio_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


set_ratio_udf = F.pandas_udf(_set_ratio_series, IntegerType())


def process(s: str | Column) -> Column:
    """Default processing: ASCII only, lower case, non-alphanumerics to
    spaces, trimmed."""
    c = F.col(s) if isinstance(s, str) else s
    ascii_only = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(ascii_only), r"[^a-z0-9]", " "))


def _words(s: str | Column) -> Column:
    return F.filter(F.split(process(s), " "), lambda t: t != "")


def token_sort(s: str | Column) -> Column:
    """Processed string with its whitespace tokens sorted and re-joined."""
    return F.array_join(F.array_sort(_words(s)), " ")


def token_set(s: str | Column) -> Column:
    """Processed string with its distinct whitespace tokens sorted and re-joined."""
    return F.array_join(F.array_sort(F.array_distinct(_words(s))), " ")


def prepared(s: str | Column, mode: str) -> Column:
    """The string a mode compares: raw ('simple'), token-sorted ('sort') or its sorted distinct tokens ('set')."""
    if mode == "simple":
        return F.col(s) if isinstance(s, str) else s
    if mode == "sort":
        return token_sort(s)
    if mode == "set":
        return token_set(s)
    raise ValueError(f"mode {mode!r}: 'simple', 'sort' or 'set'")
