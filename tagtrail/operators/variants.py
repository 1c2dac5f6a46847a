"""Near strings by deletion variants, as 64-bit keys.

Two strings of lengths ``ls <= lr`` within Indel distance tau leave one and the
same string when the shorter loses (tau - lr + ls) / 2 characters and the longer
(tau + lr - ls) / 2. A class is a pair of lengths; the shorter string is its
index side, the longer its probe side, and strings of one length are both. Every
variant is a row (key, id), the key a hash of the variant, the two lengths and the
common part, with the side in its lowest bits. Rows of one key meet in one partition.

A probe side has up to C(n, lost) variants a string, of which next to none meets
an index row. A Bloom filter of the index keys, at most ``WORDS`` words for any
number of strings, drops the others where they are made, so what is shuffled
grows with the index rows and the pairs. The filter loses no key, and pairs of
equal keys are compared as strings by the caller, so neither it nor the hash
decides a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb, floor
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-9
DELETIONS = {2: 64, 3: 32, 4: 24}  # characters lost: longest string that is joined on its variants (2016, 4960, 10626 of them)
INDEX, PROBE, BOTH = 0, 1, 2  # sides of a class
OWN = 4  # bit of a key beside the side: the string is one of those that are asked about
LOW = 3  # bits of a key that hold these
WORDS = 1 << 22  # 64-bit words of the largest filter
CHUNK = 1 << 19  # variants made at once
ROWS = 2_000_000  # rows that a partition joins
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
M1, M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_PLACES: dict[tuple[int, int], np.ndarray] = {}


def tau(ls: int, lr: int, e: int, f: float) -> int:
    """Largest Indel distance of strings of these lengths after ``e`` equal characters: at most f * (ls + lr + 2e), with the parity of the sum."""
    total = ls + lr + 2 * e
    t = floor(total * f + EPS)
    return t - (total - t) % 2


def by_deletion(lost: int, lr: int) -> bool:
    """Whether pairs are found by deletion variants, ``lost`` of the longer string's ``lr`` characters; the others by segments."""
    return lost <= 1 or lr <= DELETIONS.get(lost, 0)


def classes(n: int, e: int, f: float) -> list[tuple[int, int, int, int]]:
    """(side, ls, lr, characters lost) of each class that a string of length ``n`` stands in."""
    out = []
    reach = 2 * max(DELETIONS)  # lengths of a class differ by no more than it loses
    for other in range(max(1, n - reach), n + reach + 1) if n else ():
        ls, lr = min(n, other), max(n, other)
        t = tau(ls, lr, e, f)
        if t < 1 or lr - ls > t or not by_deletion((t + lr - ls) // 2, lr):
            continue
        out.append((BOTH, ls, lr, t // 2) if ls == lr else (INDEX, ls, lr, (t - lr + ls) // 2) if n == ls else (PROBE, ls, lr, (t + lr - ls) // 2))
    return out


def n_rows(n: int, e: int, f: float, sides: tuple[int, ...]) -> int:
    """Rows of a string of length ``n`` on these sides."""
    return sum(comb(n, lost) for side, _, _, lost in classes(n, e, f) if side in sides)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(M2)
    return x ^ (x >> np.uint64(31))


def _places(n: int, lost: int) -> np.ndarray:
    """Row t: the t-th lost position of each choice of ``lost`` among ``n``."""
    if (n, lost) not in _PLACES:
        _PLACES[n, lost] = np.array(list(combinations(range(n), lost)), np.int64).reshape(-1, lost).T.copy()
    return _PLACES[n, lost]


def _hashes(chars: np.ndarray, lost: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Hash of every variant (columns) of every string (rows) of one length, and which variants count: of equal
    neighbours the first is lost."""
    n = chars.shape[1]
    c = mix(chars.astype(np.uint64) + np.uint64(BASE))
    # a character with d lost ones behind it weighs BASE ** (n - 1 - d - its position)
    sums = []
    for d in range(lost + 1):
        weight = np.array([pow(BASE, n - 1 - d - j, 1 << 64) for j in range(n)], np.uint64)
        sums.append(np.concatenate([np.zeros((len(c), 1), np.uint64), np.cumsum(c * weight, axis=1, dtype=np.uint64)], axis=1))
    h = sums[0][:, -1:]
    if not lost:
        return h, None
    again = np.concatenate([np.zeros((len(c), 1), bool), chars[:, 1:] == chars[:, :-1]], axis=1)
    places, counts = _places(n, lost), None
    for t, at in enumerate(places):
        h = h + (sums[lost - t][:, :-1] - sums[lost - t - 1][:, 1:])[:, at]
        skipped = again[:, at]
        if t:
            skipped &= places[t - 1] != at - 1
        counts = ~skipped if counts is None else counts & ~skipped
    return h, counts


def _chars(strings: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)


def variant_keys(batch: pa.RecordBatch, f: float, wanted: Callable[[bool], tuple[int, ...]], passes: Filter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, ids) of the strings (id, g, e, s, own) of a batch on the sides ``wanted(own)``, of the keys that pass."""
    ids, common, e, strings, own = (batch.column(c) for c in ("id", "g", "e", "s", "own"))
    ids, common, strings = ids.to_numpy(zero_copy_only=False), common.to_pylist(), strings.to_pylist()
    kinds: dict[tuple[int, int, bool], list[int]] = {}
    for i, kind in enumerate(zip(map(len, strings), e.to_pylist(), own.to_pylist())):
        kinds.setdefault(kind, []).append(i)
    for (n, equal, mine), rows in kinds.items():
        sides = wanted(mine)
        made = [c for c in classes(n, equal, f) if c[0] in sides]
        for lost in sorted({c[3] for c in made}):
            step = max(1, CHUNK // max(n, comb(n, lost)))
            for some in (rows[at : at + step] for at in range(0, len(rows), step)):
                h, counts = _hashes(_chars([strings[i] for i in some], n), lost)
                h = h ^ (np.array([crc32(common[i].encode("utf-8", "surrogatepass")) for i in some], np.uint64)[:, None] * np.uint64(M2))
                who = np.broadcast_to(ids[some][:, None], h.shape)
                who, h = (who.ravel(), h.ravel()) if counts is None else (who[counts], h[counts])
                for side, ls, lr, _ in (c for c in made if c[3] == lost):
                    keys, have = mix(h + np.uint64(((ls << 32) + lr + 1) * M1 & MASK)), who
                    keys = (keys & np.uint64(MASK << LOW & MASK)) | np.uint64(side | OWN * mine)
                    if passes is not None and (mine, side) not in passes.free:
                        kept = passes(keys)
                        keys, have = keys[kept], have[kept]
                    yield keys, have


def _gathered(made: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of ``made``, about CHUNK at a time."""
    rows, size = [], 0
    for r in made:
        rows, size = [*rows, r], size + len(r[0])
        if size >= CHUNK:
            yield tuple(map(np.concatenate, zip(*rows)))
            rows, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*rows)))


class Filter:
    """Bloom filter with three bits of one word for a key; ``free``: (own, side) of the rows that pass without it."""

    def __init__(self, words, free: set[tuple[bool, int]]):
        self.words, self.free = words, free

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        words = self.words.value
        bits = word_bits(keys)
        return words[word_of(keys, len(words))] & bits == bits


def word_of(keys: np.ndarray, n_words: int) -> np.ndarray:
    """Number of a key's word among ``n_words``, a power of two."""
    return keys >> np.uint64(65 - n_words.bit_length())


def word_bits(keys: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    return (one << (keys >> np.uint64(LOW) & low)) | (one << (keys >> np.uint64(LOW + 6) & low)) | (one << (keys >> np.uint64(LOW + 12) & low))


def pairs_of_keys(keys: np.ndarray, ids: np.ndarray, asked: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids whose keys are equal, of an index and a probe row or of two rows of side both; if ``asked`` of an
    own row and any other."""
    order = np.argsort(keys & np.uint64(MASK ^ OWN))  # by key, then by side
    keys, ids = keys[order], ids[order]
    side, text = keys & np.uint64(3), keys >> np.uint64(LOW)
    start = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    size = np.diff(np.append(start, len(keys)))
    indexes = np.repeat(np.add.reduceat((side == INDEX).astype(np.int64), start), size)
    first = np.repeat(start, size)
    # a probe row meets the index rows, which begin its run; a row of side both all rows before it
    met = np.where(side == PROBE, indexes, np.where(side == BOTH, np.arange(len(keys)) - first, 0))
    y = np.repeat(np.arange(len(keys)), met)
    x = np.repeat(first, met) + np.arange(len(y)) - np.repeat(np.cumsum(met) - met, met)
    kept = ids[x] != ids[y]
    if asked:
        kept &= ((keys[x] | keys[y]) & np.uint64(OWN)) > 0
    a, b = ids[x[kept]], ids[y[kept]]
    return np.minimum(a, b), np.maximum(a, b)


def variant_pairs(strings: DataFrame, f: float, asked: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of ``strings`` (id, g, e, s, own) with equal ``g`` that are found by deletion variants,
    some of them more than once; if ``asked`` only pairs with a row that is ``own``."""
    spark = strings.sparkSession
    sizes = strings.groupBy(F.length("s").alias("n"), "e", "own").agg(F.count(F.lit(1)).alias("k")).collect()  # a row for each length
    # whose keys the filter holds, and who passes without it
    hashed = {(True, s) for s in (INDEX, PROBE, BOTH)} if asked else {(own, INDEX) for own in (True, False)}
    free = hashed if asked else hashed | {(own, BOTH) for own in (True, False)}

    def total(rows: set[tuple[bool, int]]) -> int:
        return sum(r.k * n_rows(r.n, r.e, f, tuple(s for own, s in rows if own == r.own)) for r in sizes)

    n_words = min(WORDS, 1 << max(10, (total(hashed) // 4).bit_length()))

    def filter_words(batches):
        for batch in batches:
            for keys, _ in _gathered(variant_keys(batch, f, lambda mine: tuple(s for own, s in hashed if own == mine))):
                yield pa.record_batch({"word": word_of(keys, n_words).astype(np.int32), "bits": word_bits(keys).view(np.int64)})

    found = strings.mapInArrow(filter_words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n_words, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    passes = Filter(spark.sparkContext.broadcast(words), free)

    def rows(batches):
        for batch in batches:
            for keys, ids in _gathered(variant_keys(batch, f, lambda mine: (INDEX, PROBE, BOTH), passes)):
                yield pa.record_batch({"key": keys.view(np.int64), "id": ids})

    def join(batches):
        got = [(b.column("key").to_numpy().view(np.uint64), b.column("id").to_numpy(zero_copy_only=False)) for b in batches]
        if sum(len(keys) for keys, _ in got):
            a, b = pairs_of_keys(*map(np.concatenate, zip(*got)), asked)
            for at in range(0, len(a), CHUNK):
                yield pa.record_batch({"a": a[at : at + CHUNK], "b": b[at : at + CHUNK]})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total(free) // ROWS))
    kind = strings.schema["id"].dataType.simpleString()
    made = strings.mapInArrow(rows, f"key long, id {kind}")
    return made.repartition(parts, F.shiftright("key", LOW)).mapInArrow(join, f"a {kind}, b {kind}")
