"""Phrase collocations by Toivonen mining.

Frequent phrases (``min_count`` occurrences per language, 1 to ``max_words``
words) are found in three steps:

1. A sample of the documents (one in ``SAMPLE``, by a hash) proposes phrases:
   those that some task sees twice, down to a lowered threshold.
2. One full pass counts the proposed phrases and their negative border exactly:
   every phrase whose shorter parts were all proposed (single words always).
   No list of the border exists; a phrase is in it if both phrases one word
   shorter are marked.
3. A phrase of the border that turns out frequent is a failure of the sample. It
   is marked, and a further full pass counts the phrases that this brings into
   the border and that no pass counted before, until no frequent phrase is
   unmarked. Then nothing frequent is missing, whatever the sample was.

Marks are a bitmap of ``MARK_BITS`` hashed phrases, always 8 MB; hash collisions
can only add phrases to what is counted. Counting itself is exact: inside a
chunk words get local numbers, a phrase is the tuple of its numbers, and partial
counts leave a task as (lang, phrase, n) and are summed by the phrase itself.

Hot keys: a frequent phrase is reduced in its task before the shuffle and leaves
it once; the counts of single words, which stand at one end of many phrases, are
copied over ``SALTS`` keys where phrases look them up; each language's best rows
are taken in hashed parts first, so no task ranks a language as a whole. Long
texts are cut between words into runs that overlap by ``max_words - 1`` words.

Edge cases: a null or blank text has no words; a null lang is ``und``, and so is
a lang of that name; repeated rows count again; a null doc_id is a document; ties
are settled by count and phrase, so the result is one; phrases of fewer than
``min_count`` occurrences never appear; an empty table gives an empty result;
columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_batches

SAMPLE = 8
MARK_BITS = 1 << 26
CHUNK_WORDS = 1 << 20
RUN_BYTES = 1 << 22
READ_ROWS = 256
OUT_ROWS = 1 << 17
SALTS = 32
STOP = b"\xff"  # no UTF-8 text holds this byte
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + STOP * 10 + b" ")
HOT = 16  # phrases of so many occurrences in a chunk leave a task once, not once a chunk
HELD = 1 << 15
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of the phrases that begin with the phrases of hash ``h`` and end with the words of hash ``w``."""
    h = (h ^ (w + MIX)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def cell(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(MARK_BITS)).astype(np.int64)


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = cell(h)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def runs(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, A-Z lower-cased, with ``STOP`` between its pieces; long texts in runs cut at spaces."""
    flat = text.translate(PLAIN)
    at = 0
    while at < len(flat):
        end = len(flat)
        if end - at > RUN_BYTES:
            end = flat.find(b" ", at + RUN_BYTES)
            end = len(flat) if end < 0 else end
        yield flat[at:end].replace(STOP, b" \xff ").split()
        at = end


class Chunk:
    """Words of several texts as numbers, one number per (lang, word): 0 ends a piece; words repeated from the run
    before are ``carried``."""

    def __init__(self):
        self.numbers = count(1)
        self.vocab: dict[str, dict[bytes, int]] = {}
        self.ids, self.carried, self.size = [], [], 0

    def add(self, words: list[bytes], lang: str, carried: int) -> None:
        if lang not in self.vocab:
            self.vocab[lang] = defaultdict(self.numbers.__next__, {STOP: 0})
        ids = np.zeros(len(words) + 1, np.int64)
        ids[:-1] = np.fromiter(map(self.vocab[lang].__getitem__, words), np.int64, len(words))
        self.ids.append(ids)
        if carried:
            self.carried.append(np.arange(self.size, self.size + carried))
        self.size += len(ids)

    def finish(self) -> None:
        """ids, new (not carried), words, word_lang and word_hash by number."""
        self.ids = np.concatenate(self.ids)
        self.new = np.ones(self.size, bool)
        self.new[np.concatenate(self.carried) if self.carried else []] = False
        self.names = list(self.vocab)
        size = next(self.numbers)
        self.words, self.word_lang, self.word_hash = np.full(size, STOP, object), np.zeros(size, np.int32), np.zeros(size, np.uint64)
        for k, lang in enumerate(self.names):
            seed, known = lang_seed(lang), self.vocab[lang]
            del known[STOP]
            at = np.fromiter(known.values(), np.int64, len(known))
            self.words[at] = list(known)
            self.word_lang[at] = k
            self.word_hash[at] = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known), np.uint64, len(known))
        self.vocab = {}
        self.words = pa.array(self.words, pa.binary())


def chunks(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for at in range(0, batch.num_rows, READ_ROWS):
            part = batch.slice(at, READ_ROWS)
            for text, lang in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist()):
                tail: list[bytes] = []
                for words in runs(text):
                    chunk.add(tail + words, lang, len(tail))
                    tail = (tail + words)[1 - max_words :] if max_words > 1 else []
                    if chunk.size >= CHUNK_WORDS:
                        chunk.finish()
                        yield chunk
                        chunk = Chunk()
    if chunk.size:
        chunk.finish()
        yield chunk


def windows(chunk: Chunk, max_words: int, known) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (length, positions, their hashes, first layer of marks) of the phrases whose shorter parts are known.

    ``known(hashes)`` gives one row of booleans per layer of marks; a position takes part if its parts are known to
    the last layer, and ``first`` says whether the first layer knew them too."""
    total = chunk.size
    of_word = chunk.word_hash[chunk.ids]
    at = np.flatnonzero(chunk.ids)
    h, parts = of_word[at], None
    known_word = known(chunk.word_hash)
    for length in range(1, max_words + 1):
        yield length, at, h, np.zeros(len(at), bool) if parts is None else parts[0]
        if length == max_words or not len(at):
            return
        now = known_word[:, chunk.ids[at]] if parts is None else known(h) & parts  # a phrase is known only if its parts are
        inside = np.zeros((len(now), total + 1), bool)
        inside[:, at] = now
        both = inside[:, at] & inside[:, at + 1]
        keep = both[-1]
        at, h, parts = at[keep], h[keep], both[:, keep]
        h = mixed(h, of_word[at + length])


def counted(chunk: Chunk, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, one row per distinct phrase; counts) of the phrases that start at ``at``; exact."""
    at = at[chunk.new[at + length - 1]]
    base = len(chunk.words)
    code, heads = chunk.ids[at], []
    for k in range(1, length):
        if (int(code.max(initial=0)) + 1) * base >= 1 << 62:
            head, code = np.unique(code, return_inverse=True)
            heads.append((k, head))
        code = code * base + chunk.ids[at + k]
    code, n = np.unique(code, return_counts=True)
    columns = np.empty((len(code), length), np.int64)
    for k in range(length - 1, -1, -1):
        columns[:, k] = code % base if k else code
        code = code // base
        if heads and heads[-1][0] == k:
            code = heads.pop()[1][code]
    return columns, n


def proposals(docs: DataFrame, max_words: int) -> DataFrame:
    """(cell, n): hashed phrases, shorter than the longest, that a chunk of the sample holds twice or more."""

    def emit(batches):
        for chunk in chunks(batches, max_words):
            n = np.bincount(chunk.ids, minlength=len(chunk.words))
            n[0] = 0
            twice = [(chunk.word_hash[n > 1], n[n > 1])]

            def known(h, n=n, twice=twice):
                if h is chunk.word_hash:
                    return (n > 1)[None]
                one, back, m = np.unique(h, return_inverse=True, return_counts=True)
                twice.append((one[m > 1], m[m > 1]))
                return (m > 1)[back][None]

            for _ in windows(chunk, max_words, known):
                pass
            for h, n in twice:
                yield pa.RecordBatch.from_arrays([pa.array(cell(h)), pa.array(n)], names=["cell", "n"])

    return docs.select("text", "lang").mapInArrow(emit, "cell long, n long")


def exact_counts(docs: DataFrame, max_words: int, marks, past=None) -> DataFrame:
    """(lang, phrase, n) per chunk, of the phrases whose parts are marked and were not in the marks ``past``. Without
    ``past`` also of all single words, and the phrase '' with the number of words of a language."""

    def emit(batches):
        layers = [np.frombuffer(m.value, np.uint8) for m in (past, marks) if m is not None]

        def known(h):
            return np.stack([marked(bits, h) for bits in layers])

        held: Counter[tuple[str, bytes]] = Counter()

        def release():
            keys = list(held)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()), pa.array([held[k] for k in keys], pa.int64())], names=["lang", "phrase", "n"])
            held.clear()

        for chunk in chunks(batches, max_words):
            if len(held) > HELD:
                yield from release()
            for length, at, _, seen in windows(chunk, max_words, known):
                if past is not None:
                    at = at[~seen] if length > 1 else at[:0]
                columns, n = counted(chunk, at, length)
                often = n >= HOT
                for row, m in zip(columns[often].tolist(), n[often].tolist()):
                    held[chunk.names[chunk.word_lang[row[0]]], b" ".join(chunk.words[i].as_py() for i in row)] += m
                if length == 1 and past is None:
                    for k, m in enumerate(np.bincount(chunk.word_lang[columns[:, 0]], weights=n, minlength=len(chunk.names)).astype(np.int64).tolist()):
                        held[chunk.names[k], b""] += m
                columns, n = columns[~often], n[~often]
                lang = pa.DictionaryArray.from_arrays(chunk.word_lang[columns[:, 0]], chunk.names).cast(pa.string())
                for low in range(0, len(n), OUT_ROWS):
                    part = slice(low, low + OUT_ROWS)
                    phrase = pc.binary_join_element_wise(*(chunk.words.take(pa.array(c)) for c in columns[part].T), b" ")
                    yield pa.RecordBatch.from_arrays([lang[part], phrase.cast(pa.string()), pa.array(n[part])], names=["lang", "phrase", "n"])
        yield from release()

    return docs.select("text", "lang").mapInArrow(emit, "lang string, phrase string, n long")


def phrase_cells(phrases: DataFrame, max_words: int) -> DataFrame:
    """(cell) of the phrases of 1 to ``max_words`` - 1 words."""

    def cells(batches):
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = phrase.split(b" ")
                if phrase and len(words) < max_words:
                    h, *rest = (np.array([xxhash.xxh64_intdigest(w, lang_seed(lang))], np.uint64) for w in words)
                    for w in rest:
                        h = mixed(h, w)
                    out.append(int(cell(h)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["cell"])

    return phrases.select("lang", "phrase").mapInArrow(cells, "cell long")


def bitmap(cells: DataFrame) -> np.ndarray:
    """The cells as a bitmap; MARK_BITS / 64 rows at most reach the driver."""
    words = cells.groupBy(F.expr("cell div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("bits"))
    found = words.toArrow()
    out = np.zeros(MARK_BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def frequent_phrases(docs: DataFrame, max_words: int = 4, min_count: int = 30) -> DataFrame:
    """(lang, phrase, n) of every phrase of at least ``min_count`` occurrences; the phrase '' has a language's words."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    share = min_count / SAMPLE
    least = max(2, int(share - 1.5 * share**0.5))
    sample = proposals(rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0), max_words)
    marks, past, found = bitmap(sample.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)), None, None
    while True:
        new = context.broadcast(marks.tobytes())
        partial = exact_counts(rows, max_words, new, past)
        # chunks are combined already: a second hash table before the shuffle would only cost
        sums = partial.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | (F.col("phrase") == ""))
        sums = cut_lineage(sums, "phrase-counts")
        found = sums if found is None else found.unionByName(sums)
        more = bitmap(phrase_cells(sums, max_words))
        if past is not None:
            past.destroy()
        past = new
        if not (more & ~marks).any():
            past.destroy()
            return found
        marks = marks | more


def collocations(docs: DataFrame, max_words: int = 4, min_count: int = 30, top: int = 2000, shadow: tuple[int, int] = (80, 100), scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases of 2 to ``max_words`` words."""
    found = cut_lineage(frequent_phrases(docs, max_words, min_count), "frequent-phrases")
    total = found.where("phrase = ''").select("lang", F.col("n").alias("n"))  # one row per language
    words = F.split("phrase", " ", -1)
    freq = found.where("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    cand = freq.where(F.size("w") > 1)
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cand.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    salt = lambda p: F.when(F.instr(p, " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0)
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right"))
    cuts = cuts.withColumn("left_salt", salt(F.col("left"))).withColumn("right_salt", salt(F.col("right")))
    salts = F.when(F.size("w") == 1, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    lookup = freq.select("lang", F.col("phrase").alias("p"), F.col("a").alias("f"), F.explode(salts).alias("salt"))
    side = lambda name, f: lookup.select(F.col("lang"), F.col("p").alias(name), F.col("salt").alias(f"{name}_salt"), F.col("f").alias(f))
    cut = cuts.join(side("left", "l"), ["lang", "left", "left_salt"]).join(side("right", "r"), ["lang", "right", "right_salt"])
    score = F.expr(f"(cast({scale} as decimal(12,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    longer = cand.where(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    longer = longer.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("start"))
    within = longer.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longest"))
    wide = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by)
    kept = best.join(within, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (wide("longest", shadow[1]) < wide("a", shadow[0])))
    rows = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("deal"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return some.withColumn("rank", rank).where(F.col("rank") <= top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
