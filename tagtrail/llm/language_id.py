"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Training counts come from a bounded, documented sample (``max_docs_per_lang``
labelled documents of each language, chosen by a hash of the id), summed with
map-side combine; the log-probability matrix (``buckets`` x languages, checked
against ``MAX_MODEL_CELLS``) is broadcast, and every whole text becomes sparse
count rows that are multiplied with it in numpy, ``SCORE_CELLS`` products at once.

Edge cases: a null text, an empty text or one without a letter gives ``und``
with score 0; without a single labelled row every text gives ``und``; more
languages than one model may hold are an error; rows are
scored one by one, so repeated rows repeat their result; columns besides the
text are never read by the scorer and pass through; one that has the name of
the result is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import TEXT_BATCH_BYTES, no_clash, small_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PIECE = 1 << 16  # characters scored at once; longer texts are summed over pieces
MAX_MODEL_CELLS = 1 << 23
SCORE_CELLS = 1 << 18
READ_ROWS = 512
SMOOTHING = 0.1
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points; an ASCII character that is no letter counts as a space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plain = (cp < 128) & ~((cp >= 97) & (cp <= 122))
    return np.where(plain, np.uint32(32), cp)


def gram_buckets(cp: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position."""
    n = max(0, len(cp) - order + 1)
    h = np.full(n, order, dtype=np.uint64)
    for k in range(order):
        h = (h + cp[k : k + n].astype(np.uint64)) * MIX[k]
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)).astype(np.int64) & (buckets - 1)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts as one code point array with, per piece: the text's number,
    start, end, and the end of the positions where grams may start (long texts
    come as several pieces that overlap by the longest order)."""
    tail = max(ORDERS) - 1
    arrays, rows, caps, size = [], [], [], 0

    def flush():
        lens = np.array([len(a) for a in arrays])
        end = np.cumsum(lens)
        start = end - lens
        return np.concatenate(arrays), np.array(rows), start, end, np.minimum(end, start + np.array(caps))

    for i, t in enumerate(texts):
        cp = code_points(f" {t} ") if t else np.empty(0, np.uint32)
        for at in range(0, len(cp), PIECE):
            part = cp[at : at + PIECE + tail]
            arrays.append(part)
            rows.append(i)
            caps.append(PIECE if at + PIECE < len(cp) else len(part))
            size += len(part)
            if size >= PIECE:
                yield flush()
                arrays, rows, caps, size = [], [], [], 0
    if arrays:
        yield flush()


def training_sample(docs: DataFrame, max_docs_per_lang: int) -> DataFrame:
    """Labelled rows (text, lang): about ``max_docs_per_lang`` of each language at most, by a hash of the id."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = cut_lineage(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    if sizes.count() > MAX_MODEL_CELLS // BUCKETS:
        raise ValueError(f"more than {MAX_MODEL_CELLS // BUCKETS} languages: too many for one broadcast model")
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    return rows.join(F.broadcast(sizes), "lang").where(share < F.lit(float(max_docs_per_lang)) / F.col("n")).select("text", "lang")


def fit(docs: DataFrame, max_docs_per_lang: int = 3000) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix of BUCKETS + 1 rows; the last row holds the priors)."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for pdf in batches:
            langs = pdf["lang"].tolist()
            for lang in set(langs):
                texts = [t for t, x in zip(pdf["text"], langs) if x == lang]
                docs_of[lang] = docs_of.get(lang, 0) + len(texts)
                acc = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, bucket, n in gram_counts(texts):
                    np.add.at(acc, bucket, n)
        for lang, acc in total.items():
            at = np.flatnonzero(acc)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, BUCKETS), "n": np.append(acc[at], docs_of[lang])})

    small_batches(docs.sparkSession, TEXT_BATCH_BYTES)
    parts = training_sample(docs, max_docs_per_lang).mapInPandas(count, "lang string, bucket int, n long")
    cells = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = cells.toArrow()  # at most MAX_MODEL_CELLS + languages rows
    names = model["lang"].combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    column = np.array([langs.index(x) for x in names.dictionary.to_pylist()], dtype=np.int64)
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[model["bucket"].to_numpy(), column[names.indices.to_numpy()]] = model["n"].to_numpy()
    grams = counts[:BUCKETS] + SMOOTHING
    logp = np.log(grams / grams.sum(axis=0)) if langs else grams
    prior = np.log(counts[BUCKETS:] / counts[BUCKETS:].sum()) if langs else counts[BUCKETS:]
    return langs, np.vstack([logp, prior]).astype(np.float32)


def gram_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse count rows of runs of texts: (text number, bucket, occurrences), ordered by text; a long text comes in several runs."""
    for cp, rows, start, end, cap in pieces(texts):
        cells = []
        for n in ORDERS:
            size = np.maximum(0, np.minimum(cap, end - n + 1) - start)
            at = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
            cells.append(np.repeat(rows, size) * BUCKETS + gram_buckets(cp, n, BUCKETS)[at])
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        yield cell // BUCKETS, cell % BUCKETS, n


def log_likelihoods(texts: list[str | None], matrix: np.ndarray) -> np.ndarray:
    """Prior plus count row times log-probability matrix, one row per text; at most SCORE_CELLS products are held."""
    out = np.tile(matrix[BUCKETS].astype(np.float64), (len(texts), 1))
    step = max(1, SCORE_CELLS // max(1, matrix.shape[1]))
    for row, bucket, n in gram_counts(texts):
        for low in range(0, len(row), step):
            part = slice(low, low + step)
            mine = row[part]
            first = np.flatnonzero(np.diff(mine, prepend=-1))
            out[mine[first]] += np.add.reduceat(matrix[bucket[part]] * n[part, None].astype(np.float64), first, axis=0)
    return out


def predictor(spark, model: tuple[list[str], np.ndarray]):
    """A Column function text -> struct(lang_pred, score)."""
    langs, matrix = model
    small_batches(spark, TEXT_BATCH_BYTES)
    shared = spark.sparkContext.broadcast(matrix)
    names = np.array([*langs, "und"], dtype=object)

    def rate(texts: list[str | None]) -> pd.DataFrame:
        if not langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
        ll = log_likelihoods(texts, shared.value)
        best = ll.argmax(axis=1)
        top = ll[np.arange(len(ll)), best]
        score = 1.0 / np.exp(ll - top[:, None]).sum(axis=1)
        letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        return pd.DataFrame({"lang_pred": names[np.where(letters, best, len(langs))], "score": np.where(letters, score, 0.0)})

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            parts = [rate([t if isinstance(t, str) else None for t in text.iloc[low : low + READ_ROWS]]) for low in range(0, len(text), READ_ROWS)]
            yield pd.concat(parts, ignore_index=True) if parts else rate([])

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into`` (lang_pred, score); a column of that name in ``docs`` is an error."""
    no_clash(docs, into)
    return docs.withColumn(into, predictor(docs.sparkSession, model)(F.col(text)))
