"""Quality classifier: Bradley-Terry pairwise ranking.

Every labelled document is learned from. Documents are dealt to blocks of about
``BLOCK`` by a hash of their id; within a block every good document is preferred
to every bad one, and logistic loss on the feature differences of all those
pairs, summed over all blocks, gives one weight per feature, so a document's
strength is a dot product. A label too rare to meet every block is copied to
several, so no document of the other label is left without a pair. The loss is
minimised by Newton steps: a pass over the written blocks adds up loss, gradient
and second derivatives as integers, so the model does not depend on
partitioning, and only ``FAN`` such sums reach the driver. The cut is the
quantile of all labelled documents' strengths that leaves as many above it as
are labelled good; strengths map monotonically to (0, 1) with the cut at
``THRESHOLD``.

Edge cases: a null text counts as empty and is scored like an empty one;
labels that are null are ignored, several labels of one document are
averaged; of several texts with one doc_id the one with the smallest hash is
learned from; without labels of both kinds every strength is equal and every score
equals ``THRESHOLD``; repeated rows repeat their result; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import dense_index
from ..session import cut_lineage, scratch_path
from .common import no_clash, small_batches, small_side

THRESHOLD = 0.3
SHAPES = 1 << 9
PIECE = 1 << 18
NAMED = 22
N_FEATURES = NAMED + SHAPES
BLOCK = 1024  # labelled documents of a block
LEAST = 64  # documents of either label that a block should hold
FAN = 4  # sums that reach the driver
UNIT = 1 << 32  # sums are integers in this fraction
DECAY = 1e-3  # weight of the squared weights
PASSES = 40
SETTLED = 1e-7  # squared Newton decrement


def char_classes(text: str) -> np.ndarray:
    """One byte per UTF-8 byte: letters become a / A / e (beyond ASCII), digits 0, all else itself."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    table = np.arange(256, dtype=np.uint8)
    table[97:123] = 97
    table[65:91] = 65
    table[48:58] = 48
    table[128:] = 101
    return table[b]


def features(text: str | None) -> np.ndarray:
    """Layout, repetition and character-shape statistics of a whole text."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    if not text:
        return out
    shape = np.zeros(SHAPES)
    count = np.zeros(256)
    cls = char_classes(text)
    for at in range(0, len(cls), PIECE):
        p = cls[at : at + PIECE + 2]
        count += np.bincount(p[:PIECE], minlength=256)
        # repeated classes are one symbol, so a shape is a change of class
        q = p[np.flatnonzero(np.append(True, p[1:] != p[:-1]))].astype(np.uint64)
        if len(q) > 2:
            h = (q[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (q[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (q[2:] * np.uint64(0x165667B19E3779F9))
            shape += np.bincount(((h >> np.uint64(24)) & np.uint64(SHAPES - 1)).astype(np.int64), minlength=SHAPES)
    n = max(1.0, count.sum())
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    out[:NAMED] = [
        1.0,
        np.log1p(len(words)) / 10,
        lengths.mean() / 10,
        lengths.std() / 10,
        min(lengths.max(), 100) / 100,
        distinct / n_words,
        np.log1p(n_words / max(1, distinct)) / 3,
        len(set(lines)) / n_lines,
        np.log1p(n_lines) / 10,
        np.log1p(n_words / n_lines) / 5,
        marks / n * 5,
        count[48] / n * 5,
        count[65] / n * 5,
        (count[97] + count[101]) / n,
        (count[32] + count[9]) / n,
        count[46] / n * 20,
        count[44] / n * 20,
        count[124] / n * 20,
        (count[42] + count[35] + count[36] + count[37] + count[38]) / n * 20,
        (count[60] + count[62] + count[123] + count[125]) / n * 20,
        float((lengths <= 3).mean()),
        1.0 / n_words,
    ]
    out[NAMED:] = np.sqrt(shape / max(1.0, shape.sum()))
    return out


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): 1 where the mean of a document's labels is at least a half, else 0."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    return known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def training_blocks(docs: DataFrame, known: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """All labelled documents, one written row per block: labels, whether the document is dealt to this block first
    (1) or copied to it, and the features, as bytes."""
    blocks = -(-sum(sizes.values()) // BLOCK)
    copies = {y: min(blocks, max(1, -(-LEAST * blocks // n))) for y, n in sizes.items()}

    @F.pandas_udf("binary")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([features(t if isinstance(t, str) else None).tobytes() for t in text], dtype=object)

    def build(batches):
        at, held = None, []
        for pdf in batches:
            for block, rows in pdf.groupby("block", sort=False):
                if held and block != at:
                    yield pack(at, held)
                    held = []
                at = block
                held.append(rows)
        if held:
            yield pack(at, held)

    def pack(block, held):
        rows = pd.concat(held)
        y, first = (rows[c].to_numpy(dtype=np.uint8).tobytes() for c in ("y", "first"))
        return pd.DataFrame({"block": [block], "y": [y], "first": [first], "x": [b"".join(rows["x"])]})

    rows = docs.select("doc_id", "text").join(small_side(known), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), vector("text").alias("x"))
    many = F.when(F.col("y") == 1, copies[1]).otherwise(copies[0])
    rows = rows.select("*", many.alias("_n"), F.explode(F.sequence(F.lit(0), many - 1)).alias("_j"))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality block")), F.lit(blocks)) + F.floor(F.col("_j") * F.lit(float(blocks)) / F.col("_n"))
    dealt = rows.select("doc_id", "y", (F.col("_j") == 0).cast("int").alias("first"), (place % blocks).cast("int").alias("block"), "h", "x").repartition("block")
    # of several texts with one id one stays, found where the block is
    unique = dealt.groupBy("block", "doc_id").agg(F.min_by(F.struct("y", "first", "x"), F.struct("h", "x")).alias("r"))
    rows = unique.sortWithinPartitions("block", "doc_id").select("block", "r.*")
    path = scratch_path(docs.sparkSession, "quality-blocks")
    rows.mapInPandas(build, "block int, y binary, first binary, x binary").write.option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.parquet(path)


def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and first places of a block."""
    x = np.frombuffer(row.x, dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    return x, np.frombuffer(row.y, dtype=np.uint8), np.frombuffer(row.first, dtype=np.uint8)


def spreads(blocks: DataFrame) -> tuple[np.ndarray, int]:
    """Standard deviations of the features over all labelled documents, and the number of pairs of all blocks. Sums are
    exact decimals: their order does not matter."""

    def moments(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                x, y, first = unpack(row)
                own = x[first == 1]
                sums = np.concatenate([own.sum(axis=0), (own * own).sum(axis=0), [len(own), float((y == 1).sum()) * float((y == 0).sum())]])
                yield pd.DataFrame({"at": np.arange(len(sums), dtype=np.int32), "v": sums})

    total = blocks.mapInPandas(moments, "at int, v double").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,9)")).alias("v"))
    v = {r.at: float(r.v) for r in total.collect()}  # two rows a feature
    if not v:
        return np.ones(N_FEATURES), 0
    v = np.array([v[i] for i in range(2 * N_FEATURES + 2)])
    mean, square = v[:N_FEATURES] / max(1.0, v[-2]), v[N_FEATURES:-2] / max(1.0, v[-2])
    return np.sqrt(np.maximum(square - mean * mean, 0)), int(v[-1])


def pair_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logistic loss of all pairs of a block, its gradient and the upper triangle of its second derivatives."""
    good, bad = x[y == 1], x[y == 0]
    d = np.subtract.outer(good @ w, bad @ w)
    miss = 1.0 / (1.0 + np.exp(np.clip(d, -500, 500)))
    q = miss * (1.0 - miss)
    gradient = bad.T @ miss.sum(axis=0) - good.T @ miss.sum(axis=1)
    cross = good.T @ (q @ bad)
    second = (good * q.sum(axis=1)[:, None]).T @ good + (bad * q.sum(axis=0)[:, None]).T @ bad - cross - cross.T
    return np.concatenate([[np.logaddexp(0, -d).sum()], gradient, second[np.triu_indices(len(w))]])


def loss_sums(blocks: DataFrame, w: np.ndarray, spread: np.ndarray, pairs: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of all pairs, gradient and second derivatives, with the weights' decay."""

    def reduce(batches):
        total = np.zeros(1 + N_FEATURES + N_FEATURES * (N_FEATURES + 1) // 2, dtype=np.int64)
        for pdf in batches:
            for row in pdf.itertuples():
                x, y, _ = unpack(row)
                part = pair_sums(x / spread, y, w) * (UNIT / pairs)
                if not np.abs(part).max() < 1 << 62:
                    raise OverflowError("features too large for the sums")
                total += np.rint(part).astype(np.int64)
        yield pd.DataFrame({"cells": [total.tobytes()]})

    def add(batches):
        total = 0
        for pdf in batches:
            total = total + sum(np.frombuffer(c, dtype=np.int64) for c in pdf["cells"])
        if not np.isscalar(total):
            yield pd.DataFrame({"cells": [total.tobytes()]})

    parts = blocks.mapInPandas(reduce, "cells binary").repartition(FAN).mapInPandas(add, "cells binary").collect()  # at most FAN rows
    v = sum(np.frombuffer(r.cells, dtype=np.int64) for r in parts) / UNIT
    second = np.zeros((N_FEATURES, N_FEATURES))
    second[np.triu_indices(N_FEATURES)] = v[1 + N_FEATURES :]
    second = second + np.triu(second, 1).T
    return v[0] + DECAY / 2 * float(w @ w), v[1 : 1 + N_FEATURES] + DECAY * w, second + DECAY * np.eye(N_FEATURES)


def weights(blocks: DataFrame, spread: np.ndarray, pairs: int) -> np.ndarray:
    """Newton steps on the loss, halved while they do not lower it."""
    w, at, step = np.zeros(N_FEATURES), None, None
    for _ in range(PASSES):
        loss, gradient, second = loss_sums(blocks, w, spread, pairs)
        if at is not None and loss > at[1] + 1e-7:
            step = step / 2
        else:
            at, step = (w, loss), np.linalg.solve(second, gradient)
            if float(gradient @ step) < SETTLED:
                break
        w = at[0] - step
    return at[0]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """Feature weights, the cut and the scale of the strengths, from every labelled document."""
    small_batches(docs.sparkSession)
    blank = {"w": np.zeros(N_FEATURES), "cut": 0.0, "scale": 1.0}
    known = cut_lineage(known_labels(labels, label), "quality-labels")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return blank
    blocks = training_blocks(docs, known, sizes)
    spread, pairs = spreads(blocks)
    if not pairs:
        return blank
    spread = spread + 1e-3
    w = weights(blocks, spread, pairs) / spread

    def strengths(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                x, y, first = unpack(row)
                yield pd.DataFrame({"y": y[first == 1].astype(np.int32), "s": (x @ w)[first == 1], "t": np.arange(first.sum(), dtype=np.int32)})

    # t parts equal strengths, as copies have them
    s = dense_index(blocks.mapInPandas(strengths, "y int, s double, t int"), ["s", "t"], "i")
    count = s.agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("y")).alias("bad")).first()
    k = min(max(count.bad, 1), count.n - 1)
    below, above = (r.s for r in s.where(F.col("i").isin(k - 1, k)).orderBy("i").collect())  # two rows
    cut = (below + above) / 2
    off = F.col("s") - F.lit(cut)
    m = s.agg(*[F.sum(c.cast("decimal(38,12)")).cast("double").alias(n) for c, n in ((off, "a"), (off * off, "b"))]).first()
    scale = max(m.b / count.n - (m.a / count.n) ** 2, 0.0) ** 0.5
    return {"w": w, "cut": float(cut), "scale": float(scale + 1e-9)}


def scorer(spark, model: dict):
    """A Column function text -> score in (0, 1), at least THRESHOLD from the cut on."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        mod = shared.value
        s = np.array([float(features(t if isinstance(t, str) else None) @ mod["w"]) for t in text], dtype=np.float64)
        z = 3.0 * (s - mod["cut"]) / mod["scale"] + shift
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
        return pd.Series(np.where(s >= mod["cut"], np.maximum(p, THRESHOLD), np.minimum(p, np.nextafter(THRESHOLD, 0))))

    return score


def rate(docs: DataFrame, model: dict, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``; a column of that name in ``docs`` is an error."""
    no_clash(docs, into)
    return docs.withColumn(into, scorer(docs.sparkSession, model)(F.col(text)))
