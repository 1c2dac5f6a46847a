"""Embedding whitening by shifted CholeskyQR.

Every vector becomes integers x = floor(1024 c) + 100000. With n, the exact sums
S and A the rows x - S/n, the rows are made orthogonal in passes: a pass solves
the triangular systems of the passes before row by row (Q = A R1^-1 R2^-1 ...),
sums the Gram matrix of Q over all rows and factorises it, shifted by a multiple
of the identity in the first pass and wherever it is not safely definite. Passes go on until the Gram
matrix is the identity. The composed factor R = ... R2 R1 has the singular
values and right singular vectors of A: e = s^2 / n are the eigenvalues of the
covariance, and the rows projected on the components over sqrt(e) are white.

A task reduces its rows to one (d + 1) x d matrix (Gram matrix and column sums).
Those matrices are written and summed in groups of ``FAN`` until ``FAN`` are
left; only they reach the driver. The factors (d x d, d <= ``MAX_DIM``) are the
only broadcast. Passes read the vectors from the input again; nothing as large
as it is written.

Edge cases: rows whose vector is null, empty, or holds null or non-finite
entries are left out; repeated rows and null ids count as rows of their own; no
rows left gives an empty result; vectors of different lengths, or longer than
``MAX_DIM``, are an error; directions without variance (constant or dependent
dimensions, fewer rows than dimensions) have explained 0 and whitened null, and
identity_error covers the others (null where there is none); explained is null
where the total variance is 0. Only own columns are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SCALE, OFFSET = 1024, 100_000
MAX_DIM = 4096
FAN = 16
BLOCK_CELLS = 1 << 20  # entries worked on at once
MAX_PASSES = 12
ROUND = 2.0**-53


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite numbers."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(v) > 0) & ~bad)


def blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their integer vectors) in blocks of bounded size."""
    step = max(1, BLOCK_CELLS // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            c = part.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = np.floor(SCALE * c)
            if np.abs(x).max(initial=0) >= 2.0**62:
                raise OverflowError("a vector entry does not fit a long")
            yield part, x.astype(np.int64) + OFFSET


def exact(x: np.ndarray, bound: float) -> np.ndarray:
    """``x`` as it is where numbers up to ``bound`` fit a long, else as Python integers."""
    return x if bound < 2.0**62 else x.astype(object)


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows and exact sums of every dimension."""

    def add(batches):
        n, total = 0, [0] * dim
        for _, x in blocks(batches, dim):
            n += len(x)
            part = exact(x, float(np.abs(x).max()) * len(x)).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, dim), pa.int32()), "s": [str(v) for v in (n, *total)]})

    parts = rows.mapInArrow(add, "at int, s string")
    out = {r.at: int(r.s) for r in parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # dim + 1 rows
    return out.get(-1, 0), [out.get(i, 0) for i in range(dim)]


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S/n in double precision, the difference n x - S taken exactly."""
    wide = exact(x, n * float(np.abs(x).max(initial=0)) + max(map(abs, total.tolist()), default=0))
    return (n * wide - total.astype(wide.dtype)).astype(np.float64) / n


def solve_right(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = A for an upper triangular R, by forward substitution over the columns."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(rows: DataFrame, dim: int, change: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """(width + 1, width): the Gram matrix of all changed rows, and below it their sums."""

    def reduce(batches):
        total = np.zeros((width + 1, width))
        for _, x in blocks(batches, dim):
            q = change(x)
            total[:width] += q.T @ q
            total[width] += q.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "cells": pa.array([total.tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((width + 1, width))
        for _, raw in sorted(zip(pdf["part"], pdf["cells"])):
            total += np.frombuffer(raw).reshape(total.shape)
        return pd.DataFrame({"part": [pdf["part"].min() // FAN], "cells": [total.tobytes()]})

    parts = cut_lineage(rows.mapInArrow(reduce, "part long, cells binary"), "whitening-gram")
    top = parts.agg(F.max("part")).first()[0] or 0
    while top >= FAN:
        parts = cut_lineage(parts.groupBy(F.expr(f"part div {FAN}")).applyInPandas(add, "part long, cells binary"), "whitening-gram")
        top //= FAN
    out = np.zeros((width + 1, width))
    for r in sorted(parts.collect()):  # at most FAN matrices
        out += np.frombuffer(r.cells).reshape(out.shape)
    return out


def factor(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper triangular R with R^T R = G + shift; a later pass needs no shift where G is safely definite."""
    d = len(g)
    low, high = np.linalg.eigvalsh(g)[[0, -1]]
    unit = 11 * (n * d + d * (d + 1)) * ROUND
    shift = 0.0 if not first and low > 10 * d * ROUND * high else min(unit, 0.01) * high
    return np.linalg.cholesky(g + shift * np.eye(d)).T


def orthogonal_factor(rows: DataFrame, dim: int, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, sums of the centred rows): the composed factor of the centred rows."""
    spark, factors, column_sums = rows.sparkSession, [], np.zeros(dim)
    for k in range(MAX_PASSES):
        shared = spark.sparkContext.broadcast(factors)

        def change(x, shared=shared):
            q = centred(x, n, total)
            for r in shared.value:
                q = solve_right(q, r)
            return q

        both = gram(rows, dim, change, dim)
        shared.destroy()
        g = both[:dim]
        if k == 0:
            column_sums = both[dim]
            if not g.any():
                return np.zeros((dim, dim)), column_sums
        elif np.abs(g - np.eye(dim)).max() <= 1e-12 * dim:
            break
        r = factor(g, n, k == 0)
        factors.append(r)
        if k > 0 and np.abs(g - np.eye(dim)).max() <= 1e-4:
            break  # the factor of a nearly orthogonal matrix needs no further pass
    out = np.eye(dim)
    for r in factors:
        out = r @ out
    return out, column_sums


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """Per usable row and component: id, component, n, deviation (decimal(38,0)), whitened, explained, identity_error."""
    spark = df.sparkSession
    rows = usable(df, vector).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType
    schema = f"{id} {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    span = rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if span.high is None:
        return spark.createDataFrame([], schema)
    if span.low != span.high or span.high > MAX_DIM:
        raise ValueError(f"vectors of {span.low} to {span.high} entries: one length up to {MAX_DIM} is needed")
    dim, k = span.high, min(components, span.high)
    n, sum_list = sums(rows, dim)
    total = np.array(sum_list, dtype=object)
    r, column_sums = orthogonal_factor(rows, dim, n, total)
    _, s, vt = np.linalg.svd(r)
    live = int((s[:k] > 16 * dim * ROUND * s[0]).sum()) if s[0] > 0 else 0
    e = s**2 / n
    axes = (vt[:live] / np.sqrt(e[:live, None])).T
    explained = [float(e[j] / e.sum()) if j < live else (0.0 if s[0] > 0 else None) for j in range(k)]
    error = None
    if live:
        mean = column_sums @ axes / n
        cov = gram(rows, dim, lambda x: centred(x, n, total) @ axes - mean, live)[:live] / n
        error = float(np.abs(cov - np.eye(live)).max())
    shared = spark.sparkContext.broadcast(axes)

    def project(batches):
        for part, x in blocks(batches, dim):
            m = len(x)
            bound = n * float(np.abs(x).max()) + max(map(abs, sum_list))
            wide = exact(x, bound)
            gap = exact(n * wide - total.astype(wide.dtype), dim * bound**2)
            deviation = (gap * gap).sum(axis=1)
            if deviation.dtype == object:
                deviation = pa.array([int(v) for v in deviation], pa.decimal128(38, 0))
            else:
                deviation = pa.array(deviation).cast(pa.decimal128(38, 0))
            white = np.full((m, k), np.nan)
            white[:, :live] = centred(x, n, total) @ shared.value
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                    deviation.take(pa.array(np.repeat(np.arange(m), k))), pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                    pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
