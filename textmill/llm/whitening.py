"""Whitening of embeddings by matrix-free block subspace iteration.

No covariance matrix is made. A pass over the rows computes V Q = X'(XQ) / n for a block Q of orthonormal columns, X being the
centred rows; the driver sees such d x b blocks only, does a Rayleigh-Ritz step and a QR, and stops once the residuals of all k
wanted pairs are at rounding level. What is sent either way is bounded by d x b numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import prepare, tidy
from textmill.llm.vectors import matrix, usable, usual_length

SCALE, OFFSET = 64, 1_000_000  # an entry c counts as floor(SCALE * c) + OFFSET
COMPONENTS = 32
OVERSAMPLING = 2  # the block has so many columns for each wanted component, or as many as there are dimensions
RESIDUAL = 1e-13  # of the largest eigenvalue: what each of the wanted pairs must reach
RANK = 1e-11  # components below this share of the largest eigenvalue are rounding, not data
PASSES = 500
MOST_ENTRY = 2.0**52  # scaled entries are held within what doubles count exactly


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: row counts and sums, unit components in columns by falling eigenvalue, and what certifies them."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def integers(c: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(c * SCALE), -MOST_ENTRY, MOST_ENTRY).astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers where they hold it, else as Python's."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    return x * n - np.array(sums, np.int64) if bound < 1 << 62 else x.astype(object) * n - np.array(sums, object)


def squares(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    top = int(np.abs(d).max(initial=0))
    return (d * d).sum(1).tolist() if top * top * max(d.shape[1], 1) < 1 << 62 else (d.astype(object) ** 2).sum(1).tolist()


def _rows(vectors: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The usable rows, of the usual length, as struct ``row`` of the other columns and ``v``."""
    rest = [F.col(f"`{c}`") for c in vectors.columns if c != vector_col]
    rows = vectors.select(F.struct(*rest).alias("row") if rest else F.struct(F.lit(None).alias("_")).alias("row"), F.col(f"`{vector_col}`").alias("v")).where(usable(F.col("v")))
    dims = usual_length(rows, "v")
    return rows.where(F.size("v") == dims), dims


def _summed(rows: DataFrame, task: Callable, width: int) -> np.ndarray:
    """What tasks give as (i, width doubles), summed by i: a d x width block on the driver."""
    columns = [f"c{j}" for j in range(width)]
    parts = rows.mapInArrow(tidy(task), "i int, " + ", ".join(f"{c} double" for c in columns))
    got = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).toArrow().sort_by("i")
    return np.stack([got.column(c).to_numpy() for c in columns], axis=1) if got.num_rows else np.zeros((0, width))


def _block(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(np.ascontiguousarray(total[:, j])) for j in range(total.shape[1]))], ["i", *(f"c{j}" for j in range(total.shape[1]))]
    )


def _sums(dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = integers(matrix(batch.column(0), dims))
            exact = x if len(x) * int(np.abs(x).max(initial=0)) < 1 << 62 else x.astype(object)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, exact.sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(dims)), "n": [n] * dims, "high": [t >> 32 for t in total], "low": [t & 0xFFFFFFFF for t in total]}, pa.schema([("i", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]))

    return tidy(run)


def _times(q: np.ndarray, n: int, sums: tuple[int, ...]) -> Callable:
    """X'(XQ) of a task's rows; one row more holds their sum of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(q) + 1, q.shape[1]))
        for batch in batches:
            x = centred(integers(matrix(batch.column(0), len(q))), n, sums).astype(np.float64) / n
            total[:-1] += x.T @ (x @ q)
            total[-1, 0] += (x * x).sum()
        yield _block(total)

    return run


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Mean and leading eigenpairs of the covariance (divisor n) of the usable vectors, floored as integers.

    Unusable are null vectors, those with a null or non-finite entry, and those whose length is not the commonest one. Scaled
    entries beyond 2 ** 52 count as that. No more components are given than have an eigenvalue above rounding: none where all rows
    are equal, and for an empty table.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows, dims = _rows(vectors, vector_col)
    rows = rows.select("v")
    if not dims:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0, 0)
    wide = "decimal(38,0)"
    got = rows.mapInArrow(_sums(dims), "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    n, sums = got[0].n, tuple((int(r.high) << 32) + r.low for r in got)
    width = min(dims, OVERSAMPLING * components)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, width)))[0]
    for done in range(1, PASSES + 1):
        y = _summed(rows, _times(q, n, sums), width)
        trace, y = y[-1, 0] / n, y[:-1] / n
        h = q.T @ y
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        ritz = q @ u
        residuals = np.linalg.norm(y @ u - ritz * theta, axis=0)[:components]
        if theta[0] <= 0 or (residuals <= RESIDUAL * theta[0] * max(1.0, np.sqrt(dims) / 8)).all():
            break
        q = np.linalg.qr(y @ u)[0]
    else:
        raise RuntimeError(f"after {PASSES} passes the residuals are still {residuals.max() / theta[0]:.3g} of the largest eigenvalue")
    k = int((theta[:components] > max(RANK * theta[0], 0)).sum())
    return Whitening(n, sums, ritz[:, :k], theta[:k], residuals[:k], float(trace), done)


def _whitened(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    d = centred(x, model.n, model.sums)
    return d, (d.astype(np.float64) / model.n) @ model.components / np.sqrt(model.eigenvalues)


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured on all rows; 0 without components."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    prepare(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            _, w = _whitened(integers(matrix(batch.column(0), model.dims)), model)
            total[:-1] += w.T @ w
            total[-1] += w.sum(0)
        yield _block(total)

    total = _summed(_rows(vectors, vector_col)[0].select("v"), run, k) / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> DataFrame:
    """The other columns as struct ``row``, ``whitened`` (a double for each component) and ``deviation``, the exact sum over
    dimensions of (n * x - S) ** 2, null beyond 38 digits.

    Rows are those that :func:`fit_whitening` uses; null ids, repeated rows and columns of any name are carried through. An empty
    table, or a model without components, gives no row.
    """
    prepare(vectors.sparkSession)
    rows, dims = _rows(vectors, vector_col)
    out = T.StructType([rows.schema["row"], T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])
    k = len(model.eigenvalues)
    if not k or dims != model.dims:
        return vectors.sparkSession.createDataFrame([], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, w = _whitened(integers(matrix(batch.column(1), model.dims)), model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * np.int32(k)), pa.array(w.ravel()))
            deviation = pa.array([s if s < 10**38 else None for s in squares(d)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, deviation], ["row", "whitened", "deviation"])

    return rows.mapInArrow(tidy(run), out)
