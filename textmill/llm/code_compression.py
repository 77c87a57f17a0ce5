"""Compression of vectors to short codes: one small codebook for each of their parts, fitted and applied by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import materialize, prepare, tidy
from textmill.llm.vectors import matrix, usable, usual_length

SCALE = 256  # an entry c counts as floor(SCALE * c)
PARTS, ENTRIES, ROUNDS = 16, 64, 2
MOST_ENTRY = 1 << 26  # scaled entries are held within this, so that distances of up to 512 dimensions are exact
QUERIES = 1 << 13  # parts that one step of the search holds distances for
BROADCAST_LABELS = 200_000


@dataclass(frozen=True)
class Codebooks:
    """(parts, entries, dimensions of a part) integers; ``dims`` is the vectors' length, padded with zeros to equal parts."""

    entries: np.ndarray
    dims: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(c: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, dimensions of a part)"""
    x = np.clip(np.floor(c * SCALE), -MOST_ENTRY, MOST_ENTRY).astype(np.int64)
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry for each row, the lower index of equally near ones.

    Dimensions come in descending order of the entries' variance. After the first one, each row's most promising entry
    is measured completely; from then on, entries whose partial distance strictly exceeds the row's best complete one
    are dropped, the most promising survivor being measured completely again while several are left.
    """
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    partial = (x[:, :1] - book[:, 0]) ** 2
    guess = partial.argmin(1)
    best = ((x - book[guess]) ** 2).sum(1)
    row, entry = np.nonzero(partial <= best[:, None])
    partial = partial[row, entry]
    for d in range(1, x.shape[1]):
        partial = partial + (x[row, d] - book[entry, d]) ** 2
        if d + 1 < x.shape[1]:
            start = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(partial, start)
            at = np.flatnonzero(partial == np.repeat(least, np.diff(start, append=len(row))))
            at = at[np.flatnonzero(np.diff(row[at], prepend=-1))]
            best = np.minimum(best, ((x[:, d + 1 :] - book[entry[at], d + 1 :]) ** 2).sum(1) + least)
        stay = partial <= best[row]
        row, entry, partial = row[stay], entry[stay], partial[stay]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(partial, start)
    at = np.flatnonzero(partial == np.repeat(least, np.diff(start, append=len(row))))
    at = at[np.flatnonzero(np.diff(row[at], prepend=-1))]
    return entry[at], least


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) entries and squared distances."""
    codes, distances = np.empty(x.shape[:2], np.uint8), np.empty(x.shape[:2], np.int64)
    for part in range(x.shape[1]):
        for first in range(0, len(x), QUERIES):
            at = slice(first, first + QUERIES)
            codes[at, part], distances[at, part] = nearest(x[at, part], books[part])
    return codes, distances


def _rows(vectors: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    rest = [F.col(f"`{c}`") for c in vectors.columns if c != vector_col]
    rows = vectors.select(F.struct(*rest).alias("row") if rest else F.struct(F.lit(None).alias("_")).alias("row"), F.col(f"`{vector_col}`").alias("v")).where(usable(F.col("v")))
    dims = usual_length(rows, "v")
    return rows.where(F.size("v") == dims), dims


def _gathered(books: Codebooks) -> Callable:
    """A task's vectors -> for each part and entry how many parts chose it, and their componentwise sums."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            x = integers(matrix(batch.column(0), books.dims), parts)
            cell = (np.arange(parts) * entries + assign(x, books.entries)[0]).ravel()
            counts += np.bincount(cell, minlength=len(counts))
            np.add.at(sums, cell, x.reshape(-1, width))
        used = np.flatnonzero(counts)
        names = ["cell", "n", *(f"s{j}" for j in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), *(pa.array(sums[used, j]) for j in range(width))], names)

    return tidy(run)


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the parts of the rows with the smallest ids, then take ``rounds`` of assignment and floored means over all rows.

    Ids in rising order, null ids last, equal ids by their vectors; a table of fewer rows gives fewer entries, an empty one none.
    Unusable vectors are as for :func:`encode`. The driver holds the codebooks and what tasks gathered for their
    entries, which Spark has summed: sizes that do not depend on the rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    prepare(vectors.sparkSession)
    rows, dims = _rows(vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")), "v")
    first = rows.orderBy(F.col("row.id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), 0)
    start = integers(np.array([r.v for r in first], np.float64), parts).transpose(1, 0, 2).copy()
    books = Codebooks(start, dims)
    width = start.shape[2]
    wide = "decimal(38,0)"  # sums of more rows than a long holds
    for _ in range(rounds):
        gathered = rows.select("v").mapInArrow(_gathered(books), "cell int, n long, " + ", ".join(f"s{j} long" for j in range(width)))
        got = gathered.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{j}").cast(wide)).alias(f"s{j}") for j in range(width))).collect()
        new = books.entries.copy()
        for r in got:  # at most parts x entries rows
            new[divmod(r.cell, new.shape[1])] = [int(r[f"s{j}"]) // r.n for j in range(width)]
        books = Codebooks(new, dims)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """The other columns as struct ``row``, the ``code`` (a byte for each part) and ``error``, the squared distance of the floored vector to what the code stands for.

    Left out are null vectors, those with a null or non-finite entry, and those whose length is not the commonest one. Vectors whose length is no multiple of the
    number of parts are padded with zeros. Scaled entries beyond 2 ** 26 count as that. Null ids, repeated rows and columns of any
    name are carried through; an empty table gives an empty result.
    """
    prepare(vectors.sparkSession)
    rows, dims = _rows(vectors, vector_col)
    out = T.StructType([rows.schema["row"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if not books.dims or dims != books.dims:
        return vectors.sparkSession.createDataFrame([], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, distances = assign(integers(matrix(batch.column(1), books.dims), len(books.entries)), books.entries)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(distances.sum(1))], ["row", "code", "error"])

    return rows.mapInArrow(tidy(run), out)


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """Adds ``approximation``: the vector that a code stands for, in the unit of the original one."""
    parts, _, width = books.entries.shape
    flat = F.lit([float(v) / SCALE for v in books.entries.ravel()])
    size = books.entries.shape[1]
    at = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda p: ((p - 1) * size + F.conv(F.hex(F.substring(F.col(code), p, F.lit(1))), 16, 10).cast("int")) * width)
    vector = F.slice(F.flatten(F.transform(at, lambda i: F.slice(flat, i + 1, F.lit(width)))), 1, books.dims)
    return codes.withColumn("approximation", vector)


def label_errors(codes: DataFrame, label: str = "row.label") -> DataFrame:
    """Adds ``label_error``: the ``error`` of all rows with the same label, null labels together; null beyond a long.

    Sums are partial before their shuffle; the table of labels is broadcast behind a count, and joined by a shuffle that AQE can split beyond it.
    """
    codes = materialize(codes, "vector-codes")
    sums = codes.groupBy(F.col(label).alias("_label")).agg(F.try_sum("error").alias("label_error"))
    sums = materialize(sums, "label-errors")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return codes.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
