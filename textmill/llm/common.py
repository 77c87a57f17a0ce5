"""Helpers shared by the corpus operators: scratch tables, byte-level words, local forests."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS_PER_BATCH = 2000
REPO = str(Path(__file__).resolve().parents[2])


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries trim by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(task: Callable) -> Callable:
    """An Arrow task that gives freed memory back when it ends: workers are used again, and share an executor's memory."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            give_back()

    return run


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by its own path, and keep Arrow batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > RECORDS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORDS_PER_BATCH))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if REPO not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, known) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets one of its own; a cluster must name it.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        own = tempfile.mkdtemp(prefix="textmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/textmill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has materialized; results that were not written yet can then not be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/textmill/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, no executor is needed again,
    and joins see plain scans with known sizes, so AQE can broadcast or split them."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing will read again."""
    spark = df.sparkSession
    root = shared_folder(spark)
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/textmill/" in file and file.startswith(("file:", root.split(":")[0])):
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null stays null."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def rows_of(batch: pa.RecordBatch, column: int, at_most: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """Slices (first row, values) of a binary column with at most ``at_most`` bytes, or one long value, each."""
    col = batch.column(column)
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if pa.types.is_binary(col.type) else np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    first = 0
    while first < len(col):
        last = int(np.searchsorted(offsets, offsets[first] + at_most, side="right")) - 1
        last = min(max(last, first + 1), len(col))
        yield first, col.slice(first, last - first).to_pylist()
        first = last


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, root) that join the same nodes as the links (a, b), at most one for each node."""
    if not len(a):
        return a[:0], b[:0]
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]
