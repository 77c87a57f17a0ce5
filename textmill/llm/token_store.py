"""Token ids in ORC: run-length encoded stripes with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.common import materialize, prepare, rows_of, text_bytes, tidy
from textmill.llm.tokenization import encoder

STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
TEXT_PER_FILE = 48 << 20
FILE_BLOCK = 4096  # files whose totals are added up in one group
BROADCAST_FILES = 200_000  # rows (16 bytes each) that may be broadcast; beyond it the join shuffles


def _encode(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, before = context.partitionId() if context else 0, 0
        end, tokens = np.array([end_id], "<u4").tobytes(), encoder(path)
        for batch in batches:
            for first, texts in rows_of(batch, 1):
                data = [x + end for x in tokens.encode(texts)]
                counts = np.fromiter((len(x) // 4 for x in data), np.int64, len(data))
                offsets = np.concatenate([[0], np.cumsum(counts)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(np.full(len(texts), part), pa.int32()), pa.array(before + offsets[:-1]), pa.array(counts), ids],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                before += int(offsets[-1])

    return tidy(run)


LAYOUT = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", stride: int = ROW_INDEX_STRIDE) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending id order as ORC files.

    Documents are range-partitioned by id and sorted inside a file, so file and stripe statistics on ``doc_id`` bound disjoint
    ranges; each row also carries its file's number and its place in it. Ids are integer run-length encoded. Ids that are
    null come first; equal ids stay together, ordered by text. Null and empty texts are their end id alone.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    size = rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    files = max(1, -(-size // TEXT_PER_FILE), min(spark.sparkContext.defaultParallelism, size >> 20))
    ordered = rows.repartitionByRange(int(files), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encode(tokenizer, end_id), LAYOUT)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").orc(path)
    )


def file_offsets(rows: DataFrame) -> DataFrame:
    """(part, before): how many ids lie in the files before each; running sums inside blocks of files, and over the blocks."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total")).withColumn("block", F.floor(F.col("part") / FILE_BLOCK))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("total").alias("total")).select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("blocks_before"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("inside", F.coalesce(F.sum("total").over(inside), F.lit(0))).join(blocks, "block").select("part", (F.col("blocks_before") + F.col("inside")).alias("before"))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before.

    Stripes are read in parallel. With ``doc_ids`` the predicate reaches the reader, which skips files, stripes and
    row groups by statistics and Bloom filters. The files' offsets are broadcast behind a count of the files.
    """
    rows = spark.read.schema(LAYOUT).orc(path)
    offsets = materialize(file_offsets(rows), "file-offsets")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    small = offsets.count() <= BROADCAST_FILES
    return rows.join(F.broadcast(offsets) if small else offsets, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


@tidy
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read back."""
    prepare(tokens.sparkSession)
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
