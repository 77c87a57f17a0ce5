"""Packing of tokenised documents into windows of equal size by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import prepare, rows_of, text_bytes, tidy
from textmill.llm.tokenization import encoder

WINDOW = 4096
BLOCK_WINDOWS = 192  # windows that are balanced together; bounds memory and the padding a block may leave
FILL = 0.999  # a block is closed before it holds more than this share of its windows
BLOCK_PIECES = 16_384  # pieces that are balanced together: a piece costs two numbers for each window of its block
PIECE = 512  # what is left of a document is cut at so many ids: small pieces balance closely


def difference(lengths: list[int], ways: int) -> np.ndarray:
    """The subset (0 to ways - 1) of each length under multiway Karmarkar-Karp differencing.

    Every length starts as a partial partition with one filled subset. The two partial partitions with the largest
    imbalance merge, the largest subsets of one with the smallest of the other, until one is left.
    """
    # (-imbalance, node); a node's sums are ascending, its children say where each subset came from
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, n in enumerate(lengths):
        first = np.zeros(ways, np.int64)
        first[-1] = n
        sums[i] = first
        heap.append((-n if ways > 1 else 0, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    node = len(lengths)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(total, kind="stable")
        total = total[order]
        total -= total[0]
        sums[node] = total
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(total[-1]), node))
        node += 1
    subset = np.zeros(len(lengths), np.int64)
    labels = {heap[0][1]: np.arange(ways)} if heap else {}
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        placed = np.empty(ways, np.int64)
        placed[order] = labels.pop(len(lengths) + at)
        for child, own in ((a, placed), (b, placed[::-1])):
            if child < len(lengths):
                subset[child] = own[-1]
            else:
                labels[child] = own
    return subset


def windows(lengths: list[int], capacity: int = WINDOW) -> np.ndarray:
    """The window of each length; as few windows as differencing can balance within the capacity."""
    if not lengths:
        return np.zeros(0, np.int64)
    ways = max(1, -(-sum(lengths) // capacity))
    while True:
        subset = difference(lengths, ways)
        if np.bincount(subset, lengths, ways).max() <= capacity:
            return subset
        ways += 1


def _pack(path: str, end_id: int, capacity: int, piece: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        full, rest, waiting = [], [], 0
        end = np.array([end_id], "<u4").tobytes()
        tokens = encoder(path)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def packed(pieces: list[tuple]) -> list[tuple]:
            nonlocal sequence
            place = windows([len(p[2]) // 4 for p in pieces], capacity)
            used, rows = {}, []
            for p, w in zip(pieces, place.tolist(), strict=True):
                if w not in used:
                    used[w] = [sequence, 0]
                    sequence += 1
                number, at = used[w]
                rows.append((*p, number, at))
                used[w][1] = at + len(p[2]) // 4
            return rows

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in rows_of(batch, 1):
                encoded = tokens.encode(texts)
                for i, data in enumerate(encoded):
                    data += end
                    n, at = len(data) // 4, 0
                    while n - at >= capacity:
                        full.append((ids[first + i], at, data[4 * at : 4 * (at + capacity)], n, sequence, 0))
                        sequence += 1
                        at += capacity
                    if rest and (waiting + n - at > FILL * BLOCK_WINDOWS * capacity or len(rest) >= BLOCK_PIECES):
                        yield out(packed(rest))
                        rest, waiting = [], 0
                    rest += [(ids[first + i], p, data[4 * p : 4 * (p + piece)], n) for p in range(at, n, piece)]
                    waiting += n - at
                    if len(full) >= 256:
                        yield out(full)
                        full = []
        if rest:
            yield out(packed(rest))
        if full:
            yield out(full)

    return tidy(run)


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): the pieces of all documents in sequences of at most ``capacity`` ids.

    ``tokenizer`` is the path of a tokenizers file on every machine; ids are little-endian uint32 bytes, each document
    ends with ``end_id``. A document of ``capacity`` ids or more gives full sequences first; what is left of each is cut at
    ``piece`` ids and packed by differencing, a block of about BLOCK_WINDOWS windows or BLOCK_PIECES pieces at a time, inside the task
    that encoded it: no shuffle, and memory is one block, also where all texts are a word long. Sequence ids carry the task's number above bit 36, so they are unique and come out alike when a task is
    run again. Null and empty texts are their end id alone; null and repeated ids are carried as they are.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    return rows.mapInArrow(_pack(tokenizer, end_id, capacity, piece), "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
