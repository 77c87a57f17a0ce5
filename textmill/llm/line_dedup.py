"""Removal of lines that repeat across documents: two Bloom filters find suspects, only those shuffle for exact confirmation."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import discard, materialize, prepare, rows_of, text_bytes, tidy

MIN_CHARS = 20
MIN_DOCS = 3
HASHES = 3
BITS_PER_LINE = 16
SEGMENT = 1 << 19  # bits of a filter that travel as one row; all bits of a hash lie in one segment
BROADCAST_SEGMENTS = 1024  # twice-seen filters of at most so many segments (64 MB) are broadcast; beyond it hashes are dealt to segments
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) that may be broadcast; beyond it the join shuffles
FLUSH = 1 << 20  # hashes that a task holds before it hands their bits on
SALTS = 16  # ways in which the hashes of one segment are dealt


def line_key(line: bytes) -> bytes | None:
    """What makes two lines equal; None for a line too short to count."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return key


def _keys(text: bytes | None) -> set[bytes]:
    keys = {line_key(x) for x in (text or b"").split(b"\n")}
    keys.discard(None)
    return keys


def _places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each hash, and its bits there, a row for each of HASHES."""
    segment = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    first, step = mixed >> np.uint64(40), (mixed >> np.uint64(8)) | np.uint64(1)
    return segment.astype(np.int64), np.stack([((first + np.uint64(i) * step) & np.uint64(SEGMENT - 1)).astype(np.uint32) for i in range(HASHES)])


def _set(into: np.ndarray, bits: np.ndarray) -> None:
    np.bitwise_or.at(into, bits >> 3, (1 << (bits & 7)).astype(np.uint8))


def holds(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether all bits (a row for each of HASHES) are set in a segment."""
    return ((words[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).all(axis=0)


class TwoFilters:
    """A segment's bits for hashes seen once and for hashes seen twice or more. A hash seen twice is always found."""

    def __init__(self) -> None:
        self.once, self.twice = np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)

    def add(self, once: np.ndarray, twice: np.ndarray) -> None:
        """The sets of bits that one task has seen: what was there before is seen again."""
        new = np.zeros_like(self.once)
        _set(new, once)
        self.twice |= new & self.once
        _set(self.twice, twice)
        self.once |= new


def _bits_of(hashes: np.ndarray, segments: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(segment, bits of its hashes, bits set by two of them) of the hashes that one task has seen."""
    values, counts = np.unique(hashes, return_counts=True)
    segment, bits = _places(values, segments)
    order = np.argsort(segment, kind="stable")
    segment, bits, again = segment[order], bits[:, order], counts[order] > 1
    edges = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine, n = np.unique(bits[:, a:b], return_counts=True)
        twice = np.union1d(mine[n > 1], bits[:, a:b][:, again[a:b]].ravel())
        yield int(segment[a]), zlib.compress(mine.tobytes(), 1), zlib.compress(twice.astype(np.uint32).tobytes(), 1)


def _fill(segments: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, held = xxhash.xxh3_64_intdigest, []

        def out() -> pa.RecordBatch:
            rows = list(zip(*_bits_of(np.array(held, np.uint64), segments), strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["segment", "once", "twice"])

        for batch in batches:
            for _, texts in rows_of(batch, 0):
                for t in texts:
                    held += [digest(k) for k in _keys(t)]
                    if len(held) >= FLUSH:
                        yield out()
        if held:
            yield out()

    return tidy(run)


@tidy
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by number: what two tasks have both seen once is seen twice."""
    number, both = None, TwoFilters()

    def out() -> pa.RecordBatch:
        found = [both.twice] if both.twice.any() else []
        return pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array([zlib.compress(x, 1) for x in found], pa.binary())], ["segment", "twice"])

    for batch in batches:
        for n, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if n != number:
                if number is not None:
                    yield out()
                number, both = n, TwoFilters()
            both.add(*(np.frombuffer(zlib.decompress(x), np.uint32) for x in (a, b)))
    if number is not None:
        yield out()


def segments_for(texts: DataFrame) -> int:
    """Enough segments for BITS_PER_LINE bits for each line of all texts."""
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit(b"\n"), F.lit(b""))) + 1
    return max(1, -(-(texts.agg(F.sum(lines)).first()[0] or 0) * BITS_PER_LINE // SEGMENT))


def twice_seen(texts: DataFrame, segments: int) -> DataFrame:
    """(segment, twice): the merged filter of line hashes seen in two or more documents; no task holds more than one segment."""
    filled = texts.mapInArrow(_fill(segments), "segment long, once binary, twice binary").repartition("segment").sortWithinPartitions("segment")
    return materialize(filled.mapInArrow(_merge, "segment long, twice binary"), "twice-seen")


def _digest(key: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_digest(key)
    return int.from_bytes(value[:8], "big", signed=True), int.from_bytes(value[8:], "big", signed=True)


LINES = "hi long, lo long, id long, tag long"


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(row, key, hash) of each row's different keys, some rows at a time."""
    for first, texts in rows_of(batch, 2):
        owner, keys = [], []
        for i, t in enumerate(texts):
            found = _keys(t)
            keys += found
            owner += [first + i] * len(found)
        if keys:
            yield np.array(owner), keys, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def _with_digests(batch: pa.RecordBatch, owner: list[int], keys: list[bytes]) -> list[pa.Array]:
    digests = [_digest(k) for k in keys]
    at = pa.array(owner, pa.int64())
    return [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), batch.column(0).take(at), batch.column(1).take(at)]


def _suspects(shared, segments: int) -> Callable:  # noqa: ANN001
    """(id, tag, text) -> the lines that the broadcast filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            for owner, keys, hashes in _lines(batch):
                segment, bits = _places(hashes, segments)
                hit = np.flatnonzero(holds(twice.reshape(-1), bits.astype(np.int64) + segment * SEGMENT)).tolist()
                yield pa.RecordBatch.from_arrays(_with_digests(batch, owner[hit].tolist(), [keys[i] for i in hit]), ["hi", "lo", "id", "tag"])

    return tidy(run)


def _dealt(segments: int) -> Callable:
    """(id, tag, text) -> every line by its segment and the bits it has there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, keys, hashes in _lines(batch):
                segment, bits = _places(hashes, segments)
                columns = [pa.array(segment), pa.array([b.tobytes() for b in np.ascontiguousarray(bits.T)], pa.binary()), *_with_digests(batch, owner.tolist(), keys)]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "bits", "hi", "lo", "id", "tag"])

    return tidy(run)


@tidy
def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, twice, bits, hi, lo, id, tag), sorted, a segment's filter before the lines dealt to it -> the lines it holds."""
    number, twice = None, None
    for batch in batches:
        kept = []
        for i, (n, found, bits) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if found is not None:
                number, twice = n, np.frombuffer(zlib.decompress(found), np.uint8)
            elif n == number and holds(twice, np.frombuffer(bits, np.uint32)):
                kept.append(i)
        yield batch.select(["hi", "lo", "id", "tag"]).take(pa.array(kept, pa.int64()))


def suspected_lines(docs: DataFrame, broadcast_segments: int = BROADCAST_SEGMENTS) -> DataFrame:
    """(id, tag, text) -> (hi, lo, id, tag) of every line that may stand in two documents.

    A filter with few segments is broadcast. With more, the lines' digests and bits, not the lines, are dealt to the segments,
    SALTS ways each, so that no task needs the whole filter and none gets all copies of a line.
    """
    spark = docs.sparkSession
    segments = segments_for(docs)
    filters = twice_seen(docs.select("text"), segments)
    if segments <= broadcast_segments:
        merged = np.zeros((segments, SEGMENT // 8), np.uint8)
        for row in filters.collect():
            merged[row.segment] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
        return docs.mapInArrow(_suspects(spark.sparkContext.broadcast(merged), segments), LINES)
    salted = filters.select("segment", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "twice", *(F.lit(None).cast(t).alias(c) for c, t in (("bits", "binary"), *(x.split() for x in LINES.split(", ")))))
    lines = docs.mapInArrow(_dealt(segments), "segment long, bits binary, " + LINES).withColumn("salt", F.pmod(F.xxhash64("id", "tag"), F.lit(SALTS)).cast("int")).withColumn("twice", F.lit(None).cast("binary"))
    both = salted.unionByName(lines).repartition("segment", "salt").sortWithinPartitions("segment", "salt", F.col("twice").isNull())
    return both.select("segment", "twice", "bits", "hi", "lo", "id", "tag").mapInArrow(_probed, LINES)


def _apply(column: int) -> Callable:
    """(row, text, and the lines to drop in list column ``column`` if there is one) -> (row, n_lines, n_dropped, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for first, texts in rows_of(batch, 1):
                for i, text in enumerate(texts):
                    drops = batch.column(column)[first + i] if column else None
                    lines = (text or b"").split(b"\n")
                    n_lines.append(len(lines))
                    if drops is not None and drops.is_valid:
                        gone = {(x["hi"], x["lo"]) for x in drops.as_py()}
                        stay = [x for x in lines if (k := line_key(x)) is None or _digest(k) not in gone]
                        n_dropped.append(len(lines) - len(stay))
                        kept.append(b"\n".join(stay).decode("utf-8", "replace"))
                    else:
                        n_dropped.append(0)
                        kept.append((text or b"").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["row", "n_lines", "n_dropped", "kept"]
            )

    return tidy(run)


def _lines_to_drop(rows: DataFrame) -> DataFrame:
    """(id, tag, text) -> (id, tag, drops): digests of the lines that each document loses."""
    suspects = materialize(suspected_lines(rows.where("id is not null")), "line-suspects")
    common = materialize(
        suspects.groupBy("hi", "lo").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= MIN_DOCS).drop("n"),
        "common-lines",
    )
    drops = materialize(
        suspects.join(common, ["hi", "lo"]).where("id < keeper").groupBy("id", "tag").agg(F.collect_set(F.struct("hi", "lo")).alias("drops")), "line-drops"
    )
    for old in (suspects, common):
        discard(old)
    return drops


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's other columns as struct ``row``, with ``n_lines``, ``n_dropped`` and the ``kept`` text.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least MIN_CHARS code points
    found in at least MIN_DOCS documents lose all their lines but those of the largest id. The filters grow with the
    lines, segment by segment; they only suspect lines, and the exact step (128-bit digests, counted per document) decides alone,
    so the result never depends on them. The hot line is pre-aggregated, and its join reads two plain tables that AQE can
    split. Texts that lose nothing are not shuffled: their ids are told apart by a broadcast of the others' ids behind a count.

    Null and empty texts have one empty line. Rows with a null id are not counted and lose nothing; rows that share an id
    are one document. Columns may have any names. Empty input gives an empty result.
    """
    prepare(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*rest).alias("row"), text_bytes(text_col).alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"))
    drops = _lines_to_drop(rows.select("id", F.xxhash64("text").alias("tag"), "text"))
    names = drops.select("id").distinct()
    names = F.broadcast(names) if names.count() <= BROADCAST_IDS else names
    out = T.StructType([rows.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    clean = rows.join(names, "id", "left_anti").select("row", "text").mapInArrow(_apply(0), out)
    cut = rows.join(names, "id", "left_semi").withColumn("tag", F.xxhash64("text")).join(drops, ["id", "tag"], "left")
    return clean.union(cut.select("row", "text", "drops").mapInArrow(_apply(2), out))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, columns as they were, with the kept lines as their text."""
    found = dedup_lines(docs, id_col, text_col)
    return found.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
