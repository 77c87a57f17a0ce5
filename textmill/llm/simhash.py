"""SimHash near-duplicate groups through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import discard, forest, materialize, prepare, rows_of, text_bytes, tidy
from textmill.llm.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = 2
WIDTH = 64 // SEGMENTS
SMALL_GROUP = 24
LARGE_GROUP = 4096  # a bucket of more fingerprints is searched by the bytes of the segment that it leaves open
POPULAR = 20_000  # fingerprints with one segment beyond which its buckets are cut before the shuffle
BROADCAST_BUCKETS = 1_000_000  # keys (8 bytes each) that may be broadcast


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of the text's word shingles, as a signed integer; no words: 0."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        return int.from_bytes(xxhash.xxh64_digest(joined, SEED), "big", signed=True)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    digest, ones, step = xxhash.xxh64_digest, np.zeros(64, np.int64), 1 << 15
    for at in range(0, len(first), step):
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(first[at : at + step], last[at : at + step])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big", signed=True)


@tidy
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t) for _, texts in rows_of(batch, 1) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; null and wordless texts have fingerprint 0."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    return rows.mapInArrow(_fingerprints, "id long, fp long")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= MAX_BITS


def _forest_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among some fingerprints: each found member is compared with those not yet reached."""
    a, b, left = [], [], prints
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _near(left, x)
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                left = left[~hit]
    empty = prints[:0]
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _group_links(prints: np.ndarray, slot: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links in one bucket of ``slot``'s segment.

    Of the four bytes of the other segment at least one is equal in two fingerprints that differ in three bits or fewer, so a large
    bucket is cut by each of them in turn.
    """
    if len(prints) <= LARGE_GROUP:
        return _forest_of(prints)
    a, b = [], []
    other = 0 if slot // WIDTH else WIDTH
    for shift in range(other, other + WIDTH, 8):
        byte = (prints >> shift) & 255
        order = np.argsort(byte, kind="stable")
        edges = np.searchsorted(byte[order], np.arange(257))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            x, y = _forest_of(prints[order[i:j]])
            a.append(x)
            b.append(y)
    return forest(np.concatenate(a), np.concatenate(b))


def _links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within the buckets of rows sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    a, b = [], []
    small = (size > 1) & (size <= SMALL_GROUP)
    k, p = keys[small], prints[small]
    for gap in range(1, SMALL_GROUP):
        if len(k) <= gap:
            break
        same = k[gap:] == k[:-gap]
        if not same.any():
            break
        x, y = p[:-gap][same], p[gap:][same]
        near = _near(x, y)
        a.append(x[near])
        b.append(y[near])
    for at, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
        x, y = _group_links(prints[at : at + n], int(keys[at] >> 32) & 63)
        a.append(x)
        b.append(y)
    if not a:
        return prints[:0], prints[:0]
    return forest(np.concatenate(a), np.concatenate(b))


@tidy
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> links; a bucket may span batches."""
    keys = prints = np.empty(0, np.int64)
    held: list[pa.RecordBatch] = []
    waiting, wanted = 0, 200_000

    def out(k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        a, b = _links(k, p)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def gather() -> None:
        nonlocal keys, prints
        keys = np.concatenate([keys, *(x.column(0).to_numpy(zero_copy_only=False) for x in held)])
        prints = np.concatenate([prints, *(x.column(1).to_numpy(zero_copy_only=False) for x in held)])
        held.clear()

    for batch in batches:
        held.append(batch)
        waiting += len(batch)
        if waiting < wanted:
            continue
        gather()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if cut:
            yield out(keys[:cut], prints[:cut])
            keys, prints = keys[cut:].copy(), prints[cut:].copy()
        waiting, wanted = len(keys), max(200_000, 2 * len(keys))  # a large bucket is copied a few times, not once a batch
    gather()
    if len(keys):
        yield out(keys, prints)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join distinct fingerprints (column fp) exactly as all pairs at MAX_BITS or fewer bits would.

    Two fingerprints with 3 differing bits have one of two 32-bit segments in which at most one bit differs. Each
    segment is indexed under its 32 one-wildcard variants, so such a pair always shares a bucket. Buckets are joined by
    equality and verified; a bucket gives a spanning forest, not its pairs.

    Buckets of popular segments are cut before they are brought together: of the four bytes of the other segment at least
    one is equal in such a pair, so each fingerprint goes to four parts of its bucket, by byte, which lie in different tasks.
    """
    segment = f"(shiftrightunsigned(fp, {WIDTH} * (CAST(slot DIV {WIDTH} AS INT))) & {(1 << WIDTH) - 1}L)"
    key = F.expr(f"shiftleft(CAST(slot AS BIGINT), 32) | ({segment} & ~shiftleft(1L, slot % {WIDTH}))")
    variants = (
        distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * WIDTH - 1))).alias("slot"))
        .selectExpr("fp", "CAST(slot AS INT) AS slot")
        .select(key.alias("key"), "fp", "slot")
    )
    popular = popular_buckets(distinct)
    if popular is not None:
        byte = F.expr(f"shiftrightunsigned(fp, 8 * part + IF(slot < {WIDTH}, {WIDTH}, 0)) & 255L")
        parts = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(None).cast("int")))
        cut = F.when(F.col("part").isNull(), F.col("key")).otherwise(F.col("key").bitwiseOR(F.shiftleft(F.col("part").cast("long") + 1, 40)).bitwiseOR(F.shiftleft(byte, 44)))
        variants = variants.join(popular, F.col("key") == F.col("hot"), "left").withColumn("part", F.explode(parts)).select(cut.alias("key"), "fp")
    variants = (
        variants.select("key", "fp")
        .repartition("key")
        .sortWithinPartitions("key")
    )
    return variants.mapInArrow(_linked, "a long, b long")


def popular_buckets(distinct: DataFrame, most: int = POPULAR) -> DataFrame | None:
    """Keys (column hot) of the buckets of segments that more than ``most`` fingerprints have, to be broadcast behind a count; null if there are none."""
    low = (1 << WIDTH) - 1
    held = distinct.select(F.explode(F.array(*(F.struct(F.lit(i).alias("segment"), F.expr(f"shiftrightunsigned(fp, {WIDTH * i}) & {low}L").alias("value")) for i in range(SEGMENTS)))).alias("s"))
    hot = materialize(held.groupBy("s.segment", "s.value").agg(F.count("*").alias("n")).where(F.col("n") > most).select("segment", "value"), "popular-segments")
    n = hot.count()
    if not n:
        return None
    slots = hot.select("value", F.explode(F.sequence(F.col("segment") * WIDTH, F.col("segment") * WIDTH + WIDTH - 1)).alias("slot"))
    keys = slots.select(F.expr(f"shiftleft(CAST(slot AS BIGINT), 32) | (value & ~shiftleft(1L, slot % {WIDTH}))").alias("hot")).distinct()
    return F.broadcast(keys) if n * WIDTH <= BROADCAST_BUCKETS else keys


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most three bits.

    Exact copies of a fingerprint collapse to their smallest id before any link is sought, so a third of all rows in one
    group costs one row there. Rows with a null id are returned with a null component and link nothing; repeated ids
    are repeated rows of the result. Empty input gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = materialize(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "representatives")
    links = materialize(fingerprint_links(reps.select("fp")), "simhash-links")
    a, b = (reps.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab")
    roots = connected_components(
        links.distinct().join(a, "a").join(b, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    )
    groups = materialize(
        reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("group")),
        "simhash-groups",
    )
    for old in (links, reps):
        discard(old)
    return prints.join(groups, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("group")).alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents less those near an earlier one: of each group the smallest id stays, once."""
    found = materialize(near_duplicates(docs, id_col, text_col), "simhash-found")
    repeats = not found.groupBy("id").count().where("count > 1").isEmpty()
    gone = found.where("id <> component").select(F.col("id").alias("_gone")).distinct()
    kept = docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
    if repeats:  # rows that share an id are copies of one document
        kept = kept.where(F.col(f"`{id_col}`").isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(f"`{id_col}`").isNull()))
    return kept
