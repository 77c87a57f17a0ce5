"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Built from DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialize

SHINGLE = 5
CONTAINMENT = 0.8
BROADCAST_ROWS = 200_000  # rows of sketches or item shingles (some 50 bytes each) that may be broadcast; beyond it the join shuffles
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) of candidates that may be broadcast; beyond it the join shuffles


def words(text: str | Column) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(column.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _each(array: Column, make) -> Column:  # noqa: ANN001
    """``make(words, i)`` for the first position i of every five words."""
    return let(
        array,
        lambda w: F.when(
            F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))), lambda i: make(w, i))
        ).otherwise(F.array()),
    )


def shingle_hashes(words_of: Column) -> Column:
    """A 64-bit hash of every five words."""
    return _each(F.transform(words_of, lambda x: F.xxhash64(x)), lambda w, i: F.xxhash64(*(F.element_at(w, (i + k).cast("int")) for k in range(SHINGLE))))


def shingle_texts(words_of: Column) -> Column:
    return F.array_distinct(_each(words_of, lambda w, i: F.array_join(F.slice(w, i, F.lit(SHINGLE)), " ")))


def item_sketches(items: DataFrame, id_col: str, text_col: str, containment: float) -> tuple[DataFrame, DataFrame]:
    """Each item's distinct shingles, and its bottom-k MinHash sketch.

    k depends on the item's size n: a document that holds at least containment * n of its shingles misses at most
    n - ceil(containment * n) of them, so it holds one of any k = that + 1. The k smallest hashes are such a set, and
    items are partitioned by size, k being one number for each size: no document is ever missed, however long it is.
    """
    texts = items.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("item_id"), words(F.col(f"`{text_col}`")).alias("words"))
    # rows that share an item id are one item
    shingles = materialize(
        texts.select("item_id", F.explode(shingle_texts(F.col("words"))).alias("s")).groupBy("item_id").agg(F.array_sort(F.collect_set("s")).alias("shingles")),
        "item-shingles",
    )
    sizes = shingles.withColumn("n", F.size("shingles")).withColumn("k", F.col("n") - F.ceil(F.col("n") * F.lit(containment) - 1e-9).cast("int") + 1)
    hashed = sizes.select("item_id", "n", "k", F.transform("shingles", lambda s: F.split(s, " ")).alias("split"))
    hashed = hashed.withColumn("hashes", F.array_distinct(F.transform("split", lambda w: F.xxhash64(*(F.xxhash64(F.element_at(w, k + 1)) for k in range(SHINGLE))))))
    sketch = materialize(hashed.select("item_id", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), F.col("k"))).alias("h")), "item-sketches")
    return shingles, sketch


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each document with at least ``containment`` of an item's shingles.

    Words are lower-case runs of letters and digits, shingles five of them, each counted once. Every shingle of every
    whole text is probed against the items' sketches; the shingles of documents that share a sketch value, and of no others, are joined to
    the items' on their texts and counted. Sketches, shingles and ids are broadcast only after their rows were counted.

    Texts or items of fewer than five words, null texts, and rows with null ids match nothing. Repeated rows give one row
    a pair, with the largest containment. Empty tables give an empty result. Column names may clash between the tables.
    """
    shingles, sketch = item_sketches(items, item_id_col, item_text_col, containment)
    bounds = sketch.agg(F.count("*").alias("rows"), F.max("h").alias("top")).first()
    wanted = sketch if bounds["rows"] > BROADCAST_ROWS else F.broadcast(sketch)
    top = bounds["top"] if bounds["rows"] else -(1 << 63)
    known = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hashed = known.select("doc_id", F.filter(shingle_hashes(words("text")), lambda h: h <= F.lit(top)).alias("hashes"))
    candidates = materialize(hashed.select("doc_id", F.explode("hashes").alias("h")).join(wanted, "h", "left_semi").select("doc_id").distinct(), "leak-candidates")
    few = candidates.count() <= BROADCAST_IDS
    held = known.join(F.broadcast(candidates) if few else candidates, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("tag"), F.explode(shingle_texts(words("text"))).alias("s"))
    parts = shingles.select("item_id", F.explode("shingles").alias("s"))
    shared = held.join(F.broadcast(parts) if bounds["rows"] and parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else parts, "s")
    # rows that share id and text are counted once
    counts = shared.groupBy("doc_id", "tag", "item_id").agg(F.count_distinct("s").alias("n_shared")).groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"))
    sizes = shingles.select("item_id", F.size("shingles").cast("long").alias("n_item"))
    return (
        counts.join(sizes, "item_id").select("doc_id", "item_id", "n_item", "n_shared")
        .where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(containment) - 1e-9))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item."""
    leaks = materialize(contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias("_leaks")).distinct(), "leaks")
    return docs.join(leaks, F.col(f"`{id_col}`") == F.col("_leaks"), "left_anti")
