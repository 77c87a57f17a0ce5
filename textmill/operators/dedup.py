"""Survivorship, copies, greedy diversification and fallbacks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The preferred row of each key; Catalyst keeps one candidate a partition before the shuffle."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_i = 1").drop("_i")


def first_non_empty(branches: list[DataFrame], order: list[Column]) -> DataFrame:
    """One row from the first branch that has any."""
    union = None
    for i, b in enumerate(branches):
        b = b.withColumn("_branch", F.lit(i))
        union = b if union is None else union.unionByName(b)
    return union.orderBy("_branch", *order).limit(1).drop("_branch")


def with_copies(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("_key", key).withColumn("copies", F.count("*").over(Window.partitionBy("_key"))).drop("_key")


def latest_open(errors: DataFrame, done: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    open_rows = errors.join(done.select(key).distinct(), key, "left_anti")
    return open_rows.groupBy(key).agg(F.max_by(column, F.struct(*order)).alias(column))


def near_duplicate_units(a: str, b: str, ratio: float = 0.85) -> bool:
    """Equal texts, or the shorter inside the longer with lengths alike."""
    short, long = sorted((a, b), key=len)
    return a == b or (bool(short) and short in long and len(short) / len(long) >= ratio)


def diversify(units: DataFrame, keys: list[str], order: str, text_col: str, limit: int) -> DataFrame:
    """The first ``limit`` units of each key that are no near-duplicates of one taken before: greedy, so in one pass over a key's rows in order.

    Of a key's equal texts, folded to lower case and single spaces, only the earliest row can be taken, so the others are left out
    before. The rest is streamed in order, and a key's rows are skipped once its limit is met.
    """
    folded = F.array_join(F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), lambda x: x != ""), " ")
    rows = units.withColumn("_folded", folded).withColumn("_hash", F.sha2("_folded", 256))
    first = rows.groupBy(*keys, "_hash").agg(F.min_by(F.struct(*units.columns, "_folded"), F.struct(order, text_col)).alias("_row")).select("_row.*")
    names = units.columns

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, taken = None, []
        for batch in batches:
            kept = []
            for i, (here, text) in enumerate(zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("_folded").to_pylist())):
                if here != key:
                    key, taken = here, []
                if len(taken) < limit and not any(near_duplicate_units(text, t) for t in taken):
                    taken.append(text)
                    kept.append(i)
            yield batch.select(names).take(pa.array(kept, pa.int64()))

    return first.repartition(*keys).sortWithinPartitions(*keys, order, text_col).mapInArrow(pick, units.schema)
