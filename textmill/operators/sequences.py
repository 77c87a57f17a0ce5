"""Order-dependent folds over the rows of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], Any], finish: Callable[[Any], tuple], schema: str) -> DataFrame:
    """``step`` over the rows of each key in order, from ``start()``: (keys, ``finish`` of the last state), as ``schema`` says.

    Rows are sorted inside their key's partition (which spills) and streamed, so a key with any number of rows needs the memory of its state.
    """
    fields = [f.strip().split()[0] for f in schema.split(",")]
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[] for _ in fields]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], fields)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                here = row[: len(keys)]
                if here != key:
                    if key is not None:
                        done.append((*key, *finish(state)))
                    key, state = here, start()
                state = step(state, row[len(keys) :])
            yield out()
        if key is not None:
            done.append((*key, *finish(state)))
            yield out()

    rows = df.select(*dict.fromkeys([*keys, *order, *values])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.select(*keys, *values).mapInArrow(run, schema)


def key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def clamped_sum(df: DataFrame, keys: list[str], order: list[str], delta: str, low: int, high: int, name: str) -> DataFrame:
    """A running sum that is clamped at every step, after the last one; not a clamped total."""
    return fold(df, keys, order, [delta], lambda: 0, lambda s, row: max(low, min(high, s + row[0])), lambda s: (s,), f"{key_schema(df, keys)}, {name} long")


def budget_reservations(df: DataFrame, keys: list[str], order: list[str], amount: str, cap: float) -> DataFrame:
    """Each request in order is granted if it still fits under the cap; a rejected one uses nothing."""

    def step(s: tuple[float, int, int], row: tuple) -> tuple[float, int, int]:
        used, granted, rejected = s
        return (used + row[0], granted + 1, rejected) if used + row[0] <= cap else (used, granted, rejected + 1)

    found = fold(df.withColumn("_amount", F.col(amount).cast("double")), keys, order, ["_amount"], lambda: (0.0, 0, 0), step, lambda s: s, f"{key_schema(df, keys)}, used double, granted long, rejected long")
    return found.withColumn("used", F.round("used", 4))


def compare_and_set(df: DataFrame, keys: list[str], order: list[str], expected: str, owner: str, release: str, modulus: int | None = None) -> DataFrame:
    """(keys, revision, owner, stale, foreign_owner): updates in order, each made only if it expects the current revision and nobody else owns the state.

    An update that is made raises the revision by one and takes the state, or gives it back where ``release``. One that expects another revision
    counts as ``stale``, one against another owner as ``foreign_owner``. Revisions are compared modulo ``modulus`` if there is one. A null
    expectation is stale; a null owner owns nothing and is refused only by others.
    """

    def step(s: tuple, row: tuple) -> tuple:
        revision, held, stale, foreign = s
        wanted, by, gives = row
        if wanted is None or wanted != (revision % modulus if modulus else revision):
            return revision, held, stale + 1, foreign
        if held is not None and held != by:
            return revision, held, stale, foreign + 1
        return revision + 1, None if gives else by, stale, foreign

    schema = f"{key_schema(df, keys)}, revision long, owner string, stale long, foreign_owner long"
    return fold(df, keys, order, [expected, owner, release], lambda: (0, None, 0, 0), step, lambda s: s, schema)


def overflow(df: DataFrame, keys: list[str], order: list[str], raw_window: int, batch: int) -> DataFrame:
    """The rows before the last ``raw_window``, cut to whole batches."""
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    whole = F.floor(F.greatest(F.col("_n") - raw_window, F.lit(0)) / batch) * batch
    return ranked.where(F.col("_i") <= whole).drop("_i", "_n")
