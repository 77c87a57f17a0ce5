"""Join shapes: latest row, ordered lists, flags, neighbour bands, containment, state differences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.session import written

SMALL_FACTS = 5_000


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row with the largest order of each key, by one aggregate: partial results merge before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_latest")).select(*keys, "_latest.*")


def ordered_list(df: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def with_flag(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str) -> DataFrame:
    found = right.select(F.col(right_key).alias("_key")).distinct().withColumn("_there", F.lit(True))
    return left.join(found, F.col(left_key) == F.col("_key"), "left").withColumn(name, F.coalesce("_there", F.lit(False))).drop("_key", "_there")


def neighbours(anchors: DataFrame, rows: DataFrame, keys: list[str], position: str, width: int) -> DataFrame:
    """Rows 1 to ``width`` places from an anchor with the same keys: each anchor is dealt to its places, so the join stays an equi-join."""
    steps = [i for i in range(-width, width + 1) if i]
    wanted = anchors.select(*keys, F.col(position).alias("anchor"), F.explode(F.array(*map(F.lit, steps))).alias("_step")).withColumn("neighbour", F.col("anchor") + F.col("_step"))
    there = rows.withColumnRenamed(position, "neighbour")
    return wanted.join(there, [*keys, "neighbour"]).withColumn("distance", F.abs("_step").cast("long")).drop("_step")


def normalized(text: str) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def rarest_words(facts: DataFrame, fact_col: str) -> DataFrame:
    """Facts with ``_fact``, their normalised form, and ``_first``, the word of theirs that fewest facts have, then the longest, then the first by alphabet."""
    plain = facts.select(fact_col, normalized(fact_col).alias("_fact")).distinct().where(F.trim("_fact") != "")
    each = plain.select(fact_col, "_fact", F.explode(F.array_distinct(F.split(F.trim("_fact"), " "))).alias("_first"))
    common = each.groupBy("_first").agg(F.count("*").alias("_n"))
    return each.join(common, "_first").groupBy(fact_col, "_fact").agg(F.min_by("_first", F.struct("_n", (-F.char_length("_first")).alias("_l"), "_first")).alias("_first"))


_WORD = re.compile(r"[^\W_]+")


def _held(shared, names: list[str]) -> Callable:  # noqa: ANN001
    """(text, other columns) -> the other columns beside the number of each fact that the text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = shared.value
        for batch in batches:
            rows, facts = [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                words = _WORD.findall((text or "").lower())
                found = by_word.keys() & set(words)
                plain = f" {' '.join(words)} " if found else ""
                for word in found:
                    mine = [n for n, fact in by_word[word] if fact in plain]
                    rows += [i] * len(mine)
                    facts += mine
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), pa.array(facts, pa.int32())], names)

    return run


def contained_facts(queries: DataFrame, facts: DataFrame, query_col: str, fact_col: str, keep: list[str] | None = None) -> DataFrame:
    """Facts whose normalised words stand in a query as whole words, beside the query's columns, or those of ``keep``.

    Facts meet queries on the word that fewest facts have; of equally rare words the longest, then the first by alphabet: facts that all begin
    alike still spread over their other words. SMALL_FACTS facts at most are broadcast by that word, and each query is read once where it
    lies; more are joined on it. A fact without words is in no query.
    """
    keep = keep or queries.columns
    keyed = written(rarest_words(facts, fact_col), "keyed-facts")
    asked = keyed.limit(SMALL_FACTS + 1).collect()
    if len(asked) > SMALL_FACTS:
        said = queries.withColumn("_query", normalized(query_col)).withColumn("_first", F.explode(F.array_distinct(F.split(F.trim("_query"), " "))))
        return said.join(keyed, "_first").where(F.contains("_query", "_fact")).select(*keep, *keyed.drop("_fact", "_first").columns)
    spark, by_word = queries.sparkSession, {}
    for n, r in enumerate(asked):
        by_word.setdefault(r._first, []).append((n, r._fact))
    number = T.StructField("_n", T.IntegerType())
    out = T.StructType([*(queries.schema[c] for c in keep), number])
    found = queries.select(F.col(query_col).alias("_text"), *keep).mapInArrow(_held(spark.sparkContext.broadcast(by_word), out.names), out)
    named = spark.createDataFrame([(n, r[fact_col]) for n, r in enumerate(asked)], T.StructType([number, facts.schema[fact_col]]))
    return found.join(F.broadcast(named), "_n").drop("_n")


def with_stats(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """A single aggregate row beside every row; one row is a proven bound for the broadcast."""
    return df.join(F.broadcast(one_row.limit(1)), F.lit(True))


def state_diff(source: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, hash, path) of both sides -> new, removed, changed, relocated or current."""
    s, t = source.alias("s"), stored.alias("t")
    state = (
        F.when(F.col("t.id").isNull(), "new").when(F.col("s.id").isNull(), "removed")
        .when(~F.col("s.hash").eqNullSafe(F.col("t.hash")), "changed").when(F.col("s.path") != F.col("t.path"), "relocated").otherwise("current")
    )
    return s.join(t, F.col("s.id") == F.col("t.id"), "full").select(F.coalesce("s.id", "t.id").alias("id"), state.alias("state"))


def adjacent_pairs(turns: DataFrame, first: str, second: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    paired = turns.withColumn("_next", F.lead("role").over(w)).withColumn("reply", F.lead("text").over(w))
    return paired.where((F.col("role") == first) & (F.col("_next") == second)).drop("_next")
