"""A corpus pipeline: each stage reads what its predecessor kept and is written as Parquet before the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import decontamination, language_id, line_dedup, packing, simhash
from textmill.llm.common import discard, scratch_path
from textmill.llm.queries import PACK_END, pack_tokenizer
from textmill.session import table


def _same(docs: DataFrame) -> list:
    """The columns of ``docs`` by their names, whatever these hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: those that are null or have no letter.

    An empty table stays empty, as in all stages; where no document has a label nothing goes. Null ids, repeated rows and columns of any name are kept as they are.
    """
    return language_id.known_language(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to three or more documents stay in the last one only; n_chars follows the text.

    Null texts become empty. Rows without an id lose no line and keep none from others; rows that share an id are one document.
    """
    kept = line_dedup.clean_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(_same(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that with the smallest id; of rows that share an id, one. Rows without an id stay.

    Null and empty texts have fingerprint zero and are one group.
    """
    return simhash.keep_one(docs).select(_same(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null texts and those of fewer than five words hold none; rows without an id stay. An empty benchmark removes nothing.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(_same(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of at most 4096 ids; a null text is its end id alone, and null ids and repeated rows are packed as any other."""
    pieces = packing.pack(docs, pack_tokenizer(), PACK_END)
    return pieces.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: The language stage is learned from the data, and SimHash needs XXH64: neither can be said in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:  # nothing reads the stage before any more
            discard(last)
        docs = last = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
