"""Sources and sinks: tolerant JSON lines, strict CSV, workbooks, Markdown, discovery, escaped exports, keyed upserts."""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.text import escape_cell, parse_html


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with a ``_status`` of ok, blank, invalid or not_object for each line; strict fails on the first bad one."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("_status", F.lit("ok"))
    line = F.regexp_replace("value", "^﻿", "")
    parsed = spark.read.text(path).select(line.alias("value")).withColumn("_variant", F.try_parse_json("value"))
    status = (
        F.when(F.trim("value") == "", "blank").when(F.col("_variant").isNull(), "invalid").when(~F.trim("value").startswith("{"), "not_object").otherwise("ok")
    )
    return parsed.select(F.from_json("value", schema).alias("row"), status.alias("_status")).select("row.*", "_status")


def good_rows(df: DataFrame) -> DataFrame:
    return df.where("_status = 'ok'").drop("_status")


def read_csv(spark: SparkSession, path: str, aliases: dict[str, str], required: list[str]) -> DataFrame:
    """CSV with header aliases; missing, unexpected and repeated columns are errors that name them."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [aliases.get(c.strip().lower(), c.strip().lower()) for c in df.columns]
    problems = [f"missing {c}" for c in required if c not in names] + [f"unexpected {c}" for c in names if c not in {*required, *aliases.values()}]
    problems += sorted({f"repeated {c}" for c in names if names.count(c) > 1})
    if problems:
        raise ValueError("; ".join(problems))
    return df.toDF(*names)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


_BOOK_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet_files(book: zipfile.ZipFile) -> list[str]:
    """The parts of a workbook's sheets in the order of its tabs."""
    names = book.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = [targets.get(s.get(_BOOK_RELATION), "") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        found = [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in found]
        if found and all(f in names for f in found):
            return found
    numbered = [(int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n))]
    return [n for _, n in sorted(numbered)]


def workbook_rows(content: bytes, required: list[str] | None = None) -> list[list[str]]:
    """The cells of a workbook's first sheet, or of the first one whose first row holds all ``required`` headers (none: no rows)."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        for sheet in _sheet_files(book):
            rows = []
            for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_MAIN}row"):
                cells: list[str] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = 0
                    for letter in re.match("[A-Z]+", cell.get("r", "A"))[0]:
                        at = at * 26 + ord(letter) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value, inline = cell.find(f"{_MAIN}v"), cell.find(f"{_MAIN}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t")) if inline is not None else (value.text or "" if value is not None else "")
                    cells.append(shared[int(text)] if cell.get("t") == "s" and text else text)
                rows.append(cells)
            headers = {c.strip().lower() for c in rows[0]} if rows else set()
            if required is None or {r.lower() for r in required} <= headers:
                return rows
    return []


def parse_workbooks(files: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(path, content) -> (path, row, cells); files are parsed where they lie."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = workbook_rows(content, required)
                yield pd.DataFrame({"path": name, "row": range(len(rows)), "cells": rows})

    return files.select("path", "content").mapInPandas(parse, "path string, row long, cells array<string>")


def read_workbooks(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    return parse_workbooks(discover(spark, path, ["xlsx"]), required)


def discover(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """Files under a path with their content and its SHA-1; contents are read only where a query uses them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions])
    return files.where(wanted).select("path", "length", F.sha1("content").alias("content_hash"), "content")


def in_batches(df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of ``size``, a partition at a time, as a server-side cursor gives them; the next partition is prepared meanwhile."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


@F.pandas_udf(T.StringType())
def csv_lines(texts: pd.Series) -> pd.Series:
    def lines(text: str | None) -> str | None:
        if text is None:
            return None
        rows = csv.reader(io.StringIO(text, newline=""))
        return "\n".join(" | ".join(" ".join(cell.split()) for cell in row) for row in rows if any(cell.strip() for cell in row))

    return texts.map(lines)


def parse_uploads(files: DataFrame) -> DataFrame:
    """(path, content) of text, Markdown, CSV and HTML files -> (path, kind, text); other kinds have no text.

    A CSV file's rows are lines of cells apart by `` | ``, read with quotes, doubled quotes and line feeds inside cells; blank lines go.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    plain = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    rows = files.select("path", kind.alias("kind"), plain.alias("plain"))
    text = F.when(F.col("kind").isin("htm", "html"), parse_html("plain")["content"]).when(F.col("kind") == "csv", csv_lines("plain")).when(F.col("kind").isin("txt", "md"), F.col("plain"))
    return rows.select("path", "kind", text.alias("text"))


_SECTION = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]))


def markdown_sections(text: str | None) -> list[dict]:
    """Sections by heading with their heading path, first line and text; headings in code fences do not count."""
    sections, stack, fenced = [{"title": "", "level": 0, "path": "", "start": 1, "text": []}], [], False
    for number, line in enumerate((text or "").split("\n"), 1):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        heading = None if fenced else re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
        if heading:
            level = len(heading[1])
            stack = [x for x in stack if x[0] < level] + [(level, heading[2])]
            sections.append({"title": heading[2], "level": level, "path": " > ".join(x[1] for x in stack), "start": number, "text": []})
        else:
            sections[-1]["text"].append(line)
    return [s | {"text": "\n".join(s["text"]).strip()} for s in sections if s["level"] or any(x.strip() for x in s["text"])]


@F.pandas_udf(_SECTION)
def sections(texts: pd.Series) -> pd.Series:
    return texts.map(markdown_sections)


def heading_tree(heads: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """Each heading's parent (the nearest before it of a lower level), chapter (level 1) and the last section of its subtree."""
    levels = range(1, 7)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    at = lambda n: F.when(F.col(level) == n, F.col(order))
    parent = F.greatest(*(F.when(F.col(level) > n, F.last(at(n), True).over(before)) for n in levels))
    follower = F.least(*(F.when(F.col(level) >= n, F.first(at(n), True).over(after)) for n in levels))
    chapter = F.when(F.col(level) == 1, F.col(order)).otherwise(F.last(at(1), True).over(before))
    last = F.max(order).over(Window.partitionBy(key))
    return heads.select(key, order, level, parent.alias("parent"), chapter.alias("chapter"), F.coalesce(follower - 1, last).alias("subtree_end"))


def write_export(df: DataFrame, path: str, kind: str) -> DataFrame:
    """CSV with formula-safe cells, or JSON lines, in gzip parts -> the manifest (part, bytes, sha256, rows) that is written beside them.

    One archive would pass through one task; each part is written and hashed where it lies.
    """
    safe = df.select(*(escape_cell(F.col(c)).alias(c) if t == "string" and kind == "csv" else F.col(c) for c, t in df.dtypes))
    writer = safe.write.mode("overwrite").option("compression", "gzip")
    writer.option("header", True).option("escape", '"').csv(f"{path}/parts") if kind == "csv" else writer.json(f"{path}/parts")
    spark = df.sparkSession
    parts = spark.read.format("binaryFile").load(f"{path}/parts/*.gz").select(F.col("path").alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/parts") if kind == "csv" else spark.read.schema(safe.schema).json(f"{path}/parts"))
    rows = back.groupBy(F.input_file_name().alias("part")).agg(F.count("*").alias("rows"))
    name = lambda c: F.element_at(F.split(c, "/"), -1).alias("part")
    manifest = parts.select(name("part"), "bytes", "sha256").join(rows.select(name("part"), "rows"), "part", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _filesystem(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str) -> None:
    """Rewrite a Parquet folder: staged beside it, then the old one is renamed away and the new one in; an empty result leaves none.

    The rows are whole before anything is renamed, and if the second rename fails the old folder comes back. Between the two
    renames a reader can find no folder, as the file system has no exchange.
    """
    spark = df.sparkSession
    staged, away = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.parquet(staged)
    target, fs = _filesystem(spark, path)
    source, old = _filesystem(spark, staged)[0], _filesystem(spark, away)[0]
    empty = spark.read.schema(df.schema).parquet(staged).isEmpty()
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} cannot be replaced")
    if not empty and not fs.rename(source, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{staged} cannot be put in place")
    for left in (old, source):
        fs.delete(left, True)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows replace stored ones with their keys, others stay: anti-join and union, as Parquet takes no MERGE."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def insert_new(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Only fresh rows with keys that are not stored are added; the first of equal keys wins."""
    return stored.unionByName(fresh.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def keep_last(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """A bounded log: the last ``most`` rows."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(most)
