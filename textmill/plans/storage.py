"""Queries that write to the shared folder and read back: lines, tables with headers, workbooks, discovery, exports, rewrites, streams."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators import predicates
from textmill.plans.registry import query
from textmill.session import scratch, table
from textmill.sources import files, versioned
from textmill.streaming import live

_LINES = "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'blank' WHEN 2 THEN 'invalid' WHEN 3 THEN 'not_object' ELSE 'ok' END AS status FROM events"


def _jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, some of them blank, broken or no objects."""
    e, path = F.col("event_id"), scratch(spark, "lines")
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    line = F.when(e % 5 == 1, "  ").when(e % 5 == 2, F.concat(F.lit('{"event_id": '), e.cast("string"), F.lit(","))).when(e % 5 == 3, "[1, 2]").when(e % 5 == 4, F.concat(F.lit("\ufeff"), good)).otherwise(good)
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "event_id long, event_type string, value double")


@query("s01_tolerant_lines", f"SELECT status, count(*) AS n FROM ({_LINES}) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _jsonl(spark, d).groupBy(F.col("_status").alias("status")).agg(F.count("*").alias("n"))


@query("s02_resumed_lines", "SELECT event_id, event_type, value FROM events WHERE event_id % 5 IN (0, 4)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.good_rows(_jsonl(spark, d)).select("event_id", "event_type", "value")


@query("s03_aliased_csv", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, d, "customer").select(F.col("c_custkey").alias(" Customer No "), F.col("c_name").alias("NAME"), F.col("c_mktsegment").alias("Market")).write.option("header", True).csv(path)
    return files.read_csv(spark, path, {"customer no": "id", "market": "segment"}, ["id", "name", "segment"]).select("id", "name", "segment")


def _sheet(rows: list[list[str]]) -> str:
    cells = lambda r: "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in r)
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(f"<row>{cells(r)}</row>" for r in rows)}</sheetData></worksheet>'


@F.pandas_udf(T.BinaryType())
def _workbook(keys: pd.Series, names: pd.Series) -> pd.Series:
    """A workbook whose tenth sheet comes first and whose second one holds the names."""
    book = []
    for key, name in zip(keys, names, strict=True):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Cover" sheetId="1" r:id="a"/><sheet name="Units" sheetId="2" r:id="b"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet10.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>')
            z.writestr("xl/worksheets/sheet10.xml", _sheet([["about", str(key)]]))
            z.writestr("xl/worksheets/sheet2.xml", _sheet([["Key", "Name"], [str(key), name]]))
        book.append(data.getvalue())
    return pd.Series(book)


def _workbooks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.concat(F.lit("n/"), "n_nationkey", F.lit(".xlsx")).alias("path"), _workbook("n_nationkey", "n_name").alias("content"))


@query("s04_workbook_cells", "SELECT 'n/' || n_nationkey || '.xlsx' AS path, 0::BIGINT AS row, 'about|' || n_nationkey AS cells FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.parse_workbooks(_workbooks(spark, d)).select("path", "row", F.array_join("cells", "|").alias("cells"))


@query("s05_detected_sheet", "SELECT 'n/' || n_nationkey || '.xlsx' AS path, n_nationkey || '|' || n_name AS cells FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.parse_workbooks(_workbooks(spark, d), ["key", "name"]).where("row = 1").select("path", F.array_join("cells", "|").alias("cells"))


@query("s06_discovery", "SELECT lang AS folder, count(*) AS rows FROM documents GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """JSON files below folders of a language, found by extension; their lines are counted in what was read."""
    path = scratch(spark, "tree")
    table(spark, d, "documents").select("doc_id", "lang").write.partitionBy("lang").json(path)
    found = files.discover(spark, path, ["JSON"]).where(F.length("content_hash") == 40)
    lines = F.length("content") - F.length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")).cast("binary"))
    return found.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("folder")).agg(F.sum(lines).cast("long").alias("rows"))


@query("s08_uploads", r"""SELECT doc_id || '.' || CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'HTML' WHEN 2 THEN 'csv' ELSE 'pdf' END AS path,
CASE doc_id % 4 WHEN 0 THEN 'a,b ' || source WHEN 1 THEN 'a,b ' || source WHEN 2 THEN 'x, y | "' || source || '" | ' || chr(10) || 'one two | ' || lang END AS text FROM documents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Uploads of four kinds; the CSV files have commas, quotes and line feeds inside quoted cells, an empty cell and a blank line."""
    kinds = F.array(*map(F.lit, ("txt", "HTML", "csv", "pdf")))
    body = F.concat(F.lit("a,b "), "source")
    cells = F.concat(F.lit('"x, y","""'), "source", F.lit('""",\r\n,\r\n"one\ntwo",'), "lang", F.lit("\r\n"))
    content = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<p>a,b</p><script>x</script> <b>"), "source", F.lit("</b>"))).when(F.col("doc_id") % 4 == 2, cells).otherwise(body).cast("binary")
    made = table(spark, d, "documents").select(F.concat_ws(".", "doc_id", F.get(kinds, (F.col("doc_id") % 4).cast("int"))).alias("path"), content.alias("content"))
    return files.parse_uploads(made).select("path", "text")


@query("s13_stream_sink", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of files, written as JSON lines with a checkpoint, and read back."""
    source, sink, checkpoint = (scratch(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    events = table(spark, d, "events").select("event_id", "event_type")
    events.repartition(3).write.parquet(source)
    live.json_sink(live.event_stream(spark, source, events), sink, checkpoint).awaitTermination()
    return spark.read.schema(events.schema).json(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("s14_rewritten_table", "SELECT c_custkey, 2 AS version FROM customer WHERE c_custkey % 2 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A table written, then compacted to every second row."""
    path, rows = scratch(spark, "rewritten"), table(spark, d, "customer").select("c_custkey")
    files.replace_table(rows.withColumn("version", F.lit(1)), path)
    files.replace_table(spark.read.parquet(path).where("c_custkey % 2 = 0").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path)


@query("s15_export_manifest", "SELECT 'csv' AS kind, count(*) AS rows, true AS hashed FROM documents UNION ALL SELECT 'json', count(*), true FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("="), "text").alias("text"))
    made = [files.write_export(docs, scratch(spark, kind), kind).withColumn("kind", F.lit(kind)) for kind in ("csv", "json")]
    return made[0].unionByName(made[1]).groupBy("kind").agg(F.sum("rows").alias("rows"), (F.min(F.length("sha256")) == 64).alias("hashed"))


@query("t19_synced_corpus", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each user's newest event, kept by four micro-batches: the newest events come in the first, and some of each come again in later ones."""
    source, path, checkpoint = (scratch(spark, x) for x in ("sync-in", "synced", "sync-state"))
    events = table(spark, d, "events").select("user_id", "event_id", "ts")
    for part in range(4):
        events.where((F.pmod(F.xxhash64("event_id"), F.lit(4)) == 3 - part) | (F.col("event_id") % 7 == part)).coalesce(1).write.mode("append").parquet(source)
    kept = versioned.VersionedTable(spark, path, events.schema, ["user_id"], ["ts", "event_id"], 8)
    live.sync_corpus(live.event_stream(spark, source, events), kept, checkpoint).awaitTermination()
    return kept.read().select("user_id", "event_id")


@query("p04_field_contract", """SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'group,k' WHEN event_id % 3 = 0 THEN 'group' WHEN event_id % 3 = 1 THEN 'k' ELSE '' END AS missing, count(*) AS n FROM events GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Which fields, that active filters need, the metadata of each event lacks, counted; inactive filters need nothing."""
    events = predicates.require_fields(table(spark, d, "events"), {"kinds": ["click"], "owner": None}, {"kinds": "event_type", "owner": "owner"})
    made = F.when(F.col("event_id") % 5 == 0, F.lit("[1]")).when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit('{"group":0}')).otherwise(predicates.merge_json("props", {"group": F.col("user_id")}))
    missing = predicates.missing_fields(made, {"depth": 3, "groups": ["a"], "owner": "", "none": []}, {"depth": "k", "groups": "group", "owner": "owner", "none": "x"})
    return events.groupBy("event_type", F.array_join(missing, ",").alias("missing")).agg(F.count("*").alias("n"))
