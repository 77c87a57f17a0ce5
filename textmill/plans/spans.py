"""Queries on spans, unit chunks, boilerplate and JSON walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import quotes, spans
from textmill.plans.registry import query
from textmill.session import table

DOCS = "documents"


@query("f18_sentence_chunks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", F.posexplode(spans.sentences(F.col("text"), 1000, 160)).alias("index", "chunk"))


@query("f20_table_blocks", r"""WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i FROM (SELECT doc_id, string_split(replace(text, '|', ' '), chr(10)) AS a FROM documents))
SELECT doc_id, string_agg('id: ' || doc_id || CASE WHEN trim(line, E' \t\r') <> '' THEN '; text: ' || trim(line, E' \t\r') ELSE '' END, chr(10) ORDER BY i) AS block FROM l GROUP BY doc_id, i // 8""")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split(F.replace("text", F.lit("|"), F.lit(" ")), "\n", -1), lambda x: F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" | "), x, F.lit(" |")))
    made = F.concat(F.lit("| id | text |\n|---|---|\n"), F.array_join(lines, "\n"))
    return table(spark, d, DOCS).select("doc_id", F.explode(spans.tables(made)).alias("block"))


@query("f22_span_location", """WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
SELECT doc_id, s::BIGINT AS start, (s + length(line))::BIGINT AS stop FROM p WHERE line <> ''""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a text, each looked for from where the one before ended."""
    parts = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    found = table(spark, d, DOCS).select("doc_id", F.explode(spans.located_in_order(F.col("text"), parts)).alias("s"))
    return found.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))


@query("f37_boilerplate")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", spans.cleaned(F.col("text"), [r"^Released under", r"^Licensed under"]).alias("c")).select("doc_id", F.md5("c.text").alias("text_hash"), "c.noise", "c.contact", "c.punctuation", "c.repeat")


@query("f42_page_severity", "SELECT doc_id, CASE WHEN n >= 80 AND r < 0.65 THEN 'severe' WHEN (n >= 20 AND r < 0.88) OR (n < 20 AND (1 - r) * n >= 8) OR s THEN 'moderate' ELSE 'none' END AS severity FROM (SELECT doc_id, n_chars // 20 AS n, (doc_id % 11) / 10 AS r, doc_id % 50 = 0 AS s FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    tokens, recall = F.floor(F.col("n_chars") / 20), F.col("doc_id") % 11 / 10
    return table(spark, d, DOCS).select("doc_id", spans.page_severity(tokens, recall, F.col("doc_id") % 50 == 0).alias("severity"))


_FOLDED = r"""regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}+#]', '', 'g')"""
_QUOTED = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, trim(coalesce(text, '')[31:90]) AS q FROM documents),
c AS (SELECT doc_id, i, {_FOLDED.format('text[i]')} AS f FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM t)),
p AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM (SELECT doc_id, i, unnest(range(length(f))) AS j FROM c)),
h AS (SELECT doc_id, nullif(instr({_FOLDED.format('text')}, {_FOLDED.format('q')}), 0) AS k, length({_FOLDED.format('q')}) AS n FROM t)
SELECT doc_id, (a.i - 1)::INTEGER AS start, b.i::INTEGER AS stop, NULL::INTEGER AS altered
FROM h LEFT JOIN p a USING (doc_id, k) LEFT JOIN p b ON b.doc_id = h.doc_id AND b.k = h.k + h.n - 1 WHERE n > 0"""


@query("f44_x27_quote_spans", _QUOTED)
def _(spark: SparkSession, d: str) -> DataFrame:
    """A part of every text in capitals, with other blanks and marks, found where it first stands; with one sign more inside, nowhere."""
    docs = table(spark, d, DOCS).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    part = F.trim(F.substring("text", 31, 60))
    asked = docs.select("doc_id", F.concat(F.lit("~ "), F.regexp_replace(F.upper(part), " ", " _\t")).alias("quote"), F.concat(F.lit("~ "), F.regexp_replace(part, r"([\p{L}\p{N}])([^\p{L}\p{N}]*)$", "##$1$2##")).alias("wrong"))
    found = quotes.locate(asked.where(quotes.comparable("quote") != ""), docs, "doc_id", "quote", "text")
    found = quotes.locate(found, docs, "doc_id", "wrong", "text", "w")
    return found.select("doc_id", F.col("span.start").alias("start"), F.col("span.end").alias("stop"), F.col("w.start").alias("altered"))


@query("f49_json_ids", "SELECT event_id, props->>'$.k' AS id FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit('{"a": [[{"k": '), F.get_json_object("props", "$.k"), F.lit("}]]}"))
    return table(spark, d, "events").select("event_id", F.explode(spans.ids_in(made, ("k",))).alias("id"))


@query("f50_canonical_json", """SELECT event_id, '{"a":' || (props->>'$.k') || ',"b":"' || event_type || '"}' AS doc FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit('{"b": "'), "event_type", F.lit('", "a": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, d, "events").select("event_id", spans.canonical_json(made).alias("doc"))


@query("f52_trigger_matches", r"SELECT item_id, regexp_matches(t, '(^|[^\p{L}\p{N}])the([^\p{L}\p{N}]|$)')::INT + regexp_matches(t, '(^|[^\p{L}\p{N}])of([^\p{L}\p{N}]|$)')::INT AS matches FROM (SELECT item_id, lower(text) AS t FROM benchmark)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", spans.trigger_matches(F.col("text"), ["the", "of"]).alias("matches"))
