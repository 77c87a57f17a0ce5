"""Queries on order-dependent selection and on conversations and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text
from textmill.operators import dedup, ranking, rollups, selection
from textmill.plans.registry import query
from textmill.session import table
from textmill.sources import files


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    found = ranking.bm25(table(spark, d, "documents"), table(spark, d, "benchmark").withColumnRenamed("text", "question"), "doc_id", "text", "item_id", "question", 21)
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    return found.join(docs, "doc_id").select(
        F.col("item_id").alias("query_id"), F.col("doc_id").cast("string").alias("id"), "rank", F.col("lang").alias("scope"), "source", F.lit("").alias("family"), F.lit("").alias("evidence"), F.array_distinct(ranking.terms("text")).alias("terms")
    )


@query("k11_quota_selection")
def _(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_with_quotas(_ranked(spark, d), {"fr": 1, "de": 1, "en": 2}, 8, ["the", "of", "la"])


@query("k12_prefix_reorder")
def _(spark: SparkSession, d: str) -> DataFrame:
    return selection.reorder_prefix(_ranked(spark, d), 8, {"en": 3, "es": 1})


@query("k07_unit_diversification")
def _(spark: SparkSession, d: str) -> DataFrame:
    units = dedup.diversify(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", limit=8)
    first, _ = ranking.overfetch(16)
    return units.orderBy("turn", "conv_id", "text").limit(first).select("conv_id", "turn")


@query("k14_covering_units")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = selection.covering_units(table(spark, d, "conversations"), ["conv_id"], "turn", "turn", "text", ["of", "the"], 4000)
    return found.select("conv_id", F.array_join(F.transform("units", lambda x: x.cast("string")), ",").alias("units"))


@query("k15_exact_fact_scores", """WITH f AS (SELECT o_custkey % 50 AS query_id, o_custkey AS group_id, o_orderpriority AS identity, count(*) OVER (PARTITION BY o_orderpriority) AS df, o_orderstatus = 'F' AS phrase, o_totalprice > 200000 AS authority FROM orders), n AS (SELECT greatest(1, count(*)) AS n FROM orders),
i AS (SELECT query_id, group_id, identity, max(ln((n + 1) / (greatest(1, least(n, df)) + 1)) + 1 + CASE WHEN phrase THEN 0.35 ELSE 0.15 END + CASE WHEN authority THEN 0.45 ELSE 0 END) AS s FROM f, n GROUP BY 1, 2, 3)
SELECT query_id, group_id, round(max(s) + least(0.75, 0.25 * (count(*) - 1)), 6) AS score FROM i GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    df = orders.groupBy("o_orderpriority").agg(F.count("*").alias("df"))
    facts = orders.join(df, "o_orderpriority").select(
        (F.col("o_custkey") % 50).alias("query_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("identity"), "df", (F.col("o_orderstatus") == "F").alias("phrase"), (F.col("o_totalprice") > 200000).alias("authority")
    )
    return selection.exact_fact_scores(facts, orders.count())


@query("k16_structural_scores", "SELECT l_orderkey, l_linenumber, round(l_tax * 10 + CASE WHEN l_discount > 0.05 THEN 4 ELSE 0 END + 1 / log2(l_quantity + 2), 6) AS score FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 10).alias("idf_sum"), (F.col("l_discount") > 0.05).alias("complete"), F.col("l_quantity").alias("length"))
    return selection.structural_scores(hits).select("l_orderkey", "l_linenumber", "score")


@query("u11_near_duplicate_units", "SELECT a.conv_id, a.turn, b.turn AS other FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE lower(a.text) = lower(b.text) OR (least(length(a.text), length(b.text)) >= 0.85 * greatest(length(a.text), length(b.text)) AND (contains(lower(a.text), lower(b.text)) OR contains(lower(b.text), lower(a.text))))")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.lower("text").alias("t"))
    a, b = rows.alias("a"), rows.alias("b")
    n, m = F.char_length("a.t"), F.char_length("b.t")
    alike = (F.col("a.t") == F.col("b.t")) | ((F.least(n, m) >= 0.85 * F.greatest(n, m)) & (F.contains("a.t", "b.t") | F.contains("b.t", "a.t")))
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn"))).where(alike).select("a.conv_id", "a.turn", F.col("b.turn").alias("other"))


@query("x03_restored_scores", "SELECT n_nationkey, coalesce(score, 0) AS score FROM nation LEFT JOIN (SELECT s_nationkey, round(max(s_acctbal), 2) AS score FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey ORDER BY score DESC, n_nationkey LIMIT 15")
def _(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.round(F.max("s_acctbal"), 2).alias("score"))
    rows = table(spark, d, "nation").join(best, "n_nationkey", "left").select("n_nationkey", F.coalesce("score", F.lit(0.0)).alias("score"))
    return rows.orderBy(F.desc("score"), "n_nationkey").limit(15)


@query("x05_cache_accounting", "SELECT count(*) FILTER (WHERE c.h IS NOT NULL) AS hits, count(*) FILTER (WHERE c.h IS NULL) AS misses FROM (SELECT DISTINCT md5(text) AS h FROM documents) k LEFT JOIN (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 = 0) c USING (h)")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    stored = keys.where("doc_id % 3 = 0").select("h").distinct().withColumn("there", F.lit(True))
    return keys.select("h").distinct().join(stored, "h", "left").agg(F.count("there").alias("hits"), F.count_if(F.col("there").isNull()).alias("misses"))


@query("x09_page_texts", "SELECT source, string_agg(text, ' ' ORDER BY first_id) AS text FROM (SELECT source, text, min(doc_id) AS first_id FROM documents GROUP BY 1, 2) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "documents").select("source", "doc_id", "text", F.sha2("text", 256).alias("hash"))
    first = blocks.groupBy("source", "hash").agg(F.min_by("text", "doc_id").alias("block"), F.min("doc_id").alias("first_id"))
    ordered = F.array_sort(F.collect_list(F.struct("first_id", "block")))
    return first.groupBy("source").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), " ").alias("text"))


@query("x11_conversation_catalog", "SELECT conv_id, count(*) FILTER (WHERE role IN ('user','assistant') AND trim(text) <> '') AS turns, min(turn) AS first_turn, max(turn) AS last_turn, bool_or(role = 'user') AND bool_or(role = 'assistant') AS has_rehearsal FROM conversations GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    valid = F.col("role").isin("user", "assistant") & (F.trim("text") != "")
    both = F.bool_or(F.col("role") == "user") & F.bool_or(F.col("role") == "assistant")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(valid).alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), both.alias("has_rehearsal"))


@query("x15_experience_grades", "SELECT user_id, CASE WHEN max(value) > 4 * quantile_disc(value, 0.95) THEN 'poor' WHEN quantile_disc(value, 0.95) <= 30 THEN 'good' ELSE 'fair' END AS grade FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = rollups.latency_summary(table(spark, d, "events"), ["user_id"], "value")
    return found.select("user_id", F.when(F.col("top") > 4 * F.col("p95"), "poor").when(F.col("p95") <= 30, "good").otherwise("fair").alias("grade"))


@query("x17_fixture_expansion", "SELECT count(*) AS cases, count(DISTINCT n_nationkey || ':' || r_regionkey) = count(*) AS is_unique FROM nation, region")
def _(spark: SparkSession, d: str) -> DataFrame:
    cases = ranking.beside(table(spark, d, "nation"), table(spark, d, "region")).select(F.concat_ws(":", "n_nationkey", "r_regionkey").alias("id"))
    return cases.agg(F.count("*").alias("cases"), (F.count_distinct("id") == F.count("*")).alias("is_unique"))


@query("x20_workload_resize", "WITH s AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id || '#' || c AS id, md5(CASE WHEN c > 0 THEN text || ' [copy ' || c || ']' ELSE text END) AS text_hash FROM s, range(0, 3) r(c) WHERE pos + c * n < (5 * n) // 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Sources cycled until there are two and a half times as many documents, each copy with a text of its own."""
    resized = selection.cycle(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 2.5)
    text_of = F.when(F.col("copy") > 0, F.concat("text", F.lit(" [copy "), "copy", F.lit("]"))).otherwise(F.col("text"))
    return resized.select(F.concat_ws("#", "doc_id", "copy").alias("id"), F.md5(text_of).alias("text_hash"))


@query("x21_export_cells", "SELECT event_id, '' AS nothing, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, '''@' || event_type AS cell FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.coalesce(F.lit(None).cast("string"), F.lit("")).alias("nothing"), (F.col("event_id") % 2 == 0).cast("string").alias("flag"), text.escape_cell(F.concat(F.lit("@"), "event_type")).alias("cell")
    )


@query("x22_cue_deltas", "SELECT conv_id, turn, CASE WHEN text LIKE '%thank%' THEN 8 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '(^| )not ') THEN -18 ELSE 5 END AS delta FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    negative = F.lower("text").rlike("(^| )not ")
    delta = F.when(F.col("text").contains("thank"), 8).otherwise(0) + F.when(negative, -18).otherwise(5)
    return table(spark, d, "conversations").select("conv_id", "turn", delta.alias("delta"))


@query("x33_missing_index_rows", "SELECT count(*) AS documents, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.lit(True).alias("there"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").agg(F.count("*").alias("documents"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("k03_index_choice", "SELECT label, count(*) >= 50 OR label = 3 AS approximate FROM embeddings GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return sizes.select("label", ranking.ann_eligible(F.col("n"), 50, F.col("label") == 3).alias("approximate"))


@query("k06_overfetch", """WITH f AS (SELECT * FROM (SELECT source, doc_id, n_chars, md5(text) AS h, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i FROM documents) WHERE i <= 48),
u AS (SELECT source, h, min(i) AS i, arg_min(doc_id, i) AS doc_id FROM f GROUP BY 1, 2) SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS j FROM u) WHERE j <= 12""")
def _(spark: SparkSession, d: str) -> DataFrame:
    first, more = ranking.overfetch(3)
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", F.md5("text").alias("h"))
    fetched = ranking.top_k(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], more, "i")
    return ranking.top_k(dedup.first_per_key(fetched, ["source", "h"], [F.col("i")]), ["source"], [F.col("i")], first).select("source", "doc_id")


@query("t11_lease_replay", "WITH f AS (SELECT *, 4 - sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey) AS free FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS place FROM f WHERE o_orderstatus <> 'F') SELECT o_orderkey FROM w WHERE place <= free")
def _(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "orders").withColumn("active", F.col("o_orderstatus") == "F")
    return ranking.admitted(requests, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")], 4, "active").select("o_orderkey")


@query("s19_metadata", "WITH h AS (SELECT 'rows:' || event_type || ':' || user_id AS key, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS a, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS b FROM events GROUP BY 1) SELECT key, CASE WHEN b > 0 THEN b ELSE a END::VARCHAR AS value FROM h")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A store of key and value texts, loaded from the first half of the events and saved over from the second."""
    def load(condition: str) -> DataFrame:
        keyed = table(spark, d, "events").where(condition).groupBy(F.concat_ws(":", F.lit("rows"), "event_type", "user_id").alias("key"))
        return keyed.agg(F.count("*").cast("string").alias("value"))

    return files.upsert(load("ts < '2024-01-15'"), load("ts >= '2024-01-15'"), ["key"])
