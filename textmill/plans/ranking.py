"""Queries on windows, ranking, fusion, set operations and survivorship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.operators import dedup, graph_index, inverted, ranking, sequences
from textmill.plans.registry import query
from textmill.session import table

W = Window.partitionBy


# ---- windows


@query("w01_version_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(W("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("version"))


@query("w02_is_current", "SELECT o_orderkey, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_current FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") == F.max("o_orderkey").over(W("o_custkey"))).alias("is_current"))


@query("w03_ordinality", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS position FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return rows.select("doc_id", "line", (F.col("i") + 1).cast("long").alias("position"))


@query("w04_previous_and_next", "SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = W("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("following"))


@query("w05_branch_rank", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(W("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rank.alias("rank"))


@query("w06_preceding_context", "SELECT conv_id, turn, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = W("conv_id").orderBy("turn", "role", "text").rowsBetween(-4, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), "|").alias("context"))


@query("w07_overflow_batches", "SELECT conv_id, turn FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations) WHERE i <= (greatest(n - 2, 0) // 2) * 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequences.overflow(table(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], raw_window=2, batch=2).select("conv_id", "turn")


@query("w08_clamped_running_score", """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_id % 3 = 0 THEN -35 ELSE 15 END AS delta FROM events),
r AS (SELECT user_id, i, greatest(-100, least(100, delta)) AS score FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, greatest(-100, least(100, r.score + e.delta)) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, arg_max(score, i)::BIGINT AS score FROM r GROUP BY user_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("delta", F.when(F.col("event_id") % 3 == 0, -35).otherwise(15).cast("long"))
    return sequences.clamped_sum(events, ["user_id"], ["ts", "event_id"], "delta", -100, 100, "score")


@query("w09_greedy_distinct_first", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def _(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_per_key(table(spark, d, "documents"), ["source"], [F.col("doc_id")]).select("source", "doc_id")


@query("w10_latest_overall", "SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey > a.o_orderkey) AS latest FROM orders a")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") == F.max("o_orderkey").over(W("o_custkey"))).alias("latest"))


# ---- top-k and fusion

_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)"
_KNN = f"SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("k01_exact_knn", f"SELECT * FROM ({_KNN}) WHERE rank <= 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ranking.knn(table(spark, d, "embeddings"), _queries(spark, d), "vec_id", "embedding", 10)


@query("k02_approximate_knn")
def _(spark: SparkSession, d: str) -> DataFrame:
    """By the kept graph of all vectors."""
    return graph_index.kept_graph(spark, "embeddings", table(spark, d, "embeddings"), "vec_id", "embedding").search(_queries(spark, d), 10, "vec_id")


@query("k05_branch_top_k", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(table(spark, d, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5).select("source", "doc_id", "rank")


_BM25 = r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
x AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM t), p AS (SELECT doc_id, l, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean)) AS w FROM p JOIN f USING (term), s),
g AS (SELECT item_id, doc_id, round(sum(w), 6) AS score FROM q JOIN w USING (term) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 10"""


@query("k04_bm25", _BM25)
def _(spark: SparkSession, d: str) -> DataFrame:
    """From the kept index of all documents, which later queries open again."""
    docs = table(spark, d, "documents")
    index = inverted.kept_index(spark, "documents", docs, docs, "doc_id", "text")
    return index.search(table(spark, d, "benchmark").withColumnRenamed("text", "question"), "item_id", "question", 10, "doc_id")


@query("k08_collapse_to_parent", "SELECT l_orderkey, max(l_extendedprice) AS score, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS best_child, count(*) AS units FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("has_unit", F.lit(True)).withColumn("branch", F.lit(0))
    found = ranking.collapse(rows, ["branch"], "l_orderkey", "l_linenumber", "l_extendedprice", "l_linenumber", "has_unit")
    return found.select("l_orderkey", "score", "best_child", "units")


_RRF = f"""WITH a AS ({_KNN}), b AS (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(e.vec_id - q.vec_id), e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q),
f AS (SELECT query_id, vec_id, round(sum(p), 9) AS score FROM (SELECT query_id, vec_id, 1.0::DOUBLE / (60 + rank) AS p FROM a WHERE rank <= 28 UNION ALL SELECT query_id, vec_id, 1.25::DOUBLE / (60 + rank) FROM b WHERE rank <= 28) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS first_rank FROM f"""


def _branches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors, queries = table(spark, d, "embeddings"), _queries(spark, d)
    return ranking.knn(vectors, queries, "vec_id", "embedding", 28), ranking.nearest_ids(vectors, queries, "vec_id", 28)


@query("k09_weighted_rrf", _RRF)
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = _branches(spark, d)
    return ranking.reciprocal_rank_fusion([(a, 1.0), (b, 1.25)], ["query_id"], "vec_id").select("query_id", "vec_id", "score", "first_rank")


@query("k10_rerank_fusion", f"""WITH f AS ({_RRF}), s AS (SELECT *, CASE WHEN vec_id % 4 <> 0 THEN (vec_id * 37 % 101) / 100 END AS s FROM f WHERE first_rank <= 21),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first_rank, vec_id) AS rerank_rank FROM s WHERE s IS NOT NULL),
z AS (SELECT *, round((4.0::DOUBLE / 3) / (60 + rerank_rank) + (2.0::DOUBLE / 3) / (60 + first_rank), 9) AS final FROM r)
SELECT query_id, vec_id, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rerank_rank, first_rank, vec_id) AS position FROM z""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = _branches(spark, d)
    first = ranking.reciprocal_rank_fusion([(a, 1.0), (b, 1.25)], ["query_id"], "vec_id").where("first_rank <= 21")
    scored = first.withColumn("s", F.when(F.col("vec_id") % 4 != 0, (F.col("vec_id") * 37 % 101) / 100))
    return ranking.rerank_fusion(scored, ["query_id"], "vec_id", "s", "first_rank").select("query_id", "vec_id", "final", "position")


@query("k13_unit_expansion", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS i FROM conversations) WHERE i <= 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(table(spark, d, "conversations"), ["conv_id"], [F.desc(F.char_length("text")), F.col("turn")], 3).select("conv_id", "turn")


@query("k17_parent_ranking", "SELECT l_suppkey, min(l_linenumber) AS best, least(count(*), 8) AS n FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_linenumber").alias("best"), F.least(F.count("*"), F.lit(8)).alias("n"))
    return grouped.orderBy("best", F.desc("n"), "l_suppkey")


@query("k18_risk_top", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE i <= least(3, ceil(n * 0.1))")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    ranked = docs.withColumn("i", F.row_number().over(W("source").orderBy(F.desc("n_chars"), "doc_id"))).withColumn("n", F.count("*").over(W("source")))
    return ranked.where(F.col("i") <= F.least(F.lit(3), F.ceil(F.col("n") * 0.1))).select("source", "doc_id")


@query("k19_profile_choice", """WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice AS throughput, o_orderkey % 97 AS p95_ms FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT *, max(throughput) OVER (PARTITION BY o_custkey) AS best FROM p)
SELECT o_custkey, arg_min(o_orderkey, (p95_ms, o_orderkey)) AS o_orderkey FROM b WHERE throughput >= best * 0.95 GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    profiles = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("throughput"), (F.col("o_orderkey") % 97).alias("p95_ms"), F.when(F.col("o_orderstatus") == "P", 0.01).otherwise(0.0).alias("error_rate"))
    return ranking.choose_profile(profiles, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("k20_case_folded_sort", "SELECT p_partkey, p_brand, p_type FROM part ORDER BY lower(p_brand), lower(p_type), p_partkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_type").orderBy(F.lower("p_brand"), F.lower("p_type"), "p_partkey")


@query("k21_nearest_anchor", "SELECT l_orderkey, arg_min(anchor, (round(w, 9), anchor)) AS anchor, round(min(w), 6) AS distance FROM (SELECT l_orderkey * 10 + l_linenumber AS l_orderkey, anchor, 0.7::DOUBLE * (l_discount - d) ** 2 + 0.3::DOUBLE * (l_tax - t) ** 2 AS w FROM lineitem, (VALUES ('calm', 0.02::DOUBLE, 0.01::DOUBLE), ('tense', 0.08, 0.02), ('warm', 0.05, 0.07)) v(anchor, d, t)) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    anchors = spark.createDataFrame([("calm", 0.02, 0.01), ("tense", 0.08, 0.02), ("warm", 0.05, 0.07)], "anchor string, l_discount double, l_tax double")
    points = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_orderkey"), "l_discount", "l_tax")
    return ranking.nearest_anchor(points, anchors, "l_orderkey", ["l_discount", "l_tax"], [0.7, 0.3])


@query("k22_max_by_with_default", "SELECT c_custkey, coalesce((SELECT arg_max(o_orderpriority, (o_totalprice, o_orderkey)) FROM orders WHERE o_custkey = c_custkey), 'none') AS priority FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("priority"))
    return table(spark, d, "customer").join(best, F.expr("c_custkey = o_custkey"), "left").select("c_custkey", F.coalesce("priority", F.lit("none")).alias("priority"))


@query("k23_hashed_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR) LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(50).select("doc_id")


@query("k24_nulls_last_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'view') NULLS LAST, event_id) AS position FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    order = [F.asc_nulls_last("kind"), F.col("event_id")]
    return table(spark, d, "events").withColumn("kind", F.nullif("event_type", F.lit("view"))).select("event_id", F.row_number().over(W("user_id").orderBy(*order)).alias("position"))


# ---- sets and survivorship


@query("u01_union_of_records", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return people.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("u02_fallback_union", "SELECT 'rich' AS wanted, min(c_custkey) AS c_custkey, 'current' AS origin FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'none', min(c_custkey), 'history' FROM customer WHERE c_acctbal > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    branch = lambda condition, origin: rows.where(condition).select("c_custkey", F.lit(origin).alias("origin"))
    found = [(w, dedup.first_non_empty([branch(c, "current"), branch("c_acctbal > 0", "history")], [F.col("c_custkey")])) for w, c in (("rich", "c_acctbal > 5000"), ("none", "c_acctbal > 1e9"))]
    return found[0][1].withColumn("wanted", F.lit("rich")).unionByName(found[1][1].withColumn("wanted", F.lit("none")))


@query("u03_distinct", "SELECT DISTINCT event_type, user_id FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", "user_id").distinct()


@query("u04_set_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").select("l_partkey"))


@query("u05_overlap_sizes", r"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM benchmark) SELECT a.item_id, len(list_intersect(a.t, b.t)) AS shared, len(list_distinct(list_concat(a.t, b.t))) AS total FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(ranking.terms("text")).alias("t"))
    other = t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return t.join(other, "item_id").select("item_id", F.size(F.array_intersect("t", "u")).cast("long").alias("shared"), F.size(F.array_union("t", "u")).cast("long").alias("total"))


@query("u06_survivorship", """SELECT md5 AS hash, doc_id FROM (SELECT md5(text) AS md5, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY (source = 'src0') DESC, n_chars DESC, source, doc_id) AS i FROM documents) WHERE i = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("hash", F.md5("text"))
    return dedup.first_per_key(docs, ["hash"], [F.desc(F.col("source") == "src0"), F.desc("n_chars"), F.col("source"), F.col("doc_id")]).select("hash", "doc_id")


@query("u08_group_lineage", "SELECT md5(text) AS hash, string_agg(DISTINCT source, ',' ORDER BY source) AS found_in, CASE WHEN count(DISTINCT source) = 1 THEN 'High' WHEN max(doc_id) - min(doc_id) >= 500 THEN 'Medium' WHEN max(doc_id) - min(doc_id) >= 100 THEN 'Medium-Low' ELSE 'Low' END AS confidence FROM documents GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    gap = F.max("doc_id") - F.min("doc_id")
    confidence = F.when(F.count_distinct("source") == 1, "High").when(gap >= 500, "Medium").when(gap >= 100, "Medium-Low").otherwise("Low")
    return table(spark, d, "documents").groupBy(F.md5("text").alias("hash")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("found_in"), confidence.alias("confidence"))


@query("u09_record_dedup", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text), source ORDER BY (length(text) > 0) DESC, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 3 ELSE 2 END, length(text) DESC, text, doc_id) AS i FROM documents) WHERE i = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    language = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "zh", 1).when(F.col("lang") == "de", 3).otherwise(2)
    docs = table(spark, d, "documents").withColumn("hash", F.md5("text"))
    order = [F.desc(F.char_length("text") > 0), language, F.desc(F.char_length("text")), F.col("text"), F.col("doc_id")]
    return dedup.first_per_key(docs, ["hash", "source"], order).select("doc_id")


@query("u10_identical_bodies", "SELECT doc_id, count(*) OVER (PARTITION BY sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))) AS copies FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return dedup.with_copies(table(spark, d, "documents"), F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)).select("doc_id", "copies")


@query("u12_greedy_distinct")
def _(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return dedup.diversify(units, ["conv_id"], "turn", "text", limit=4).select("conv_id", "turn")


@query("u13_citation_merge", "SELECT c.conv_id, string_agg(DISTINCT c.role, ',' ORDER BY c.role) AS targets, arg_max(c.text, (length(c.text), -c.turn)) AS quote FROM conversations c GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("targets"), F.max_by("text", F.struct(F.char_length("text").alias("n"), (-F.col("turn")).alias("t"))).alias("quote"))


@query("u15_latest_error_minus_done", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return dedup.latest_open(events.where("event_type = 'click'"), events.where("event_type = 'purchase' AND value > 60"), "user_id", ["ts", "event_id"], "event_id")


@query("u17_duplicate_ids", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")
