"""Queries over the order, customer and event tables: predicates, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.operators import joins, predicates, rollups
from textmill.plans.registry import query
from textmill.session import table

MONEY = 2


def _sum(column: str, digits: int = MONEY) -> Column:
    return F.round(F.sum(column), digits)


# ---- predicates and projections


@query("p01_metadata_filter", """SELECT event_id FROM events WHERE event_type IN ('click','view') AND (json_contains(props, '{"k":1}') OR json_contains(props, '{"k":2}') OR json_contains(props, '{"k":"3"}'))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"event_type": ["click", "view"], "k": [1, 2, "3"], "collection": "any"}
    return table(spark, d, "events").where(predicates.compile_filter(wanted, ["event_type"], "props", ["collection"])).select("event_id")


@query("p01_empty_list_filter", "SELECT event_id FROM events WHERE false")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(predicates.compile_filter({"k": []}, ["event_type"], "props")).select("event_id")


@query("p02_export_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1,2,3,5,8,13) AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.where(F.col("o_custkey").isin(1, 2, 3, 5, 8, 13) & predicates.half_open(F.col("o_orderdate"), "1994-01-01", "1997-01-01")).select("o_orderkey")


@query("p03_crawl_filters", "SELECT doc_id FROM documents WHERE lang IN ('en','fr') AND source <> 'src0' AND length(text) BETWEEN 200 AND 5000")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = predicates.require_fields(table(spark, d, "documents"), {"languages": ["en", "fr"]}, {"languages": "lang"})
    return docs.where(F.col("lang").isin("en", "fr") & (F.col("source") != "src0") & F.char_length("text").between(200, 5000)).select("doc_id")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Events with a JSON document of numbers, texts, booleans, nulls and nested values."""
    number = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"a": {"list": ['), number, F.lit(', 1.5, true, null, "'), "event_type", F.lit('"]}, "k": '), number, F.lit(', "text": "'), number, F.lit('"}'))
    return table(spark, d, "events").select("event_id", "event_type", doc.alias("doc"))


@query("p05_json_key_removal", """SELECT event_id, json_merge_patch('{"a":{"list":[' || (props->>'$.k') || ',1.5,true,null,"' || event_type || '"]},"k":' || (props->>'$.k') || ',"text":"' || (props->>'$.k') || '"}', '{"k":null}')::VARCHAR AS rest FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).select("event_id", predicates.drop_json_keys("doc", ["k", "none"]).alias("rest"))


@query("p06_json_merge", """SELECT event_id, '{"a":{"list":[' || (props->>'$.k') || ',1.5,true,null,"' || event_type || '"]},"k":' || CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END || ',"text":"' || (props->>'$.k') || '","value":' || CASE WHEN event_id % 7 > 3 THEN 'true' ELSE 'false' END || ',"z":{"id":' || event_id || '}}' AS merged FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    added = {"k": F.nullif(F.col("event_type"), F.lit("view")), "value": F.col("event_id") % 7 > 3, "z": F.struct(F.col("event_id").alias("id"))}
    return _mixed(spark, d).select("event_id", predicates.merge_json("doc", added).alias("merged"))


@query("p07_blank_to_null", "SELECT event_id, nullif(trim(props->>'$.k'), '') AS k, nullif(trim('  '), '') AS blank FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", predicates.blank_to_null(F.get_json_object("props", "$.k")).alias("k"), predicates.blank_to_null(F.lit("  ")).alias("blank"))


@query("p08_null_safe_equality", "SELECT a.o_orderkey, a.o_orderstatus IS NOT DISTINCT FROM nullif(a.o_orderpriority, '1-URGENT') AS same, nullif(a.o_orderstatus, 'F') IS DISTINCT FROM NULL AS differs FROM orders a")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").eqNullSafe(F.nullif("o_orderpriority", F.lit("1-URGENT"))).alias("same"), (~F.nullif("o_orderstatus", F.lit("F")).eqNullSafe(F.lit(None))).alias("differs")
    )


@query("p09_coalesce_greatest_case", "SELECT l_orderkey, l_linenumber, greatest(nullif(l_discount, 0), l_tax) AS top, coalesce(nullif(l_discount, 0), -1) AS discount, CASE WHEN l_quantity >= 30 THEN 'large' WHEN l_quantity >= 10 THEN 'medium' ELSE 'small' END AS size FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    discount = F.nullif("l_discount", F.lit(0.0))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.greatest(discount, "l_tax").alias("top"), F.coalesce(discount, F.lit(-1.0)).alias("discount"),
        F.when(F.col("l_quantity") >= 30, "large").when(F.col("l_quantity") >= 10, "medium").otherwise("small").alias("size"),
    )


@query("p10_path_predicate", "SELECT page_id FROM pages WHERE url LIKE '%/en/%'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("url").like("%/en/%")).select("page_id")


@query("p11_array_quantifiers", "SELECT o_orderkey FROM orders WHERE o_orderpriority = ANY(['1-URGENT','2-HIGH']) AND o_orderstatus <> ALL(['F'])")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F")).select("o_orderkey")


@query("p12_guarded_cast", r"SELECT page_id, try_cast(regexp_extract(url, '/(-?[0-9]+)', 1) AS BIGINT) AS number FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/(-?[0-9]+)", 1).try_cast("bigint").alias("number"))


@query("p13_any_column_pattern", "SELECT p_partkey FROM part WHERE NOT (regexp_matches(p_name, '(?i)steel|copper') OR regexp_matches(p_type, '(?i)steel|copper'))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(~predicates.any_field_matches(["p_name", "p_type"], "(?i)steel|copper")).select("p_partkey")


@query("p14_present_fields", """SELECT conv_id, turn, '{"role":"' || role || '"' || CASE WHEN turn > 0 THEN ',"turn":' || turn ELSE '' END || '}' AS row FROM conversations""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("t"), "role", F.nullif("turn", F.lit(0)).alias("turn"))
    return rows.select("conv_id", F.col("t").alias("turn"), predicates.present_fields(["role", "turn"]).alias("row"))


@query("p15_preview", "SELECT doc_id, text[1:160] AS quote FROM documents ORDER BY doc_id LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").orderBy("doc_id").limit(50).select("doc_id", F.substring("text", 1, 160).alias("quote"))


@query("p16_multi_term_search", "SELECT c_custkey FROM customer WHERE (c_name ILIKE '%customer%' OR c_mktsegment ILIKE '%customer%') AND (c_name ILIKE '%build%' OR c_mktsegment ILIKE '%build%') ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").where(predicates.search_terms(["c_name", "c_mktsegment"], "Customer BUILD"))
    return rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey")


@query("p17_catalog_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND lower(o_orderpriority || ' ' || o_orderstatus) LIKE '%high%'")
def _(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").where((F.col("o_orderstatus") != "P") & day.between("1995-01-01", "1996-06-30") & F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).contains("high"))
    return rows.orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey")


@query("p18_account_status", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'pending' WHEN c_mktsegment = 'MACHINERY' THEN 'disabled' WHEN c_acctbal > 5000 THEN 'enabled' ELSE 'registered' END AS status FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", predicates.account_status(F.col("c_acctbal") >= 0, F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") > 5000).alias("status"))


# ---- joins


@query("j01_inner_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("j02_three_way_join", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")).join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    return rows.join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), _sum("l_extendedprice").alias("price"))


@query("j03_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def _(spark: SparkSession, d: str) -> DataFrame:
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(pending, F.expr("c_custkey = o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j04_json_key_join", "SELECT event_id, n_name FROM events LEFT JOIN nation ON try_cast(props->>'$.k' AS INT) = n_nationkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("key"))
    return keyed.join(table(spark, d, "nation"), F.expr("key = n_nationkey"), "left").select("event_id", "n_name")


@query("j05_join_grouped", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(counts, F.expr("c_custkey = o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j06_latest_per_key", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS o_orderkey FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    latest = joins.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    return table(spark, d, "customer").join(latest, F.expr("c_custkey = o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j07_ordered_list_per_key", "SELECT o_orderkey, (SELECT string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS parts FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    lists = joins.ordered_list(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "parts")
    text = F.array_join(F.transform("parts", lambda x: x["l_partkey"].cast("string")), ",")
    return table(spark, d, "orders").join(lists, F.expr("o_orderkey = l_orderkey"), "left").select("o_orderkey", text.alias("parts"))


@query("j08_filtered_counts", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


@query("j09_orphans", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey")


@query("j10_not_exists_prune", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity > 45"), F.expr("p_partkey = l_partkey"), "left_anti").select("p_partkey")


@query("j11_existence_column", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.with_flag(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey", "urgent").select("c_custkey", "urgent")


@query("j12_correlated_count", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return table(spark, d, "orders").join(counts, F.expr("o_orderkey = l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("returned"))


@query("j13_neighbour_band", "SELECT a.conv_id, a.turn AS anchor, b.turn AS neighbour, abs(b.turn - a.turn) AS distance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(b.turn - a.turn) BETWEEN 1 AND 2 WHERE a.role = 'assistant'")
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return joins.neighbours(turns.where("role = 'assistant'"), turns, ["conv_id"], "turn", 2).select("conv_id", "anchor", "neighbour", "distance")


_NORMAL = r"' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"


@query("j14_containment_join", f"WITH n AS (SELECT item_id, {_NORMAL} AS t FROM benchmark), f AS (SELECT DISTINCT split_part(t, ' ', 2) || ' ' || split_part(t, ' ', 3) AS fact FROM n) SELECT item_id, fact FROM n, f WHERE contains(t, ' ' || fact || ' ')")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    facts = items.select(F.array_join(F.slice(F.split(F.trim(joins.normalized("text")), " "), 1, 2), " ").alias("fact")).distinct()
    return joins.contained_facts(items, facts, "text", "fact").select("item_id", "fact")


@query("j15_single_row_stats", "SELECT o_orderkey, round(o_totalprice / (SELECT avg(o_totalprice) FROM orders), 6) AS share FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return joins.with_stats(orders, orders.agg(F.avg("o_totalprice").alias("mean"))).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("mean"), 6).alias("share"))


@query("j16_join_using", "SELECT user_id, n FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) USING (user_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.where("event_type = 'purchase'").select("user_id").distinct().join(events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("j17_source_state_diff", """SELECT coalesce(s.id, t.id) AS id, CASE WHEN t.id IS NULL THEN 'new' WHEN s.id IS NULL THEN 'removed' WHEN s.hash IS DISTINCT FROM t.hash THEN 'changed' WHEN s.path <> t.path THEN 'relocated' ELSE 'current' END AS state
FROM (SELECT doc_id AS id, md5(text) AS hash, source AS path FROM documents WHERE doc_id % 5 <> 0) s FULL JOIN (SELECT doc_id AS id, md5(CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END) AS hash, CASE WHEN doc_id % 11 = 0 THEN 'moved' ELSE source END AS path FROM documents WHERE doc_id % 3 <> 0) t ON s.id = t.id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    source = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"), F.col("source").alias("path"))
    stored = docs.where("doc_id % 3 <> 0").select(
        F.col("doc_id").alias("id"), F.md5(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text"))).alias("hash"), F.when(F.col("doc_id") % 11 == 0, "moved").otherwise(F.col("source")).alias("path")
    )
    return joins.state_diff(source, stored).select("id", "state")


@query("j18_adjacent_pairs", "SELECT conv_id, turn, reply FROM (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user' AND next_role = 'assistant'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.adjacent_pairs(table(spark, d, "conversations"), "user", "assistant").select("conv_id", "turn", "reply")


@query("j19_latest_non_null", "SELECT user_id, arg_max(nullif(event_type, 'view'), (ts, event_id)) FILTER (WHERE event_type <> 'view') AS last_action, arg_max(value, (ts, event_id)) FILTER (WHERE value > 5) AS last_value FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    picked = {"last_action": F.when(F.col("event_type") != "view", F.col("event_type")), "last_value": F.when(F.col("value") > 5, F.col("value"))}
    return rollups.latest_non_null(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], picked)


@query("j22_full_outer_allow_list", "SELECT coalesce(lower(a.c_name), lower(b.s_name)) AS name, a.c_custkey IS NOT NULL AS registered, b.s_suppkey IS NOT NULL AS allowed FROM (SELECT c_custkey, replace(c_name, 'Customer', 'Actor') AS c_name FROM customer) a FULL JOIN (SELECT s_suppkey, upper(CASE WHEN s_suppkey % 3 <> 0 THEN replace(s_name, 'Supplier', 'Actor') ELSE s_name END) AS s_name FROM supplier) b ON lower(a.c_name) = lower(b.s_name)")
def _(spark: SparkSession, d: str) -> DataFrame:
    accounts = table(spark, d, "customer").select("c_custkey", F.replace("c_name", F.lit("Customer"), F.lit("Actor")).alias("c_name"))
    # every third supplier keeps its name, so it is allowed without being registered
    renamed = F.when(F.col("s_suppkey") % 3 != 0, F.replace("s_name", F.lit("Supplier"), F.lit("Actor"))).otherwise(F.col("s_name"))
    allowed = table(spark, d, "supplier").select("s_suppkey", F.upper(renamed).alias("s_name"))
    both = accounts.join(allowed, F.lower("c_name") == F.lower("s_name"), "full")
    return both.select(F.coalesce(F.lower("c_name"), F.lower("s_name")).alias("name"), F.col("c_custkey").isNotNull().alias("registered"), F.col("s_suppkey").isNotNull().alias("allowed"))


# ---- aggregates


@query("a01_group_count_min_max", "SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("a02_filtered_count", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count("*").alias("n"))


@query("a03_group_by_dims", "SELECT len(embedding) AS dims, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count("*").alias("n"))


@query("a04_count_non_null", "SELECT event_type, count(nullif(props->>'$.k', '0')) AS with_k, count(*) AS n FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.nullif(F.get_json_object("props", "$.k"), F.lit("0"))).alias("with_k"), F.count("*").alias("n"))


@query("a05_document_frequency", r"SELECT lang, term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0))
    rows = table(spark, d, "documents").select("doc_id", "lang", F.explode(terms).alias("term"))  # one row a document and term: a plain count is distinct
    return rows.groupBy("lang", "term").agg(F.count("*").alias("df")).where("df >= 5")


@query("a06_corpus_size", "SELECT greatest(count(DISTINCT doc_id), 1) AS n FROM documents WHERE source = 'absent'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source = 'absent'").agg(F.greatest(F.count_distinct("doc_id"), F.lit(1)).alias("n"))


@query("a07_update_from_aggregate", "SELECT o_orderkey, n AS new_count FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE n IS DISTINCT FROM 4")
def _(spark: SparkSession, d: str) -> DataFrame:
    fresh = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("new_count"))
    stored = table(spark, d, "orders").select("o_orderkey", F.lit(4).cast("long").alias("new_count"))
    return rollups.changed_rows(stored, fresh, ["o_orderkey"], "new_count")


@query("a08_largest_group", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(1)


@query("a09_nearest_rank_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rollups.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("a09b_rounded_index_percentile", "SELECT event_type, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.9, 0) AS BIGINT) + 1] AS p90 FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rollups.rounded_index_percentile(table(spark, d, "events"), ["event_type"], "value", 0.9, "p90")


@query("a10_latency_summary", "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS top FROM (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")))
    return rollups.latency_summary(rows, ["event_type"], "value")


@query("a11_median", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.median("l_extendedprice"), 4).alias("median"))


@query("a12_guarded_mean", "SELECT source, round(sum(quality) / greatest(count(quality), 1), 4) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.coalesce(F.sum("quality"), F.lit(None)) / F.greatest(F.count("quality"), F.lit(1)), 4).alias("quality"))


_RUNS = "(SELECT o_orderpriority AS agent, o_custkey AS case_id, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS attempt, o_orderstatus = 'F' AS passed FROM orders)"


@query("a13_pass_at_k", f"SELECT agent, avg(first::INT) AS pass_1, avg(any_k::INT) AS pass_k, avg(all_k::INT) AS pass_all_k FROM (SELECT agent, case_id, bool_or(passed) FILTER (WHERE attempt = 1) AS first, bool_or(passed) AS any_k, count(*) = 3 AND bool_and(passed) AS all_k FROM {_RUNS} WHERE attempt <= 3 GROUP BY 1, 2) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rollups.pass_rates(_runs(spark, d), 3, ["agent"])


@query("a14_pass_rollup", f"SELECT agent, avg(first::INT) AS pass_1, avg(any_k::INT) AS pass_k, avg(all_k::INT) AS pass_all_k FROM (SELECT agent, case_id, bool_or(passed) FILTER (WHERE attempt = 1) AS first, bool_or(passed) AS any_k, count(*) = 3 AND bool_and(passed) AS all_k FROM {_RUNS} WHERE attempt <= 3 GROUP BY 1, 2) GROUP BY GROUPING SETS ((), (agent))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rollups.pass_rates(_runs(spark, d), 3, ["agent"], overall=True)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    attempt = F.row_number().over(Window.partitionBy("o_orderpriority", "o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("agent"), F.col("o_custkey").alias("case_id"), attempt.alias("attempt"), (F.col("o_orderstatus") == "F").alias("passed"))


@query("a15_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")


@query("a16_failure_rate", "SELECT s_suppkey, CASE WHEN count(l_orderkey) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE l_returnflag = 'R') / count(l_orderkey) END AS failure_rate FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 40 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "lineitem").where("l_quantity > 40"), F.expr("s_suppkey = l_suppkey"), "left")
    return rows.groupBy("s_suppkey").agg(rollups.failure_rate(F.col("l_returnflag") == "R", "l_orderkey").alias("failure_rate"))


@query("a17_threshold_counts", "SELECT user_id, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent, count(*) FILTER (WHERE value >= 70) AS high FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("spent"), F.count_if(F.col("value") >= 70).alias("high"))


@query("a18_consistency_check", "SELECT o_custkey, min(o_orderstatus) = max(o_orderstatus) AS consistent FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.min("o_orderstatus") == F.max("o_orderstatus")).alias("consistent"))


@query("a19_ordered_array", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    lists = joins.ordered_list(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "keys")
    return lists.select("o_custkey", F.array_join(F.transform("keys", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@query("a20_corpus_fingerprint", "SELECT source, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rollups.fingerprint(table(spark, d, "documents"), ["source"], "doc_id", "text")


@query("a21_multiset_recall", r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents), p AS (SELECT doc_id, unnest(regexp_extract_all(lower(replace(replace(text, ' the ', ' '), ' la ', ' ')), '[\p{L}\p{N}]+')) AS t FROM documents),
nc AS (SELECT doc_id, t, count(*) AS c FROM n GROUP BY 1, 2), pc AS (SELECT doc_id, t, count(*) AS c FROM p GROUP BY 1, 2)
SELECT nc.doc_id, round(sum(least(nc.c, coalesce(pc.c, 0))) / sum(nc.c), 6) AS recall FROM nc LEFT JOIN pc USING (doc_id, t) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.replace(F.replace("text", F.lit(" the "), F.lit(" ")), F.lit(" la "), F.lit(" ")).alias("parsed"))
    return rollups.multiset_recall(docs, ["doc_id"], "text", "parsed")


@query("a22_token_cost", "SELECT event_type, round(sum(value * CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'click' THEN 0.5 ELSE 0.1 END / 1e6), 9) AS cost FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([("purchase", 3.0), ("click", 0.5)], "event_type string, rate double")
    rows = table(spark, d, "events").join(F.broadcast(rates), "event_type", "left")
    return rows.groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.coalesce("rate", F.lit(0.1)) / 1e6), 9).alias("cost"))


@query("a23_counter_sums", "SELECT sum(length(text) - length(replace(text, '!', '')))::BIGINT AS bangs, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS breaks FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "documents").select(F.struct((F.char_length("text") - F.char_length(F.replace("text", F.lit("!"), F.lit("")))).alias("bangs"), (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))).alias("breaks")).alias("noise"))
    return counted.agg(F.sum("noise.bangs").alias("bangs"), F.sum("noise.breaks").alias("breaks"))


@query("a24_duplicate_groups", "SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("a25_first_non_null_latest", "SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    picked = {"urgent": F.when(F.col("o_orderpriority").like("1%"), F.col("o_orderpriority")), "price": F.col("o_totalprice")}
    return rollups.latest_non_null(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], picked)
