"""Queries on time windows, ordered folds, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import rollups, sequences
from textmill.plans.registry import query
from textmill.sources import files
from textmill.session import table
from textmill.streaming import ordered, windows

_SLIDES = "SELECT start, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest([time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE FOR i IN range(0, 3)]) AS start FROM events) GROUP BY 1"


@query("t01_rolling_users", _SLIDES)
def _(spark: SparkSession, d: str) -> DataFrame:
    return windows.rolling_distinct(table(spark, d, "events"), "ts", "user_id", 15, 5)


_FIRST_HIT = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, t AS opened, 1 AS n FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, CASE WHEN e.t >= r.opened + 86400000000 THEN e.t ELSE r.opened END, CASE WHEN e.t >= r.opened + 86400000000 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, count(*) FILTER (WHERE n <= 2) AS allowed, count(*) FILTER (WHERE n > 2) AS denied FROM r GROUP BY 1"""


@query("t02_first_hit_windows", _FIRST_HIT)
def _(spark: SparkSession, d: str) -> DataFrame:
    return windows.fixed_windows(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], 2, 86400)


@query("t13_cache_accounting", _FIRST_HIT.replace("86400000000", "3600000000").replace("count(*) FILTER (WHERE n <= 2) AS allowed, count(*) FILTER (WHERE n > 2) AS denied", "count(*) FILTER (WHERE n = 1) AS misses, count(*) FILTER (WHERE n > 1) AS hits"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return windows.cache_accounting(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], 3600)


@query("t03_t04_demand", "SELECT count(DISTINCT coalesce(user_id, -1)) AS active, least(20, greatest(2, ceil(count(DISTINCT coalesce(user_id, -1)) / 8) + 1))::BIGINT AS desired FROM events WHERE ts >= TIMESTAMP '2024-01-25'")
def _(spark: SparkSession, d: str) -> DataFrame:
    active = F.count_distinct(F.coalesce("user_id", F.lit(-1)))
    recent = table(spark, d, "events").where("ts >= '2024-01-25'").agg(active.alias("active"))
    return recent.select("active", windows.desired_replicas(F.col("active"), 8, 1, 2, 20).alias("desired"))


@query("t05_counter_increase", "SELECT user_id, round(sum(CASE WHEN b IS NULL THEN 0 WHEN value >= b THEN value - b ELSE value END), 4) AS increase FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return windows.counter_increase(table(spark, d, "events"), ["user_id"], "ts", "event_id", "value")


@query("t06_rate", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, round(sum(value) / 3600, 9) AS rate FROM events GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(windows.bucket("ts", 3600).alias("bucket"), "event_type").agg(F.round(F.sum("value") / 3600, 9).alias("rate"))


@query("t07_p95_series", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rollups.percentiles(table(spark, d, "events").withColumn("bucket", windows.bucket("ts", 86400)), ["bucket"], "value", {"p95": 0.95})


@query("t08_ratio", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / count(*), 6) AS percent FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(windows.bucket("ts", 86400).alias("bucket")).agg(F.round(100.0 * F.count_if(F.col("event_type") == "purchase") / F.count("*"), 6).alias("percent"))


@query("t09_two_stage_average", "SELECT bucket, round(sum(a), 6) AS total, round(max(a), 6) AS top FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, user_id, avg(value) AS a FROM events GROUP BY 1, 2) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "events").groupBy(windows.bucket("ts", 86400).alias("bucket"), "user_id").agg(F.avg("value").alias("a"))
    return first.groupBy("bucket").agg(F.round(F.sum("a"), 6).alias("total"), F.round(F.max("a"), 6).alias("top"))


@query("t10_last_seen", "SELECT user_id, max(ts) + INTERVAL 8 HOUR AS last_seen FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("ts < '2024-01-20'").groupBy("user_id").agg(F.from_utc_timestamp(F.max("ts"), "Asia/Shanghai").alias("last_seen"))


@query("t12_budget", """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, CASE WHEN value <= 100 THEN value ELSE 0 END AS used, (value <= 100)::INT AS ok FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, CASE WHEN r.used + e.value <= 100 THEN r.used + e.value ELSE r.used END, (r.used + e.value <= 100)::INT FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, round(max(used), 4) AS used, sum(ok)::BIGINT AS granted, sum(1 - ok)::BIGINT AS rejected FROM r GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequences.budget_reservations(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 100.0)


@query("t11_leases")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Two leases of two hours for each user: an event acquires one for its kind, cheap ones first; purchases give that of clicks back."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "purchase").alias("acquire"), F.when(F.col("event_type") == "purchase", "click").otherwise(F.col("event_type")).alias("kind"), F.floor(F.col("value") / 20).alias("priority"))
    return ordered.batch(events, ["user_id"], "ts", ["event_id"], ["acquire", "kind", "priority"], ordered.leases(2, 7200))


@query("t13_bounded_cache")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A cache of eight items and a day for each user; an item is a decade of an event's key, and errors invalidate it."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", F.floor(F.get_json_object("props", "$.k").cast("int") / 5).alias("item"), (F.col("event_type") == "error").alias("invalidates"))
    return ordered.batch(events, ["user_id"], "ts", ["event_id"], ["item", "invalidates"], ordered.cache(86_400, 8))


@query("t14_versioned_upsert", "SELECT o_custkey, arg_max(o_orderkey, (o_orderpriority, o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max(F.struct("o_orderpriority", "o_orderdate", "o_orderkey")).alias("v")
    return table(spark, d, "orders").groupBy("o_custkey").agg(newest).select("o_custkey", "v.o_orderkey")


@query("t15_compare_and_set", """WITH RECURSIVE e AS (SELECT user_id, event_type AS owner, event_id % 3 AS expected, event_type = 'purchase' AS release, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS revision, NULL::VARCHAR AS owner, 0::BIGINT AS stale, 0::BIGINT AS foreign_owner FROM (SELECT DISTINCT user_id FROM events) UNION ALL
SELECT e.user_id, e.i, r.revision + (CASE WHEN e.expected = r.revision % 3 AND coalesce(r.owner = e.owner, true) THEN 1 ELSE 0 END), CASE WHEN e.expected = r.revision % 3 AND coalesce(r.owner = e.owner, true) THEN (CASE WHEN e.release THEN NULL ELSE e.owner END) ELSE r.owner END,
r.stale + (CASE WHEN e.expected <> r.revision % 3 THEN 1 ELSE 0 END), r.foreign_owner + (CASE WHEN e.expected = r.revision % 3 AND NOT coalesce(r.owner = e.owner, true) THEN 1 ELSE 0 END) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, max_by(revision, i) AS revision, coalesce(max_by(coalesce(owner, '-'), i), '-') AS owner, max(stale) AS stale, max(foreign_owner) AS foreign_owner FROM r GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Events as updates of a user's state: each names the revision that it expects, here modulo 3, and owns the state until a purchase releases it."""
    attempts = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("by"), (F.col("event_id") % 3).alias("expected"), (F.col("event_type") == "purchase").alias("release"))
    found = sequences.compare_and_set(attempts, ["user_id"], ["ts", "event_id"], "expected", "by", "release", modulus=3)
    return found.withColumn("owner", F.coalesce("owner", F.lit("-")))


@query("t20_session_windows", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("s07_markdown_sections")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), "text")
    return table(spark, d, "documents").select("doc_id", F.explode(files.sections(made)).alias("s")).select("doc_id", "s.title", "s.level", "s.path", "s.start", F.char_length("s.text").alias("n_chars"))


@query("s17_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return files.upsert(stored, stored.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])


@query("s18_insert_ignore", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return files.insert_new(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])


@query("s20_bounded_log", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20000")
def _(spark: SparkSession, d: str) -> DataFrame:
    return files.keep_last(table(spark, d, "events"), ["ts", "event_id"], 20_000).select("event_id")
