"""Queries on citations, scorecards, earlier sessions, state merges and syncs."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions import similarity, spans
from textmill.operators import citations, evaluation, history, ranking, rollups
from textmill.plans.hybrid import _bm25_sql
from textmill.plans.registry import query
from textmill.session import scratch, table
from textmill.sources import versioned
from textmill.streaming import live

LEVELS = ["low", "medium", "high"]

def cited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References, sources and targets from all documents: literal, re-cased, spaced and repunctuated quotes, quotes with one altered
    letter, unknown sources, nulls, authority terms of the right and of another scope, conflicting codes, generic highlights, highlights that are not in the output, and whole texts as quotes.

    Each source has a reference of its own, and those of kind 9 all cite one source.
    """
    docs = table(spark, d, "documents").select("doc_id", "text", F.element_at(F.array(*map(F.lit, ("performance", "career", "job_level", "culture"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("scope"))
    kind, part = F.col("doc_id") % 14, F.trim(F.substring("text", 30, 60))
    letter = F.regexp_replace(part, r"[a-z](?=[^a-z]*$)", "0")
    spaced = F.regexp_replace(F.upper(part), r"\s+", " -\n ")
    quote = (
        F.when(kind == 1, spaced).when(kind == 2, letter).when(kind == 4, F.lit(None)).when(kind == 5, "Career element, G4").when(kind == 6, "Grade g5 and SL2").when(kind == 10, F.col("text"))
        .when(kind == 9, "the Popular passage").otherwise(part)
    )
    shown = F.when(kind == 5, "career-ELEMENT").when(kind == 6, "grade G5").when(kind == 7, "目标").when(kind == 8, "not in the output").when(kind == 11, F.lower(part)).when(kind == 9, F.concat(F.lit("popular passage no "), "doc_id")).otherwise(part)
    said = F.concat(F.lit("Summary: "), F.when(kind == 8, "nothing").otherwise(F.coalesce(shown, F.lit(""))), F.lit(" end."))
    source = F.when(kind == 3, -1).when(kind == 9, 0).otherwise(F.col("doc_id"))
    references = docs.select(F.col("doc_id").alias("ref_id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("target"), source.alias("source_ref"), shown.alias("highlight"), quote.alias("quote"))
    targets = docs.select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("target"), said.alias("text"))
    extra = F.when(kind == 5, " Career   Element (g4).").when(kind == 6, " grade G5, and sl2").otherwise("")
    sources = docs.select(F.col("doc_id").alias("source_ref"), "scope", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") == 0, " The POPULAR\tpassage").otherwise(extra)).alias("text"))
    return references, sources, targets


@query("x27_citation_outcomes")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every reference with its outcome, its reason, and the span of its quote in the text of its source."""
    found = citations.validate(*cited(spark, d))
    return found.select("ref_id", "outcome", "reason", F.col("quote_span.start").alias("quote_start"), F.col("quote_span.end").alias("quote_end"), F.md5("quote_span.text").alias("quote_hash"))


@query("x27_rejection_counters")
def _(spark: SparkSession, d: str) -> DataFrame:
    return citations.validate(*cited(spark, d)).groupBy("outcome", "reason").agg(F.count("*").alias("n"))


@query("x27_merged_sources")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All references as one answer: each source with its targets and anchors."""
    found = citations.validate(*cited(spark, d)).withColumn("answer", F.lit(1))
    return citations.merged(found, "answer", "ref_id", F.lit(0))[1]


_TOP = rf"""WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark), {_bm25_sql("c", "SELECT doc_id AS id, text FROM documents", 8)},
w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark), g AS (SELECT item_id, [[w[2], w[3]], [w[5]], [w[7], w[8]]] AS groups FROM w),
r AS (SELECT c.item_id, c.rank, d.lang, lower(d.text) AS t, g.groups FROM c JOIN documents d ON c.id = d.doc_id JOIN g USING (item_id)),
h AS (SELECT item_id, rank, lang, t, [contains(t, groups[1][1]) OR contains(t, groups[1][2]), contains(t, groups[2][1]), contains(t, groups[3][1]) OR contains(t, groups[3][2])] AS h FROM r)"""


def _top_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "benchmark").withColumnRenamed("text", "question")
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    ranked = ranking.bm25(docs, items, "doc_id", "text", "item_id", "question", 8).join(docs, "doc_id")
    word = lambda i: F.get(ranking.terms("question"), F.lit(i - 1))
    groups = F.array(F.array(word(2), word(3)), F.array(word(5)), F.array(word(7), word(8)))
    return ranked, items.select("item_id", groups.alias("groups"))


@query("x08_scorecards", f"""{_TOP} SELECT item_id, count(*) AS returned, min(rank) FILTER (WHERE h[1] AND h[2] AND h[3]) AS complete_rank, coalesce(min(rank) FILTER (WHERE h[1] AND h[2] AND h[3]) <= 1, false) AS recall_1,
coalesce(min(rank) FILTER (WHERE h[1] AND h[2] AND h[3]) <= 3, false) AS recall_3, coalesce(min(rank) FILTER (WHERE h[1] AND h[2] AND h[3]) <= 8, false) AS recall_8,
round((bool_or(h[1])::INT + bool_or(h[2])::INT + bool_or(h[3])::INT) / 3, 4) AS coverage, bool_and(lang IN ('en', 'fr')) AS scope_valid FROM h GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    ranked, groups = _top_documents(spark, d)
    return evaluation.scorecards(ranked, groups, ["item_id"], "text", F.col("lang").isin("en", "fr"))


@query("x18_x19_profile_failures", f"""{_TOP} SELECT item_id AS case_id, 'scoped' AS profile_id, NOT (bool_or(h[1] AND lang IN ('en', 'de')) AND bool_or(h[2] AND lang IN ('en', 'de')) AND bool_or(h[3] AND lang IN ('en', 'de'))) AS missing_terms,
NOT (bool_or(lang IN ('en', 'de')) AND bool_or(lang = 'de')) AS missing_scope, NOT bool_or(h[1] AND h[2] AND h[3] AND lang IN ('en', 'de')) AS unbundled FROM h GROUP BY 1
UNION ALL SELECT item_id, 'open', NOT (bool_or(h[1]) AND bool_or(h[2]) AND bool_or(h[3])), false, NOT bool_or(h[1] AND h[2] AND h[3]) FROM h GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    ranked, groups = _top_documents(spark, d)
    scoped = F.array(F.array(F.lit("en"), F.lit("de")), F.array(F.lit("de")))
    one = lambda name, scopes: groups.select(F.col("item_id").alias("case_id"), F.lit(name).alias("profile_id"), F.col("groups").alias("term_groups"), scopes.alias("scope_groups"))
    profiles = one("scoped", scoped).unionByName(one("open", F.array().cast("array<array<string>>")))
    return evaluation.profile_failures(ranked.select(F.col("item_id").alias("case_id"), F.col("lang").alias("scope"), "text"), profiles)


@query("f29_reply_matches")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Questions of every hundredth conversation against all replies; sessions of one length are alike."""
    pairs = history.reply_pairs(table(spark, d, "conversations"))
    asked = pairs.where("conv_id % 100 = 0").select("conv_id", "turn", "said", "around")
    alike = F.when(F.col("conv_id") == F.col("from_conv"), 1.0).otherwise(0.8)
    return history.reply_matches(asked, pairs, 0.6, alike, (0.8, 0.8)).select("conv_id", "turn", "from_conv", "from_turn", "score")


@query("x29_best_session", """WITH s AS (SELECT s_suppkey, s_nationkey AS nation, s_acctbal FROM supplier), m AS (SELECT s_suppkey, c_custkey, round(0.55 * (1 - abs(s_acctbal - c_acctbal) / 11000) + 0.25 * 0.9 + 0.20 * (c_custkey % 7) / 6.0::DOUBLE, 9) AS score
FROM s JOIN customer ON c_nationkey = nation AND c_mktsegment = 'BUILDING' WHERE (c_custkey % 7) / 6.0::DOUBLE >= 0.5) SELECT s_suppkey, arg_max(c_custkey, (score, c_custkey)) AS c_custkey, max(score) AS score FROM m WHERE score >= 0.78 GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal", F.lit("BUILDING").alias("segment"))
    earlier = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal", F.col("c_mktsegment").alias("segment"))
    score = similarity.mixed_similarity(1 - F.abs(F.col("s_acctbal") - F.col("c_acctbal")) / 11000, F.lit(0.9), F.col("c_custkey") % 7 / 6)
    return history.best_match(current, earlier, ["nation", "segment"], F.round(score, 9), "s_suppkey", "c_custkey", 0.78)


_STATES = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, count(*) OVER (PARTITION BY user_id) AS n FROM events), h AS (SELECT user_id AS session, event_type AS pattern, turn, CASE WHEN value >= 20 THEN 3 WHEN value >= 8 THEN 2 ELSE 1 END AS strength, turn <= n // 2 AS old, n // 2 AS last_turn FROM e),
p AS (SELECT session, pattern, arg_max(strength, turn) AS strength, max(turn) AS trigger_turn, max(last_turn) AS last_turn, min(turn) AS place FROM h WHERE old GROUP BY 1, 2),
w AS (SELECT session, pattern, arg_min(strength, turn) AS wanted, min(turn) AS turn FROM h WHERE NOT old GROUP BY 1, 2)"""


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("user_id")
    strength = F.when(F.col("value") >= 20, "high").when(F.col("value") >= 8, "medium").otherwise("low")
    e = table(spark, d, "events").withColumn("turn", F.row_number().over(w.orderBy("ts", "event_id")).cast("long")).withColumn("n", F.count("*").over(w))
    h = e.select(F.col("user_id").alias("session"), F.col("event_type").alias("pattern"), "turn", strength.alias("strength"), F.floor(F.col("n") / 2).alias("last_turn"))
    previous = h.where("turn <= last_turn").groupBy("session", "pattern").agg(F.max_by("strength", "turn").alias("strength"), F.max("turn").alias("trigger_turn"), F.max("last_turn").alias("last_turn"), F.min("turn").alias("place"))
    decisions = h.where("turn > last_turn").select("session", "pattern", "strength", "turn", F.col("turn").alias("place"), (F.col("session") % 4 == 0).alias("two"))
    return previous, decisions


@query("x12_state_merge", f"""{_STATES}, m AS (SELECT session, pattern, p.strength AS old, wanted, coalesce(turn, trigger_turn) AS trigger_turn, trigger_turn AS old_turn, last_turn, turn IS NULL AS kept, coalesce(turn, place) AS place,
CASE WHEN p.strength IS NULL THEN wanted WHEN wanted IS NULL THEN p.strength ELSE greatest(p.strength - CASE WHEN session % 4 = 0 THEN 2 ELSE 1 END, least(p.strength + CASE WHEN session % 4 = 0 THEN 2 ELSE 1 END, wanted)) END AS new FROM p FULL JOIN w USING (session, pattern)),
c AS (SELECT *, CASE WHEN wanted IS NULL THEN 'maintained' WHEN old IS NULL THEN 'first_activated' WHEN last_turn > 0 AND old_turn < last_turn THEN 'reactivated' WHEN new > old THEN 'strengthened' WHEN new < old THEN 'weakened' ELSE 'maintained' END AS change,
row_number() OVER (PARTITION BY session ORDER BY kept, place, pattern) AS position FROM m) SELECT session, pattern, CASE new WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS strength, change, trigger_turn, position FROM c WHERE position <= 4""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return history.merge_states(*_states(spark, d), LEVELS, most=4)


@query("x12_interactions", f"""{_STATES}, a AS (SELECT DISTINCT session, pattern FROM w), i AS (SELECT session, pattern AS a, lead(pattern) OVER (PARTITION BY session ORDER BY turn) AS b, strength AS kind, turn FROM h),
o AS (SELECT session, a, b, CASE kind WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS kind, min(turn) AS place FROM i WHERE a <> b AND EXISTS (SELECT 1 FROM a x WHERE x.session = i.session AND x.pattern = i.a) AND EXISTS (SELECT 1 FROM a x WHERE x.session = i.session AND x.pattern = i.b) GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY place, a, b, kind) AS position FROM o) SELECT session, a, b, kind, position FROM r WHERE position <= 4""")
def _(spark: SparkSession, d: str) -> DataFrame:
    previous, decisions = _states(spark, d)
    w = Window.partitionBy("session").orderBy("turn")
    e = table(spark, d, "events").withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    strength = F.when(F.col("value") >= 20, "high").when(F.col("value") >= 8, "medium").otherwise("low")
    said = e.select(F.col("user_id").alias("session"), F.col("event_type").alias("a"), strength.alias("kind"), "turn").withColumn("b", F.lead("a").over(w))
    return history.merge_interactions(decisions, said.select("session", "a", "b", "kind", F.col("turn").alias("place")))


@query("x07_bounded_levels", "SELECT event_id, CASE greatest(o - s, least(o + s, w)) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS level FROM (SELECT event_id, event_id % 3 + 1 AS o, (event_id // 3) % 3 + 1 AS w, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS s FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    level = lambda c: F.element_at(F.array(*map(F.lit, LEVELS)), (c % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", history.bounded_level(level(e), level(F.floor(e / 3)), LEVELS, e % 4 == 0).alias("level"))


@query("x32_relocation", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'moved/' || source ELSE source END AS path,
CASE WHEN doc_id % 3 = 0 THEN '{"input_path":"moved/' || source || '","lang":"' || lang || '","parse_metadata":{"input_path":"moved/' || source || '","pages":1},"source_path":"moved/' || source || '"}' ELSE '{"lang":"' || lang || '","parse_metadata":{"pages":1}}' END AS metadata FROM documents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit('{"lang":"'), "lang", F.lit('","parse_metadata":{"pages":1}}'))
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("path"), made.alias("metadata"))
    moves = table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit(" moved/"), "source", F.lit(" ")).alias("path"))
    return history.relocate(docs, moves).select("doc_id", "path", "metadata")


@query("x36_source_sync", """SELECT o_orderpriority AS source, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%' THEN 'old' ELSE 'new' END AS origin FROM orders WHERE CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%' THEN o_orderkey % 2 = 0 ELSE o_orderkey % 3 = 0 END""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Source 1 comes again unchanged by its stamp, 5 does not come, the others are replaced; 2 has the rows of its stamp with a value moved beside a null."""
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), "o_orderkey")
    stored = rows.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("old"))
    left, right = F.when(F.col("source").like("2%"), F.col("o_orderkey")), F.when(~F.col("source").like("2%"), F.col("o_orderkey"))
    incoming = rows.where("o_orderkey % 3 = 0 AND source NOT LIKE '5%'").withColumn("origin", F.lit("new"))
    stored, before, now = (x.select("*", a.alias("a"), b.alias("b")) for x, a, b in ((stored, left, right), (incoming, right, left), (incoming, left, right)))
    _, stamped = history.sync_sources(stored, before.where("source LIKE '1%' OR source LIKE '2%'"), spark.createDataFrame([], "source string, digest string, rows long"), "source", ["o_orderkey"])
    stamped = stamped.unionByName(history.sync_sources(stored, now.where("source LIKE '1%'"), stamped.limit(0), "source", ["o_orderkey"])[1]).where("source LIKE '2%' OR source LIKE '1%'").dropDuplicates(["source", "digest"])
    return history.sync_sources(stored, now, stamped, "source", ["o_orderkey"])[0].select("source", "o_orderkey", "origin")


@query("x36_sync_manifest", "SELECT o_orderpriority AS source, count(*) AS rows FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), "o_orderkey")
    nothing = spark.createDataFrame([], "source string, digest string, rows long")
    return history.sync_sources(rows.limit(0), rows.where("o_orderkey % 3 = 0"), nothing, "source", ["o_orderkey"])[1].select("source", "rows")


@query("x31_rebuild", """WITH c AS (SELECT doc_id, i - 1 AS i, line FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE trim(line) <> ''),
p AS (SELECT doc_id, i, md5(line || '!') AS h, 3 AS version FROM c WHERE doc_id % 10 = 0), b AS (SELECT doc_id, i, md5(line) AS h, 2 AS version FROM c)
SELECT doc_id || ':' || i AS chunk_id, doc_id, coalesce(p.h, b.h) AS content_hash, coalesce(p.version, b.version) AS version FROM b LEFT JOIN p USING (doc_id, i)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All chunks: an old build of every second document is replaced by a build of all that passes its checks, one with repeated
    chunks is refused, then some documents change in place and late rows of the first build lose."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where("trim(line) <> ''")
    build = lambda version, line: lines.select(F.concat_ws(":", "doc_id", "i").alias("chunk_id"), "doc_id", F.md5(line).alias("content_hash"), F.lit(version).alias("version"))
    chunks = versioned.VersionedTable(spark, scratch(spark, "rebuilt"), build(1, F.col("line")).schema, ["chunk_id"], ["version"], 8)
    chunks.rebuild(build(1, F.reverse("line")).where("doc_id % 2 = 0"))
    chunks.rebuild(build(2, F.col("line")), {"a chunk for every line": lambda made: made.count() == lines.count()})
    with contextlib.suppress(versioned.Refused):
        chunks.rebuild(build(9, F.col("line")).unionAll(build(9, F.col("line"))))
    chunks.merge(build(3, F.concat("line", F.lit("!"))).where("doc_id % 10 = 0"))
    chunks.merge(build(1, F.reverse("line")).where("doc_id % 4 = 0"))
    return chunks.read()


@query("x16_load_report", """SELECT strftime(ts, '%Y-%m-%d') AS phase, event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS top,
CASE WHEN quantile_disc(value, 0.95) <= 20 THEN 'smooth' WHEN quantile_disc(value, 0.95) <= 40 THEN 'acceptable' ELSE 'poor' END AS grade FROM events GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("phase", F.date_format("ts", "yyyy-MM-dd"))
    grade = F.when(F.col("p95") <= 20, "smooth").when(F.col("p95") <= 40, "acceptable").otherwise("poor")
    return rollups.latency_summary(rows, ["phase", "event_type"], "value").withColumn("grade", grade)


_PHASES = {"view": (70, 90), "click": (70, 90), "purchase": (60, 100)}


@query("x16_phase_report", """WITH w AS (SELECT user_id % 7 AS run, user_id, event_type AS phase, max(value) AS wait FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2, 3),
a AS (SELECT * FROM w UNION ALL SELECT run, user_id, 'joint', max(wait) FROM w GROUP BY 1, 2 HAVING count(*) = 3), u AS (SELECT user_id % 7 AS run, count(DISTINCT user_id) AS users FROM events GROUP BY 1),
l(phase, smooth, fair) AS (VALUES ('view', 70, 90), ('click', 70, 90), ('purchase', 60, 100), ('joint', 70, 100)),
m AS (SELECT run, phase, any_value(users) AS users, any_value(users) - count(wait) AS missing, quantile_disc(wait, 0.95) AS p95, max(wait) AS top, any_value(smooth) AS smooth, any_value(fair) AS fair FROM u CROSS JOIN l LEFT JOIN a USING (run, phase) GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN missing = 0 AND p95 <= smooth AND top <= 2 * smooth THEN 'smooth' WHEN missing = 0 AND p95 <= fair AND top <= 2 * fair THEN 'acceptable' ELSE 'poor' END AS grade FROM m)
SELECT run, max(users) AS users, max(users - missing) FILTER (WHERE phase = 'joint') AS finished, coalesce(string_agg(phase, ',' ORDER BY phase) FILTER (WHERE grade = 'poor'), '') AS poor,
CASE WHEN bool_or(grade = 'poor') THEN 'poor' WHEN bool_or(grade = 'acceptable') THEN 'acceptable' ELSE 'smooth' END AS status FROM g GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Users in seven runs with three phases each: what is missing, what was slow, and the worst grade of each run."""
    events = table(spark, d, "events").select((F.col("user_id") % 7).alias("run"), "user_id", "event_type", "value")
    _, runs = evaluation.load_report(events, "run", "user_id", "event_type", "value", _PHASES)
    return runs.withColumn("poor", F.array_join("poor", ","))


@query("t17_resumed_crawl", """WITH c AS (SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages)
SELECT host, coalesce(min(page_id) FILTER (WHERE page_id % 3 = 0), min(page_id) FILTER (WHERE page_id % 3 = 1), min(page_id)) AS page_id FROM c GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Hosts by the page that showed them first, over three runs of a crawl: the second goes on from the first one's checkpoint, the third has a checkpoint of its own and knows hosts from the stored table alone."""
    host = F.concat(F.lit("https://"), F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)))
    pages = table(spark, d, "pages").select(host.alias("host"), "page_id", F.timestamp_seconds("page_id").alias("at"))
    source, path, out = (scratch(spark, x) for x in ("crawl", "hosts", "new"))
    known = versioned.VersionedTable(spark, path, pages.select("host", "at").schema, ["host"], ["at"], 8)
    for run, checkpoint in enumerate((first := scratch(spark, "crawl-state"), first, scratch(spark, "crawl-state"))):
        pages.where(F.col("page_id") % 3 == run).coalesce(1).write.mode("append").parquet(source)
        live.new_keys(live.event_stream(spark, source, pages), known, f"{out}/run={run // 2}", "host", "at", checkpoint).awaitTermination()
    return spark.read.schema("host string, page_id long").parquet(*(f"{out}/run={r}/*" for r in (0, 1)))


@query("t16_event_milestones", """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text FROM conversations)
SELECT conv_id, count(*) AS events, min(i) FILTER (WHERE role = 'assistant')::DOUBLE AS first_reply, max(i)::DOUBLE AS last_event FROM t GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a stream of events, cut in the middle of each; a chunk's time is its number, less a half where an event is not complete yet."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    event = F.concat(F.lit("event: "), "role", F.lit("\ndata: "), F.replace("text", F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))
    rows = table(spark, d, "conversations").withColumn("i", F.row_number().over(w)).withColumn("e", event)
    half = F.floor(F.char_length("e") / 2).cast("int")
    cut = F.array(F.struct((F.col("i") - 0.5).alias("at"), F.substring("e", F.lit(1), half).alias("chunk")), F.struct(F.col("i").cast("double").alias("at"), F.substring("e", half + 1, F.char_length("e")).alias("chunk")))
    streams = rows.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list(cut))).alias("chunks"))  # a stream is one conversation
    found = streams.select("conv_id", spans.milestones(F.col("chunks")).alias("events"))
    replies = F.filter("events", lambda x: x["name"] == "assistant")
    times = lambda c: F.transform(c, lambda x: x["at"])
    return found.select("conv_id", F.size("events").cast("long").alias("events"), F.array_min(times(replies)).alias("first_reply"), F.array_max(times(F.col("events"))).alias("last_event"))
