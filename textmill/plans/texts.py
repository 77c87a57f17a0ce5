"""Queries on text, similarity and evaluation functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions import similarity, text
from textmill.operators import evaluation, joins, ranking
from textmill.plans.registry import query
from textmill.session import table

DOCS = "documents"


@query("f01_fold")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", F.md5(text.fold("text")).alias("folded"))


@query("f02_alphanumeric", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}%]+', ' ', 'g'))) AS h FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", F.md5(text.alphanumeric(F.col("text"))).alias("h"))


@query("f03_comparable", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}+#]+', ' ', 'g'))) AS h FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", F.md5(text.alphanumeric(F.col("text"), "+#")).alias("h"))


@query("f04_clean_inline", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(text, chr(160) || chr(12288), '  '), '[\x{200b}-\x{200d}\x{feff}]', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", F.md5(text.clean_inline(F.col("text"))).alias("h"))


@query("f06_compare_form", r"SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(lower(replace(p_name || ' & ' || p_type, '&', ' and ')), '[^\p{L}\p{N}]+', ' ', 'g')), '^(part|promo) ', '')) AS form FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.compare_form(F.concat("p_name", F.lit(" & "), "p_type"), ["part", "promo"]).alias("form"))


_URL = r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, rtrim(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '//+', '/', 'g'), '/') AS path,
list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '') AS q FROM pages),
p AS (SELECT page_id, unnest(q) AS item FROM u), d AS (SELECT page_id, url_decode(replace(split_part(item, '=', 1), '+', ' ')) AS k, url_decode(replace(substr(item, length(split_part(item, '=', 1)) + 2), '+', ' ')) AS v FROM p),
k AS (SELECT page_id, string_agg(replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' ORDER BY k, v) AS q FROM d
WHERE lower(k) NOT IN ('sso', 'shownavigation', 'locale', 'utm_source', 'utm_medium', 'utm_campaign', 'wt_mc') GROUP BY 1)
SELECT page_id, 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || coalesce('?' || k.q, '') AS canonical FROM u LEFT JOIN k USING (page_id)"""


@query("f07_canonical_url", _URL)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query("u07_dedup_key", f"SELECT canonical || '|' || regexp_extract(canonical, '/(en|fr|de|es)/', 1) AS key, count(*) AS n FROM ({_URL}) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    url = text.canonical_url(F.col("url"))
    return table(spark, d, "pages").groupBy(F.concat(url, F.lit("|"), F.regexp_extract(url, "/(en|fr|de|es)/", 1)).alias("key")).agg(F.count("*").alias("n"))


@query("f09_unique_rule", "SELECT page_id, CASE WHEN a::INT + b::INT = 1 THEN CASE WHEN a THEN 'blog' ELSE 'mobile' END ELSE '' END AS owner FROM (SELECT page_id, regexp_matches(url, '//blog') AS a, regexp_matches(url, '//m\\.') AS b FROM pages)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.unique_rule_match(F.col("url"), {"blog": "//blog", "mobile": r"//m\."}).alias("owner"))


@query("f10_f12_path_levels", "SELECT doc_id, lang AS level_1, source AS level_2, 'x > ' || doc_id AS level_3 FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = text.path_parts(F.concat_ws(" >", "lang", "source", F.lit(" x "), F.col("doc_id").cast("string")))
    return table(spark, d, DOCS).select("doc_id", *(text.level(parts, i, 3).alias(f"level_{i + 1}") for i in range(3)))


@query("f11_keyword_topic", "SELECT doc_id, CASE WHEN lower(text) LIKE '%licen%' THEN 'license' WHEN lower(text) LIKE '%token%' THEN 'secret' WHEN lower(text) LIKE '% | %' THEN 'table' ELSE 'prose' END AS topic FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    tiers = [{"license": ["licence", "licen"], "secret": ["token"]}, {"table": [" | "]}]
    return table(spark, d, DOCS).select("doc_id", text.keyword_topic(F.col("text"), tiers, "prose").alias("topic"))


@query("f13_f36_business_codes", r"SELECT DISTINCT doc_id, code, regexp_replace(code, '[^A-Za-z0-9]', '', 'g') AS alias FROM (SELECT doc_id, unnest(regexp_extract_all('C/HR' || doc_id || ' > C/HR3-AP ' || text || ' A/B1', '\b[A-Z]{1,4}(?:/[A-Z0-9]{1,6})+(?:-[A-Z0-9]{1,4})*\b')) AS code FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("C/HR"), F.col("doc_id").cast("string"), F.lit(" > C/HR3-AP "), "text", F.lit(" A/B1"))
    return table(spark, d, DOCS).select("doc_id", F.explode(text.business_codes(made)).alias("code")).withColumn("alias", text.code_alias(F.col("code")))


@query("f16_boundary_term", r"SELECT item_id, regexp_matches(t, '(^|[^a-z0-9])the([^a-z0-9]|$)') AS short_term, t LIKE '%ingan%' AS long_term FROM (SELECT item_id, lower(text) AS t FROM benchmark)")
def _(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, d, "benchmark").select("item_id", text.contains_term(low, "the").alias("short_term"), text.contains_term(low, "ingan").alias("long_term"))


@query("f17_hard_split", r"SELECT doc_id, chunk FROM (SELECT doc_id, unnest([trim(t[i:i+511], E' \t\n\r') FOR i IN range(1, greatest(length(t), 1) + 1, 512)]) AS chunk FROM (SELECT doc_id, trim(text, E' \t\n\r') AS t FROM documents)) WHERE chunk <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", F.explode(text.hard_chunks(F.col("text"), 512)).alias("chunk"))


@query("f17_overlapping_chunks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", F.posexplode(text.chunks(F.col("text"), 2048, 160)).alias("index", "chunk"))


@query("s10_html_pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    page = table(spark, d, "pages").select("page_id", text.parse_html("html").alias("p"))
    return page.select("page_id", "p.title", "p.language", F.char_length("p.content").alias("n_chars"), F.size("p.links").alias("n_links"), "p.tables")


@query("u14_link_dedup")
def _(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("page_id", "url", F.explode(text.parse_html("html")["links"]).alias("link"))
    return links.groupBy("link").agg(F.min("page_id").alias("first_page"), F.count_distinct("page_id").alias("pages"))


_LANG = r"""SELECT doc_id, CASE WHEN text = '' THEN 'unknown' WHEN g > e THEN 'de' WHEN e > 0 THEN 'en' ELSE 'unknown' END AS detected FROM (SELECT doc_id, text,
len(list_filter(w, lambda x: x IN ('der','die','das','für','mit','und','von','wir'))) AS g, len(list_filter(w, lambda x: x IN ('and','for','of','the','to','we','with'))) AS e
FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-zÀ-ÿ]+') AS w FROM documents))"""


@query("f34_stop_word_language", _LANG)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", text.detect_language(F.col("text")).alias("detected"))


@query("f35_script_counts", r"SELECT doc_id, 0 AS kana, 0 AS han, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", text.script_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("f33_negation_parity")
def _(spark: SparkSession, d: str) -> DataFrame:
    # "of", "de" and "und" stand for the cues, articles for the negating words; a turn is negated if one of its cues is
    word = r"(?<![\p{L}\p{N}])(?:%s)(?![\p{L}\p{N}])"
    prefixes = text.cue_prefixes(F.lower("text"), word % "of|de|und", r",.!?;:\n", 32)
    return table(spark, d, "conversations").select("conv_id", "turn", F.exists(prefixes, lambda p: text.negated(p, word % "la|the|der")).alias("negated"))


@query("f38_excel_dates", "SELECT event_id, (DATE '1899-12-30' + CAST(43000 + event_id % 2000 AS INTEGER))::DATE::VARCHAR AS day FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.excel_date(F.lit(43000) + F.col("event_id") % 2000).cast("string").alias("day"))


@query("f39_split_list", "SELECT n_nationkey, array_to_string(['a', n_name, 'b'], '|') AS parts FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.array_join(text.split_list(F.concat(F.lit(" a,; "), "n_name", F.lit("；b ,"))), "|").alias("parts"))


@query("f41_token_counts", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS tokens FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", F.size(ranking.terms("text")).cast("long").alias("tokens"))


@query("f43_box_overlap", "SELECT l_orderkey, l_linenumber, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 9) AS iou FROM (SELECT *, (a + b - i) AS u FROM (SELECT l_orderkey, l_linenumber, l_quantity * 10 AS a, 25 * 8.0 AS b, greatest(least(l_quantity, 30.0) - 5.0, 0) * greatest(least(10.0, 9.0) - 1.0, 0) AS i FROM lineitem))")
def _(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0.0)
    box = similarity.iou([zero, zero, F.col("l_quantity"), F.lit(10.0)], [F.lit(5.0), F.lit(1.0), F.lit(30.0), F.lit(9.0)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(box, 9).alias("iou"))


@query("f45_vector_norms", "SELECT vec_id, len(embedding) AS dims, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(e).cast("long").alias("dims"), F.round(F.sqrt(ranking.dot(e, e)), 6).alias("norm"))


@query("f46_hash_ids", "SELECT doc_id, doc_id || '::0::' || left(sha1(doc_id || ':0:' || text), 16) AS chunk_id, sha256(text) AS content_id FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return table(spark, d, DOCS).select("doc_id", F.concat(key, F.lit("::0::"), F.substring(F.sha1(F.concat(key, F.lit(":0:"), "text")), 1, 16)).alias("chunk_id"), F.sha2("text", 256).alias("content_id"))


@query("f47_rate_rules", """SELECT event_id, CASE WHEN event_id % 8 < 6 THEN greatest(1, (props->>'$.k')::INT) ELSE 20 END AS "limit", CASE event_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 1 WHEN 4 THEN 60 WHEN 5 THEN 3600 ELSE 30 END AS window_seconds FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A rule for each event: its number by units in both spellings, with blanks, and rules that are none."""
    units = F.array(*map(F.lit, ("/s", " / m ", "/h", "/second", "/minute", " /hour", "/day", "per hour")))
    rules = table(spark, d, "events").select("event_id", F.concat(F.get_json_object("props", "$.k"), F.get(units, (F.col("event_id") % 8).cast("int"))).alias("rule"))
    return rules.select("event_id", text.parse_rate(F.col("rule"), 20, 30).alias("r")).select("event_id", "r.*")


@query("f48_token_estimate", "SELECT doc_id, CASE WHEN length(trim(text)) > 0 THEN greatest(1, length(trim(text)) // 4) ELSE 0 END AS tokens FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("s16_excel_cells", "SELECT doc_id, CASE WHEN length(t) > 32767 THEN left(t, 32755) || ' [truncated]' ELSE t END AS cell FROM (SELECT doc_id, '''=' || text AS t FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", text.excel_cell(F.concat(F.lit("="), "text")).alias("cell"))


@query("x10_image_references")
def _(spark: SparkSession, d: str) -> DataFrame:
    markdown = F.concat(F.lit("![a](img/"), F.col("doc_id").cast("string"), F.lit(".png?x=1) ![b](https://h/x.png) ![c](data:x)"))
    return table(spark, d, DOCS).select("doc_id", F.explode(text.image_references(markdown)).alias("image"))


# ---- similarity and state


@query("f25_bigram_cosine", r"""WITH t AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS t FROM benchmark), g AS (SELECT item_id, unnest([t[i:i+1] FOR i IN range(1, length(t))]) AS g FROM t),
c AS (SELECT item_id, g, count(*) AS c FROM g GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM c GROUP BY 1)
SELECT a.item_id, round(sum(CASE WHEN b.c IS NULL THEN 0 ELSE a.c * b.c END) / max(na.n) / max(nb.n), 6) AS similarity FROM c a LEFT JOIN c b ON b.item_id = a.item_id + 1 AND b.g = a.g JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = a.item_id + 1 GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    grams = table(spark, d, "benchmark").select("item_id", similarity.bigram_counts(F.col("text")).alias("g")).select("item_id", similarity.counted(F.col("g")).alias("a"))
    other = grams.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return grams.join(other, "item_id").select("item_id", F.round(similarity.map_cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("f26_weighted_jaccard", """WITH e AS (SELECT event_id, user_id, ts, event_type AS p, lag(event_type, 1) OVER w AS s1, lag(event_type, 2) OVER w AS s2, lag(event_type, 3) OVER w AS s3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
o AS (SELECT *, list_distinct([x FOR x IN [s1, s2, s3] IF x IS NOT NULL AND x <> p]) AS d FROM e), m AS (SELECT *, [x FOR x IN [s1, s2, s3] IF list_contains(d, x)] AS l FROM o),
t AS (SELECT event_id, p, len(d) AS n, l[1] AS a, [x FOR x IN l IF x <> l[1]][1] AS b FROM m), k AS (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'logout', 'login']) AS k UNION SELECT DISTINCT event_type FROM events),
w AS (SELECT event_id, k, CASE WHEN k = p THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.7 END WHEN k = a OR k = b THEN 0.3 / CASE WHEN b IS NULL THEN 1 ELSE 2 END ELSE 0.0 END::DOUBLE AS w FROM t, k),
v AS (SELECT k, CASE k WHEN 'click' THEN 0.7 WHEN 'view' THEN 0.15 WHEN 'purchase' THEN 0.15 ELSE 0 END::DOUBLE AS v FROM k)
SELECT event_id, round(sum(least(w, v)) / sum(greatest(w, v)), 6) AS score FROM w JOIN v USING (k) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the user's three before it as secondary motives, against a click with view and purchase beside it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("before", F.array(*(F.lag("event_type", i).over(w) for i in (1, 2, 3))))
    mine, other = similarity.motive_weights(F.col("event_type"), F.col("before")), similarity.motive_weights(F.lit("click"), F.array(F.lit("view"), F.lit("purchase")))
    return rows.select("event_id", F.round(similarity.weighted_jaccard(mine, other), 6).alias("score"))


@query("f27_trait_similarity", "SELECT l_orderkey, l_linenumber, CASE WHEN greatest(abs(l_quantity - 25), abs(l_discount * 500 - 25), abs(l_tax * 500 - 20)) <= 35 AND 1 - (abs(l_quantity - 25) + abs(l_discount * 500 - 25) + abs(l_tax * 500 - 20)) / 300 >= 0.75 THEN round(1 - (abs(l_quantity - 25) + abs(l_discount * 500 - 25) + abs(l_tax * 500 - 20)) / 300, 6) END AS similarity FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    mine, other = [F.col("l_quantity"), F.col("l_discount") * 500, F.col("l_tax") * 500], [F.lit(25.0), F.lit(25.0), F.lit(20.0)]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(similarity.trait_similarity(mine, other), 6).alias("similarity"))


@query("f28_mixed_similarity", "SELECT event_id, CASE WHEN m >= 0.5 AND s >= 0.78 THEN round(s, 6) END AS score FROM (SELECT event_id, m, 0.55 * c + 0.25 * 0.9 + 0.20 * m AS s FROM (SELECT event_id, (event_id % 100)::DOUBLE / 99 AS c, (event_id % 7)::DOUBLE / 6 AS m FROM events))")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 100 / 99).alias("c"), (F.col("event_id") % 7 / 6).alias("m"))
    return rows.select("event_id", F.round(similarity.mixed_similarity(F.col("c"), F.lit(0.9), F.col("m")), 6).alias("score"))


@query("f30_softmax", "SELECT event_id, round(exp(value / 100) / (exp(value / 100) + exp(0.5) + exp(0)), 6) AS p FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(similarity.softmax(F.array(F.col("value") / 100, F.lit(0.5), F.lit(0.0)))[0], 6).alias("p"))


@query("f31_bounded_step", "SELECT event_id, round(greatest(-1, least(1, v + CASE WHEN sign(s) = sign(k) THEN sign(s) * least(abs(s), abs(k)) ELSE 0 END)), 6) AS next FROM (SELECT event_id, v, greatest(-0.35, least(0.35, t - v)) AS s, k FROM (SELECT event_id, (event_id % 21 - 10) / 10.0::DOUBLE AS v, (event_id % 13 - 6) / 6.0::DOUBLE AS t, (event_id % 5 - 2) / 8.0::DOUBLE AS k FROM events))")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(similarity.bounded_step((e % 21 - 10) / 10.0, (e % 13 - 6) / 6.0, (e % 5 - 2) / 8.0), 6).alias("next"))


@query("f32_trait_bias", "SELECT vec_id, round(greatest(-1, least(1, 0.5 * embedding[1]::DOUBLE - 0.25 * embedding[2]::DOUBLE + 0.1 * embedding[3]::DOUBLE)), 6) AS bias FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    weights = F.array(*map(F.lit, (0.5, -0.25, 0.1)))
    bias = ranking.dot(F.slice("embedding", 1, 3), weights)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), bias)), 6).alias("bias"))


@query("x02_yes_probability", "SELECT event_id, round(exp(value / 50 - greatest(value / 50, 1)) / (exp(value / 50 - greatest(value / 50, 1)) + exp(1 - greatest(value / 50, 1))), 6) AS p FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(similarity.yes_probability(F.col("value") / 50, F.lit(1.0)), 6).alias("p"))


@query("x04_vector_truncation", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])), 6) AS first FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    part = F.slice("embedding", 1, 16)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(part, 1).cast("double") / F.sqrt(ranking.dot(part, part)), 6).alias("first"))


# ---- evaluation

_TOP = "SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"
_EXACT = _TOP.format("round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)")
_SHORT = _TOP.format("round(list_cosine_similarity(e.embedding[1:32]::DOUBLE[], q.embedding[1:32]::DOUBLE[]), 9)")


@query("e01_recall_at_k", f"SELECT a.query_id, count(b.vec_id) / count(*) AS recall FROM ({_EXACT}) a LEFT JOIN (SELECT * FROM ({_SHORT}) WHERE rank <= 10) b USING (query_id, vec_id) WHERE a.rank <= 10 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    short = lambda df, c: df.withColumn(c, F.slice(c, 1, 32))
    exact = ranking.knn(vectors, queries, "vec_id", "embedding", 10)
    found = ranking.knn(short(vectors, "embedding"), short(queries, "query_vector"), "vec_id", "embedding", 10)
    return evaluation.recall_at_k(found, exact, ["query_id"], "vec_id", 10)


@query("e02_first_complete_rank", "SELECT o_custkey, CASE WHEN count(*) >= 3 THEN max(rank) END AS complete_rank FROM (SELECT o_custkey, o_orderpriority, min(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) WHERE o_orderpriority < '4' GROUP BY 1, 2) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    ranked = table(spark, d, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return evaluation.first_complete_rank(ranked.where("o_orderpriority < '4'").withColumnRenamed("o_orderpriority", "term"), ["o_custkey"], F.lit(3))


@query("e03_term_group_coverage", "SELECT doc_id, ((t LIKE '%ingan%' OR t LIKE '%eront%')::INT + (t LIKE '%mentqu%')::INT + (t LIKE '%thati%')::INT) / 3 AS coverage FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    groups = [["ingan", "eront"], ["mentqu"], ["thati"]]
    hit = [F.greatest(*(text.contains_term(F.lower("text"), t).cast("int") for t in g), F.lit(0)) for g in groups]
    return table(spark, d, DOCS).select("doc_id", (sum(hit[1:], hit[0]) / len(groups)).alias("coverage"))


@query("e04_scope_quota_coverage", "SELECT l_orderkey, (least(2, count(*) FILTER (WHERE l_returnflag = 'R')) + least(1, count(*) FILTER (WHERE l_returnflag = 'A'))) / 3 AS coverage FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    quota = {"R": 2, "A": 1}
    matched = [F.least(F.lit(q), F.count_if(F.col("l_returnflag") == s)) for s, q in quota.items()]
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((sum(matched[1:], matched[0]) / sum(quota.values())).alias("coverage"))


@query("e05_scope_group_coverage", "SELECT l_orderkey, (max((l_shipmode)::INT) + max((l_returnflag = 'A')::INT)) / 2 AS coverage FROM (SELECT *, l_returnflag IN ('R','N') AS l_shipmode FROM lineitem) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    groups = [["R", "N"], ["A"]]
    seen = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("scopes"))
    hits = [F.arrays_overlap("scopes", F.array(*map(F.lit, g))).cast("int") for g in groups]
    return seen.select("l_orderkey", (sum(hits[1:], hits[0]) / len(groups)).alias("coverage"))


@query("e06_ndcg", "WITH r AS (SELECT l_orderkey, l_linenumber AS rank, (l_quantity::INT % 4) AS g FROM lineitem WHERE l_linenumber <= 3), i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY g DESC, rank) AS ideal FROM r) SELECT l_orderkey, round(CASE WHEN sum((2 ** g - 1) / log2(ideal + 1)) > 0 THEN sum((2 ** g - 1) / log2(rank + 1)) / sum((2 ** g - 1) / log2(ideal + 1)) ELSE 0 END, 6) AS ndcg FROM i GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("rank"), (F.round("l_quantity").cast("int") % 4).alias("g"))
    return evaluation.ndcg(rows, ["l_orderkey"], "g", "rank", 3)


@query("e07_judged_top_1", "SELECT source, avg(quality) AS top_1_quality FROM (SELECT source, min(doc_id) AS doc_id FROM documents JOIN labels USING (doc_id) GROUP BY 1) JOIN labels USING (doc_id) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, DOCS).join(table(spark, d, "labels"), "doc_id")
    return judged.groupBy("source").agg(F.min_by("quality", "doc_id").cast("double").alias("top_1_quality"))


@query("e08_gates", "SELECT metric, actual, operator, threshold, CASE operator WHEN '>=' THEN actual >= threshold ELSE actual <= threshold END AS passed FROM (VALUES ('mean_value', '>=', 10.0::DOUBLE), ('users', '<=', 100000)) r(metric, operator, threshold) JOIN (SELECT 'mean_value' AS metric, round(avg(value), 6) AS actual FROM events UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events) USING (metric)")
def _(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "events").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count_distinct("user_id").cast("double").alias("users"))
    rules = spark.createDataFrame([("mean_value", ">=", 10.0), ("users", "<=", 100000.0)], "metric string, operator string, threshold double")
    return evaluation.gates(one.unpivot([], ["mean_value", "users"], "metric", "actual"), rules)


@query("e09_regression", "SELECT event_type, round(avg(value) FILTER (WHERE event_id % 2 = 0) - avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS regression FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    half = lambda i: F.avg(F.when(F.col("event_id") % 2 == i, F.col("value")))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(half(0) - half(1), 6).alias("regression"))


@query("e10_spearman", "SELECT o_custkey, CASE WHEN count(*) < 2 THEN 1 ELSE round(1 - 6 * sum((a - b) ** 2) / (count(*) * (count(*) * count(*) - 1)), 9) END AS rho FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    ranks = table(spark, d, "orders").select("o_custkey", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")).alias("a"), F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).alias("b"))
    return evaluation.spearman(ranks, ["o_custkey"], "a", "b").withColumn("rho", F.round("rho", 9))


@query("e11_stable_rank", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))


@query("e12_contract_rules", "SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 100 THEN 'too_short' END, CASE WHEN text LIKE '%|%' THEN 'table' END, CASE WHEN lang <> 'en' THEN 'locale' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = F.array(F.when(F.char_length("text") < 100, "too_short"), F.when(F.col("text").contains("|"), "table"), F.when(F.col("lang") != "en", "locale"))
    return table(spark, d, DOCS).select("doc_id", F.array_join(F.filter(rules, lambda x: x.isNotNull()), ",").alias("issues"))


@query("e13_acceptance", "SELECT event_type, count(*) = count(value) AS conserved, count(*) FILTER (WHERE value < 1) / count(*) < 0.01 AS errors_ok, quantile_disc(value, 0.95) <= 1.05 * max(value) AS latency_ok FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(
        (F.count("*") == F.count("value")).alias("conserved"), (F.count_if(F.col("value") < 1) / F.count("*") < 0.01).alias("errors_ok"),
        (F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)") <= 1.05 * F.max("value")).alias("latency_ok"),
    )


@query("e14_matrix_completeness", "SELECT unnest([8, 32, 40, 64]) AS size EXCEPT SELECT l_quantity::INT FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(x,) for x in (8, 32, 40, 64)], "size int")
    return wanted.join(table(spark, d, "lineitem").select(F.round("l_quantity").cast("int").alias("size")), "size", "left_anti")


@query("e15_dataset_contract", "SELECT count(*) = count(DISTINCT doc_id) AS unique_ids, bool_and(lang IN ('en','fr','de','es')) AS known_langs, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS stray_labels FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, DOCS)
    stray = table(spark, d, "labels").join(docs, "doc_id", "left_anti").agg(F.count("*").alias("stray_labels"))
    one = docs.agg((F.count("*") == F.count_distinct("doc_id")).alias("unique_ids"), F.bool_and(F.col("lang").isin("en", "fr", "de", "es")).alias("known_langs"))
    return one.join(F.broadcast(stray), F.lit(True))  # one row on either side


@query("x13_longest_run", "WITH m AS (SELECT user_id, value, value > 20 AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value > 20 ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, g, count(*) AS n, max(value) - min(value) AS r FROM m WHERE up GROUP BY 1, 2), b AS (SELECT user_id, max(n) AS longest, sum(n)::BIGINT AS active, max((n, r)) AS b FROM r GROUP BY 1) SELECT u.user_id, coalesce(longest, 0) AS longest, coalesce(active, 0) AS active, round(coalesce(b[2], 0), 6) AS range FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b USING (user_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.longest_run(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 20.0)


@query("f08_url_identity", f"SELECT page_id, regexp_replace(regexp_replace(canonical, '([?&])page=[^&]*&?', '\\1'), '[?&]$', '') AS identity FROM ({_URL})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.url_identity(F.col("url"), ["page"]).alias("identity"))


@query("f14_query_terms", r"""WITH w AS (SELECT item_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM benchmark)), u AS (SELECT item_id, w, min(i) AS i FROM w GROUP BY 1, 2),
e AS (SELECT item_id, w, i FROM u UNION ALL SELECT item_id, x, 1000000 + j FROM u, (VALUES ('der', 1), ('la', 2)) v(x, j) WHERE w = 'the'), f AS (SELECT item_id, w, min(i) AS i FROM e GROUP BY 1, 2) SELECT item_id, string_agg(w, ' ' ORDER BY i) AS terms FROM f GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.query_terms(F.col("text"), {"the": ["der", "la"]}), " ").alias("terms"))


@query("f15_context_label", "SELECT doc_id, 'scope: ' || lang || chr(10) || 'source: ' || source AS label FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = {"scope": F.col("lang"), "title": F.lit("  "), "section": F.lit(None).cast("string"), "source": F.col("source")}
    return table(spark, d, DOCS).select("doc_id", text.context_label(parts).alias("label"))


@query("f40_rating_labels", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'B+' END AS rating FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("o_orderstatus") == "F", "the Rating: b+ was given").otherwise("no rating")
    return table(spark, d, "orders").select("o_orderkey", text.rating_label(said).alias("rating"))


@query("u16_evidence_with_neighbours", "SELECT a.conv_id, a.turn AS anchor, string_agg(b.turn::VARCHAR, ',' ORDER BY b.turn) AS added FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) = 1 AND b.role <> 'assistant' WHERE a.role = 'assistant' GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    chosen = turns.where("role = 'assistant'").select("conv_id", "turn")
    near = joins.neighbours(chosen, turns.select("conv_id", "turn"), ["conv_id"], "turn", 1)
    fresh = near.join(chosen.withColumnRenamed("turn", "neighbour"), ["conv_id", "neighbour"], "left_anti")
    return fresh.groupBy("conv_id", "anchor").agg(F.array_join(F.transform(F.array_sort(F.collect_list("neighbour")), lambda x: x.cast("string")), ",").alias("added"))
