"""References of an answer checked against their sources: rejected, kept as related sources, or kept as anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import quotes
from textmill.functions.text import fold

# Phrases that name who may speak on a matter, by scope, and highlights that say nothing by themselves.
AUTHORITY = {
    "culture": ["高绩效文化", "我们的中国区高绩效文化", "协同共进", "创变未来", "聚力共赢", "使命必达", "collaboration to deliver", "innovation to shape", "customer-centricity to grow", "commitment to win"],
    "performance": ["asr rating", "what/how", "what 和 how", "绩效评级规则", "绩效评价规则"],
    "development_dialog": ["发展对话方法", "development dialog", "共同探索", "共情总结"],
    "career": ["career elements", "career element", "职业发展要素", "职业要素", "cross-divisional", "cross-functional", "project leadership experience"],
    "job_level": ["岗位等级标准", "岗级标准", "job level"],
}
JOB_LEVEL = r"(?<![a-z0-9])(?:g\d+|sl\d+(?:g\d+)?)(?![a-z0-9])"
GENERIC = ["员工", "建议", "文化", "目标", "绩效", "反馈", "表现", "发展"]
CODES = r"(?<![a-z0-9])(?:sl\d+(?:g\d+)?|etp\d+|tp\d+|g\d+|p\d+)(?![a-z0-9])"
WHOLE_CODE = r"^(?:g\d+|sl\d+(?:g\d+)?|etp\d+|tp\d+|p\d+|asr(?: rating)?|what|how)$"
HIGHLIGHT_CHARS, HIGHLIGHT_LINES, SENTENCE_BREAKS, LIST_SEPARATORS = 160, 2, 2, 3
QUOTE_CHARS, QUOTE_LINES = 600, 8

LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def _filled_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, LINE_ENDS, -1), lambda x: x.rlike(r"(?U)\S")))


def scopes_named(folded: Column, authority: dict[str, list[str]] = AUTHORITY) -> Column:
    """The scopes that a folded text may only be quoted from."""
    said = [F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(folded, t)) | (folded.rlike(JOB_LEVEL) if scope == "job_level" else F.lit(False)), scope) for scope, terms in authority.items()]
    return F.array_compact(F.array(*said)) if said else F.array().cast("array<string>")


def codes_named(folded: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(CODES), F.lit(0)))


def meaningful(highlight: Column, folded: Column, key: Column) -> Column:
    """Whether a highlight says something by itself: not generic, short enough, and with words enough or a code."""
    han = F.regexp_count(folded, F.lit("[㐀-鿿]"))
    short = (F.char_length(folded) <= HIGHLIGHT_CHARS) & (_filled_lines(highlight) <= HIGHLIGHT_LINES) & (F.regexp_count(folded, F.lit("[。！？.!?；;]")) <= SENTENCE_BREAKS) & (F.regexp_count(folded, F.lit("[,，、]")) <= LIST_SEPARATORS)
    words = F.when(folded.rlike(WHOLE_CODE), True).when(han > 0, han >= 3).otherwise(F.regexp_count(folded, F.lit("[a-z][a-z0-9+#.-]*")) >= 2)
    return (key != "") & ~key.isin(GENERIC) & short & words


def validate(references: DataFrame, sources: DataFrame, targets: DataFrame, authority: dict[str, list[str]] = AUTHORITY) -> DataFrame:
    """References (ref_id, target, source_ref, highlight, quote) against sources (source_ref, scope, text) and the output's
    targets (target, text) -> the references with ``outcome``, ``reason``, ``highlight_span``, ``quote_span`` and ``scope``.

    ``rejected``: ``invalid_shape`` (a null target, source, highlight or quote), ``unknown_source``, ``quote_not_in_source``,
    ``authority_scope_conflict`` (the highlight, or else the quote, names a scope other than its source's), ``conflicting_business_code``
    (the quote has a code that the highlight, which has some, has not). ``related``: ``highlight_not_in_output``,
    ``generic_or_short_highlight``, ``overbroad_source_quote``. All others are ``anchor``. Spans are (known, start, end, text) of the
    texts as they are; where formatting alone differs they are found all the same.
    """
    found = quotes.locate(references, sources.select("source_ref", "text"), "source_ref", "quote", "text", "quote_span")
    found = quotes.locate(found, targets.select("target", "text"), "target", "highlight", "text", "highlight_span")
    found = found.join(sources.select("source_ref", "scope"), "source_ref", "left")
    shown = F.coalesce("highlight_span.text", "highlight")
    rows = found.withColumn("_h", fold(shown)).withColumn("_q", fold("quote_span.text")).withColumn("_k", quotes.comparable(shown))
    named = scopes_named(F.col("_h"), authority)
    required = F.when(F.size(named) > 0, named).otherwise(scopes_named(F.col("_q"), authority))
    own, other = codes_named(F.col("_h")), codes_named(F.col("_q"))
    missing = F.col("target").isNull() | F.col("source_ref").isNull() | F.col("highlight").isNull() | F.col("quote").isNull()
    broad = (F.col("_q") == "") | (F.char_length("_q") > QUOTE_CHARS) | (_filled_lines(F.col("quote_span.text")) > QUOTE_LINES)
    reason = (
        F.when(missing, "invalid_shape").when(~F.col("quote_span.known"), "unknown_source").when(F.col("quote_span.start").isNull(), "quote_not_in_source")
        .when((F.size(required) > 0) & ~F.coalesce(F.array_contains(required, F.lower("scope")), F.lit(False)), "authority_scope_conflict")
        .when((F.size(own) > 0) & (F.size(F.array_except(other, own)) > 0), "conflicting_business_code")
        .when(F.col("highlight_span.start").isNull(), "highlight_not_in_output")
        .when(~meaningful(shown, F.col("_h"), F.col("_k")), "generic_or_short_highlight").when(broad, "overbroad_source_quote")
    )
    rejected = ["invalid_shape", "unknown_source", "quote_not_in_source", "authority_scope_conflict", "conflicting_business_code"]
    rows = rows.withColumn("reason", reason).drop("_h", "_q", "_k")
    return rows.withColumn("outcome", F.when(F.col("reason").isNull(), "anchor").when(F.col("reason").isin(rejected), "rejected").otherwise("related"))


def merged(validated: DataFrame, answer: str, order: str, priority: Column) -> tuple[DataFrame, DataFrame]:
    """(anchors, sources) of each ``answer`` from validated references with a position ``order`` in it.

    An anchor is given once for each target, highlight and quote as folded, by the source of the lowest ``priority``, then the first.
    A source is every source of an anchor or related reference once, with how many ``targets`` and ``anchors`` it has. Both are
    plain rows, so no source has to fit in one.
    """
    good = validated.where("outcome <> 'rejected'")
    said = good.where("outcome = 'anchor'").withColumn("_h", fold("highlight_span.text")).withColumn("_q", fold("quote_span.text"))
    kept = F.min(F.struct(priority.alias("p"), F.col(order).alias("o"), "source_ref", F.col("highlight_span.text").alias("highlight"), F.col("quote_span.text").alias("quote"))).alias("k")
    anchors = said.groupBy(answer, "target", "_h", "_q").agg(kept, F.min(order).alias("place")).select(answer, "target", "k.source_ref", "k.highlight", "k.quote", "place")
    each = good.where("outcome = 'related'").select(answer, "source_ref", "target", F.lit(0).alias("anchor")).distinct().unionByName(anchors.select(answer, "source_ref", "target", F.lit(1).alias("anchor")))
    once = each.groupBy(answer, "source_ref", "target").agg(F.sum("anchor").alias("anchors"))
    return anchors, once.groupBy(answer, "source_ref").agg(F.count("*").alias("targets"), F.sum("anchors").alias("anchors"))
