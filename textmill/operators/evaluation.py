"""Retrieval metrics, gates and load analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators import rollups


def recall_at_k(found: DataFrame, exact: DataFrame, keys: list[str], id_col: str, k: int) -> DataFrame:
    """Overlap of two ranked lists over min(k, exact size), at least 1."""
    a = found.where(F.col("rank") <= k).select(*keys, id_col, F.lit(1).alias("hit"))
    b = exact.where(F.col("rank") <= k)
    return b.join(a, [*keys, id_col], "left").groupBy(*keys).agg((F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"))


def first_complete_rank(hits: DataFrame, keys: list[str], needed: Column) -> DataFrame:
    """hits (keys, rank, term) -> the least rank up to which ``needed`` distinct terms were seen; null if never."""
    first = hits.groupBy(*keys, "term").agg(F.min("rank").alias("rank"))
    return first.groupBy(*keys).agg(F.when(F.count("*") >= needed, F.max("rank")).alias("complete_rank"))


def ndcg(grades: DataFrame, keys: list[str], grade: str, rank: str, k: int) -> DataFrame:
    gain = F.pow(F.lit(2.0), F.col(grade)) - 1
    ideal = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(grade), rank))
    rows = grades.where(F.col(rank) <= k).withColumn("_gain", gain).withColumn("_ideal", ideal)
    at = lambda r: F.sum(F.col("_gain") / F.log2(F.col(r) + 1.0))
    return rows.groupBy(*keys).agg(F.round(F.when(at("_ideal") > 0, at(rank) / at("_ideal")).otherwise(0.0), 6).alias("ndcg"))


def spearman(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) of two rankings; fewer than two items: 1."""
    n = F.count("*")
    return df.groupBy(*keys).agg(F.when(n < 2, 1.0).otherwise(1 - 6 * F.sum(F.pow(F.col(left) - F.col(right), 2)) / (n * (n * n - 1))).alias("rho"))


def gates(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """metrics (metric, actual) against rules (metric, operator, threshold)."""
    passed = F.when(F.col("operator") == ">=", F.col("actual") >= F.col("threshold")).when(F.col("operator") == "<=", F.col("actual") <= F.col("threshold"))
    return rules.join(metrics, "metric", "left").select("metric", "actual", "operator", "threshold", F.coalesce(passed, F.lit(False)).alias("passed"))


def longest_run(df: DataFrame, keys: list[str], order: list[str], value: str, threshold: float) -> DataFrame:
    """Longest run above the threshold, how many are above, and the largest range among the longest runs."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_up", F.col(value) > threshold).withColumn("_i", F.row_number().over(w))
    island = F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "_up").orderBy(*order))
    runs = marked.withColumn("_island", island).where("_up").groupBy(*keys, "_island").agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("r"))
    best = runs.groupBy(*keys).agg(F.max(F.struct("n", "r")).alias("b"), F.sum("n").alias("active")).select(*keys, F.col("b.n").alias("longest"), "active", F.round("b.r", 6).alias("range"))
    return df.select(*keys).distinct().join(best, keys, "left").na.fill(0, ["longest", "active"]).na.fill(0.0, ["range"])


def scorecards(ranked: DataFrame, groups: DataFrame, keys: list[str], text_col: str, scope_valid: Column, most: int = 8) -> DataFrame:
    """Per case: the first rank at which one text holds all term groups, recall at 1, 3 and ``most``, the share of groups found in the
    first ``most``, and whether all scopes are valid.

    ``groups`` has one row a case with ``groups``: lists of alternative terms. Ranked rows have ``rank`` and the text. Cases without results
    have no rank and no coverage.
    """
    hits = F.transform("groups", lambda g: F.exists(g, lambda t: F.contains(F.lower(text_col), t)))
    rows = ranked.join(groups, keys).select(*keys, "rank", hits.alias("hits"), scope_valid.alias("valid"))
    seen = rows.select(*keys, "rank", "valid", F.forall("hits", lambda h: h).alias("complete"), F.posexplode("hits").alias("g", "hit"))
    per_group = seen.groupBy(*keys, "g").agg(
        F.max(F.when(F.col("rank") <= most, F.col("hit")).otherwise(False)).alias("hit"), F.min(F.when(F.col("complete"), F.col("rank"))).alias("first"), F.bool_and("valid").alias("valid"), F.count_distinct("rank").alias("n")
    )
    one = per_group.groupBy(*keys).agg(F.max("n").alias("returned"), F.min("first").alias("complete_rank"), F.round(F.avg(F.col("hit").cast("int")), 4).alias("coverage"), F.bool_and("valid").alias("scope_valid"))
    recalls = [F.coalesce(F.col("complete_rank") <= k, F.lit(False)).alias(f"recall_{k}") for k in (1, 3, most)]
    found = groups.select(*keys).join(one, keys, "left")
    return found.select(*keys, F.coalesce("returned", F.lit(0)).alias("returned"), "complete_rank", *recalls, F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("scope_valid", F.lit(True)).alias("scope_valid"))


def profile_failures(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Documents (case_id, scope, text) against profiles (case_id, profile_id, term_groups, scope_groups), lists of alternatives each
    -> (case_id, profile_id, missing_terms, missing_scope, unbundled).

    Terms count in documents of a scope that the profile names, in all where it names none. ``missing_terms``: a term group is
    found in none of them; ``missing_scope``: a scope group has no document; ``unbundled``: no single document holds all term groups.
    """
    allowed = F.flatten("scope_groups")
    rows = profiles.join(documents, "case_id", "left").withColumn("counts", (F.size(allowed) == 0) | F.coalesce(F.array_contains(allowed, F.col("scope")), F.lit(False)))
    term_hits = F.transform("term_groups", lambda g: F.col("counts") & F.exists(g, lambda t: F.coalesce(F.contains(F.lower("text"), t), F.lit(False))))
    scope_hits = F.transform("scope_groups", lambda g: F.coalesce(F.array_contains(g, F.col("scope")), F.lit(False)))
    found = rows.select("case_id", "profile_id", F.size("term_groups").alias("t"), F.size("scope_groups").alias("s"), term_hits.alias("terms"), scope_hits.alias("scopes"))
    places = lambda c: F.filter(F.transform(c, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
    bundled = F.bool_or(F.forall("terms", lambda h: h))
    one = found.groupBy("case_id", "profile_id", "t", "s").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(places("terms"))))).alias("t_hit"), F.size(F.array_distinct(F.flatten(F.collect_set(places("scopes"))))).alias("s_hit"), bundled.alias("bundled")
    )
    return one.select("case_id", "profile_id", (F.col("t_hit") < F.col("t")).alias("missing_terms"), (F.col("s_hit") < F.col("s")).alias("missing_scope"), (~F.col("bundled")).alias("unbundled"))


def load_report(samples: DataFrame, run: str, user: str, phase: str, wait: str, phases: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """(metrics, runs) of load runs from waits by run, user and phase.

    Metrics have a row for each run and phase of ``phases`` (its smooth and acceptable limit) and one for ``joint``, the longest wait of each
    user who has all phases, with the largest limits: users who should be there (all of the run), ``missing`` ones, p50, p95, the longest wait and
    a grade. A phase is ``poor`` where users are missing or the limits fail, ``smooth`` or ``acceptable`` where p95 is within the limit and no wait is
    over twice that. Runs have how many users finished all phases, which metrics are poor, and the worst grade. Null waits are missing; other phases do not count.
    """
    kept = samples.where(F.col(phase).isin(*phases)).groupBy(run, user, phase).agg(F.max(wait).alias("wait")).where("wait is not null")
    joint = kept.groupBy(run, user).agg(F.count("*").alias("n"), F.max("wait").alias("wait")).where(F.col("n") == len(phases)).select(run, user, F.lit("joint").alias(phase), "wait")
    rows = kept.select(run, user, phase, "wait").unionByName(joint)
    limits = phases | {"joint": tuple(max(x) for x in zip(*phases.values(), strict=True))}
    users = samples.groupBy(run).agg(F.count_distinct(user).alias("users"))
    asked = users.select(run, "users", F.explode(F.array(*(F.struct(F.lit(p).alias(phase), F.lit(float(a)).alias("smooth"), F.lit(float(b)).alias("acceptable")) for p, (a, b) in limits.items()))).alias("x")).select(run, "users", "x.*")
    found = rollups.latency_summary(rows, [run, phase], "wait")
    rows = asked.join(found, [run, phase], "left").withColumn("missing", F.col("users") - F.coalesce("n", F.lit(0)))
    within = lambda limit: (F.col("missing") == 0) & (F.col("p95") <= F.col(limit)) & (F.col("top") <= 2 * F.col(limit))
    grade = F.when(within("smooth"), "smooth").when(within("acceptable"), "acceptable").otherwise("poor")
    metrics = rows.select(run, phase, "users", "missing", "p50", "p95", "top", grade.alias("grade"))
    poor = F.sort_array(F.collect_list(F.when(F.col("grade") == "poor", F.col(phase))))
    status = F.when(F.size("poor") > 0, "poor").when(F.col("fair"), "acceptable").otherwise("smooth")
    runs = metrics.groupBy(run).agg(F.max("users").alias("users"), F.max(F.when(F.col(phase) == "joint", F.col("users") - F.col("missing"))).alias("finished"), poor.alias("poor"), F.bool_or(F.col("grade") == "acceptable").alias("fair"))
    return metrics, runs.select(run, "users", "finished", "poor", status.alias("status"))
