"""Order-dependent selection from one query's ranked candidates: quotas, prefix reordering, unit combinations.

Each step depends on what was taken before, so a query's candidate list (a few dozen rows, bounded by the branches' limits)
is one Python group; many queries run side by side.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators import dedup, ranking, rollups


@dataclass
class Candidate:
    id: str
    rank: int
    scope: str = ""
    source: str = ""
    family: str = ""
    evidence: str = ""
    terms: frozenset = field(default_factory=frozenset)


def _candidates(group: pd.DataFrame) -> list[Candidate]:
    rows = group.sort_values("rank")
    return [
        Candidate(str(r.id), int(r.rank), r.scope or "", r.source or "", r.family or "", r.evidence or "", frozenset(r.terms if r.terms is not None else ())) for r in rows.itertuples()
    ]


def quota_selection(candidates: Iterable[Candidate], minimums: dict[str, int], k: int, preferred: Iterable[str] = ()) -> list[Candidate]:
    """First each scope's minimum, in declared order; then the best of the rest; returned in rank order.

    A scope's next candidate has, in this order, no family in conflict with a taken one, most new preferred terms, most
    preferred terms, unused evidence, and the best rank. The rest is filled without conflicts before with them.
    """
    wanted, left, taken = frozenset(preferred), list(candidates), []
    seen_terms: set = set()

    def conflict(c: Candidate) -> bool:
        return bool(c.family) and any(t.family == c.family and t.scope == c.scope for t in taken)

    def used(c: Candidate) -> bool:
        return bool(c.evidence) and any(t.evidence == c.evidence for t in taken)

    def take(c: Candidate) -> None:
        taken.append(c)
        left.remove(c)
        seen_terms.update(c.terms & wanted)

    for scope, least in minimums.items():
        for _ in range(max(0, min(least, k - len(taken)))):
            mine = [c for c in left if c.scope == scope]
            if not mine:
                break
            take(min(mine, key=lambda c: (conflict(c), -len((c.terms & wanted) - seen_terms), -len(c.terms & wanted), used(c), c.rank)))
    while left and len(taken) < k:
        take(min(left, key=lambda c: (conflict(c), -len((c.terms & wanted) - seen_terms), used(c), c.rank)))
    return sorted(taken, key=lambda c: c.rank)


def prefix_reorder(candidates: Iterable[Candidate], window: int, targets: dict[str, int], per_source: int = 2) -> list[Candidate]:
    """The first ``window`` places meet each scope's target as far as they can; nothing is dropped.

    The rest of the window is filled by rank; a source used ``per_source`` times yields to the next one used less often, if there
    is one. Without a window or a target the order stays.
    """
    order = list(candidates)
    if window <= 0 or not any(n > 0 for n in targets.values()):
        return order
    head: list[Candidate] = []
    covered: set = set()
    for scope, n in targets.items():
        for _ in range(max(0, min(n, window - len(head)))):
            mine = [c for c in order if c.scope == scope and c not in head]
            if not mine:
                break
            best = min(mine, key=lambda c: (-len(c.terms - covered), -len(c.terms), bool(c.family) and any(h.family == c.family for h in head), c.rank))
            covered |= best.terms
            head.append(best)
    while len(head) < min(window, len(order)):
        rest = [c for c in order if c not in head]
        fresh = [c for c in rest if sum(h.source == c.source for h in head) < per_source]
        head.append((fresh or rest)[0])
    return head + [c for c in order if c not in head]


MOST_COMBINED = 8


def covering_units(units: DataFrame, keys: list[str], id_col: str, order: str, text_col: str, needed: list[str], most_chars: int) -> DataFrame:
    """(keys, units): for each key the least number of units that together hold all needed terms within ``most_chars``.

    Of a key's units the first MOST_COMBINED that are no near-duplicates of one another are combined. One unit is enough where it holds
    all; among equal counts most term contributions win, then the first units. Keys without such a combination give no row.
    """
    wanted = F.array(*map(F.lit, needed))
    distinct = dedup.diversify(units.select(*dict.fromkeys([*keys, id_col, order, text_col])), keys, order, text_col, limit=MOST_COMBINED)
    held = distinct.select(*keys, F.struct(F.col(order).alias("at"), F.col(id_col).alias("id"), F.char_length(text_col).alias("length"), F.filter(wanted, lambda t: F.array_contains(ranking.terms(text_col), t)).alias("terms")).alias("unit"))
    grouped = held.groupBy(*keys).agg(F.array_sort(F.collect_list("unit")).alias("units"))  # MOST_COMBINED at most
    masks = grouped.select(*keys, "units", F.explode(F.sequence(F.lit(1), F.expr("CAST(shiftleft(1, size(units)) - 1 AS INT)"))).alias("mask"))
    places = F.filter(F.sequence(F.lit(0), F.size("units") - 1), lambda i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    chosen = masks.withColumn("places", places).withColumn("chosen", F.transform("places", lambda i: F.get("units", i)))
    total = F.aggregate("chosen", F.lit(0), lambda s, u: s + u["length"])
    gained = F.aggregate("chosen", F.lit(0), lambda s, u: s + F.size(u["terms"]))
    fits = chosen.where((total <= most_chars) & (F.size(F.array_distinct(F.flatten(F.transform("chosen", lambda u: u["terms"])))) == len(set(needed))))
    ranked = F.struct(F.size("places").alias("n"), (-gained).alias("less"), F.col("places"))
    return fits.groupBy(*keys).agg(F.min_by(F.transform("chosen", lambda u: u["id"]), ranked).alias("units"))


def cycle(rows: DataFrame, id_col: str, times: float) -> DataFrame:
    """Each row with a ``copy`` number, so that there are ``times`` as many rows: whole rounds, then the first rows by id again.

    The last, partial round is cut by a range of ids that holds as many rows, not by a numbering of all rows in one task.
    """
    whole, part = int(times), times - int(times)
    full = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))) if whole else rows.limit(0).withColumn("copy", F.lit(0))
    count = rows.count()
    n = int(count * times) - whole * count
    if part <= 0 or n <= 0:
        return full
    last = rollups.percentiles(rows.withColumn("_all", F.lit(1)), ["_all"], id_col, {"last": n / count}).first()["last"]
    below = rows.where(F.col(id_col) < last)
    tied = rows.where(F.col(id_col) == last).limit(n - below.count())
    return full.unionByName(below.unionByName(tied).withColumn("copy", F.lit(whole)))


SCHEMA = "query_id long, id string, position long"


def select_with_quotas(ranked: DataFrame, minimums: dict[str, int], k: int, preferred: list[str]) -> DataFrame:
    """Rows (query_id, id, rank, scope, source, family, evidence, terms) -> (query_id, id, position)."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        chosen = quota_selection(_candidates(group), minimums, k, preferred)
        return pd.DataFrame({"query_id": key[0], "id": [c.id for c in chosen], "position": range(1, len(chosen) + 1)})

    return ranked.groupBy("query_id").applyInPandas(run, SCHEMA)


def reorder_prefix(ranked: DataFrame, window: int, targets: dict[str, int]) -> DataFrame:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        order = prefix_reorder(_candidates(group), window, targets)
        return pd.DataFrame({"query_id": key[0], "id": [c.id for c in order], "position": range(1, len(order) + 1)})

    return ranked.groupBy("query_id").applyInPandas(run, SCHEMA)


def exact_fact_scores(facts: DataFrame, corpus_rows: int) -> DataFrame:
    """Facts (query_id, group_id, identity, df, phrase, authority) -> (query_id, group_id, score).

    idf = ln((N + 1) / (df + 1)) + 1 with df between 1 and N; an identity adds 0.35 for a phrase or 0.15 for a context match and
    0.45 for authority; a group has its best identity and a quarter for each further one, 0.75 at most.
    """
    n = F.lit(max(1, corpus_rows))
    df = F.greatest(F.lit(1), F.least(n, F.col("df")))
    score = F.log((n + 1) / (df + 1)) + 1 + F.when(F.col("phrase"), 0.35).otherwise(0.15) + F.when(F.col("authority"), 0.45).otherwise(0.0)
    identities = facts.groupBy("query_id", "group_id", "identity").agg(F.max(score).alias("s"))
    bonus = F.least(F.lit(0.75), 0.25 * (F.count("*") - 1))
    return identities.groupBy("query_id", "group_id").agg(F.round(F.max("s") + bonus, 6).alias("score"))


def structural_scores(hits: DataFrame) -> DataFrame:
    """Hits (query_id, unit_id, coverage, idf_sum, complete, length) ranked by coverage, then idf + 4 if complete + 1 / log2(length + 2)."""
    score = F.col("idf_sum") + F.when(F.col("complete"), 4.0).otherwise(0.0) + 1 / F.log2(F.col("length") + 2.0)
    return hits.withColumn("score", F.round(score, 6))
