"""Aggregates: percentiles, pass rates, fingerprints, recalls, latest non-null values."""

from __future__ import annotations

import hashlib
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators import sequences
from textmill.session import written


SETTLED = 10_000  # values of a key that are put in order at the end
RANGES = 128  # that each pass cuts what is left of a key into
BROADCAST_KEYS = 100_000


def percentiles(df: DataFrame, keys: list[str], column: str, fractions: dict[str, float], settled: int = SETTLED) -> DataFrame:
    """Each key's nearest-rank percentiles, by name, of the values that are not null: the least value with ``fraction`` of them at or below it.

    Exact for any number of values a key: a pass cuts each key's values into RANGES at approximate quantiles, counts the ranges and keeps the one
    that holds the rank, until at most ``settled`` values are left to be put in order, or one value. Tasks hold RANGES counts
    a key, never its values. Keys whose values are all null have a row of nulls. Numbers and times only.
    """
    rows = df.select(*keys, F.col(column).alias("_v"))
    same = lambda a, b: reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    ranks = [F.struct(F.lit(name).alias("_f"), F.greatest(F.ceil(F.col("_n") * F.lit(Decimal(str(f)))), F.lit(1)).cast("long").alias("_r")) for name, f in fractions.items()]
    state = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = state.select(*keys, F.explode(F.array(*ranks)).alias("_x"), F.col("_n").alias("_in"), "_lo", "_hi").select(*keys, "_x.*", "_in", "_lo", "_hi")
    state = written(state, "percentile-state")

    def inside(part: DataFrame) -> DataFrame:
        part = F.broadcast(part) if part.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else part
        met = rows.alias("v").join(part.alias("s"), same("v", "s") & (F.col("v._v") >= F.col("s._lo")) & (F.col("v._v") <= F.col("s._hi")))
        return met.select("s.*", "v._v")

    by = [*keys, "_f", "_r"]
    wide = (F.col("_in") > settled) & (F.col("_lo") < F.col("_hi"))
    while not (large := state.where(wide)).isEmpty():
        held = inside(large)
        cuts = held.groupBy(*by).agg(F.percentile_approx("_v", [i / RANGES for i in range(RANGES + 1)], 20 * RANGES).alias("_cuts"))
        cuts = written(large.alias("s").join(cuts.alias("c"), same("s", "c") & (F.col("s._f") == F.col("c._f"))).select("s.*", "c._cuts"), "percentile-cuts")
        place = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        counts = inside(cuts).groupBy(*by, place.alias("_i")).agg(F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_in").over(Window.partitionBy(*by).orderBy("_i"))  # RANGES + 2 rows a key
        ranked = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_r")) & (F.col("_upto") - F.col("_in") < F.col("_r")))
        next_state = ranked.select(*keys, "_f", (F.col("_r") - F.col("_upto") + F.col("_in")).alias("_r"), "_in", "_lo", "_hi")
        state = written(state.where(~F.coalesce(wide, F.lit(False))).unionByName(next_state), "percentile-state")
    single = state.where("_lo is null or _lo >= _hi").select(*keys, "_f", F.col("_lo").alias("_v"))
    left = inside(state.where("_lo < _hi")).groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    ordered = left.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy("_v"))).where(F.col("_upto") >= F.col("_r"))
    found = single.unionByName(ordered.groupBy(*keys, "_f").agg(F.min("_v").alias("_v")))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_f") == name, F.col("_v"))).alias(name) for name in fractions))


def rounded_index_percentile(df: DataFrame, keys: list[str], column: str, fraction: float, name: str) -> DataFrame:
    """The value at index round((n - 1) * fraction), half to even, of the sorted values; equal values are counted before they are ordered."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
    ranked = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    at = F.bround((F.col("_n") - 1) * F.lit(fraction), 0) + 1
    return ranked.where(F.col("_upto") >= at).groupBy(*keys).agg(F.min("_v").alias(name))


def latency_summary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Count, p50, p95, p99 and maximum of each key's values that are not null."""
    plain = df.groupBy(*keys).agg(F.count(column).alias("n"), F.max(column).alias("top"))
    found = percentiles(df, keys, column, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    met = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))
    return plain.alias("a").join(found.alias("b"), met).select("a.*", "b.p50", "b.p95", "b.p99")


def pass_rates(runs: DataFrame, k: int, keys: list[str], overall: bool = False) -> DataFrame:
    """pass@1, pass@k (any) and pass-all@k (k attempts, all passed) from rows (keys, case_id, attempt, passed)."""
    cases = runs.where(F.col("attempt") <= k).groupBy(*keys, "case_id").agg(
        F.bool_or(F.when(F.col("attempt") == 1, F.col("passed"))).alias("_first"), F.bool_or("passed").alias("_any"), ((F.count("*") == k) & F.bool_and("passed")).alias("_all")
    )
    rates = [F.avg(F.col(c).cast("int")).alias(n) for c, n in (("_first", "pass_1"), ("_any", "pass_k"), ("_all", "pass_all_k"))]
    if overall:
        return cases.groupingSets([[], [F.col(k) for k in keys]], *keys).agg(*rates)
    return cases.groupBy(*keys).agg(*rates)


def failure_rate(failed: Column, counted: str) -> Column:
    n = F.count(counted)
    return F.when(n == 0, 1.0).otherwise(F.count_if(failed) / F.greatest(n, F.lit(1)))


def changed_rows(stored: DataFrame, fresh: DataFrame, keys: list[str], column: str) -> DataFrame:
    old = stored.withColumnRenamed(column, "_old")
    return old.join(fresh, keys).where(~F.col("_old").eqNullSafe(F.col(column))).drop("_old")


def fingerprint(df: DataFrame, keys: list[str], id_col: str, text_col: str) -> DataFrame:
    """SHA-256 over the ordered (id, content hash) rows of each key; only hashes are shuffled, not texts, and streamed."""
    rows = df.withColumn("_line", F.concat(F.col(id_col).cast("string"), F.lit(":"), F.sha2(text_col, 256)))

    def step(state: list, row: tuple) -> list:
        state[0].update(("\n" * state[1] + row[0]).encode())
        state[1] = 1
        return state

    return sequences.fold(rows, keys, [id_col, "_line"], ["_line"], lambda: [hashlib.sha256(), 0], step, lambda s: (s[0].hexdigest(),), f"{sequences.key_schema(df, keys)}, fingerprint string")


def multiset_recall(df: DataFrame, keys: list[str], native: str, parsed: str) -> DataFrame:
    """Sum of least counts over the native tokens, by one aggregate on signed sides instead of a join."""
    def side(column: str, name: str) -> DataFrame:
        tokens = F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), 0)
        return df.select(*keys, F.explode(tokens).alias("_t"), F.lit(1 if name == "n" else 0).alias("_n"), F.lit(1 if name == "p" else 0).alias("_p"))

    counts = side(native, "n").unionByName(side(parsed, "p")).groupBy(*keys, "_t").agg(F.sum("_n").alias("n"), F.sum("_p").alias("p")).where("n > 0")
    return counts.groupBy(*keys).agg(F.round(F.sum(F.least("n", "p")) / F.sum("n"), 6).alias("recall"))


def latest_non_null(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column]) -> DataFrame:
    """For each column the latest value that is not null."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.max_by(v, F.when(v.isNotNull(), at)).alias(n) for n, v in columns.items()))
