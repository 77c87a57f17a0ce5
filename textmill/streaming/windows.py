"""Time-window analytics in batch form: rolling users, fixed windows from the first hit, rates, two-stage averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators import sequences


def rolling_distinct(df: DataFrame, ts: str, user: str, width_minutes: int, slide_minutes: int) -> DataFrame:
    """Distinct users in each sliding window: one row a window and user first, so the count itself never sees duplicates."""
    seen = df.select(F.window(ts, f"{width_minutes} minutes", f"{slide_minutes} minutes").alias("w"), user).distinct()
    return seen.groupBy("w").agg(F.count("*").alias("users")).select(F.col("w.start").alias("start"), "users")


def fixed_windows(df: DataFrame, keys: list[str], ts: str, order: list[str], limit: int, seconds: int) -> DataFrame:
    """Allowed and denied hits a key; a window opens at the first hit after the last one closed, so ``window()`` does not fit."""

    def step(s: tuple[int | None, int, int, int], row: tuple) -> tuple[int | None, int, int, int]:
        opened, n, allowed, denied = s
        opened, n = (row[0], 1) if opened is None or row[0] >= opened + seconds * 1_000_000 else (opened, n + 1)
        return opened, n, allowed + (n <= limit), denied + (n > limit)

    hits = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    return sequences.fold(hits, keys, ["_at", *order], ["_at"], lambda: (None, 0, 0, 0), step, lambda s: s[2:], f"{sequences.key_schema(df, keys)}, allowed long, denied long")


def cache_accounting(requests: DataFrame, keys: list[str], ts: str, order: list[str], seconds: int) -> DataFrame:
    """Misses and hits a key: a miss loads a value for ``seconds``; requests until then, also those that wait for the one load, are hits."""
    return fixed_windows(requests, keys, ts, order, 1, seconds).withColumnsRenamed({"allowed": "misses", "denied": "hits"})


def bucket(ts: str, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds)


def desired_replicas(active: Column, per_replica: int, spare: int, least: int, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(active / per_replica) + spare)).cast("long")


def counter_increase(df: DataFrame, keys: list[str], ts: str, tie: str, value: str) -> DataFrame:
    """Sum of what a counter gained; after a reset the new value itself counts."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(ts, tie))
    gained = F.when(before.isNull(), 0.0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    return df.withColumn("_gain", gained).groupBy(*keys).agg(F.round(F.sum("_gain"), 4).alias("increase"))
