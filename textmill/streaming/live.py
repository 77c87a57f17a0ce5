"""Structured Streaming forms: windowed counts under a watermark, first-hit windows and latest versions as keyed state, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textmill.session import written
from textmill.sources.versioned import VersionedTable


def event_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def active_users(events: DataFrame, width: str = "15 minutes", slide: str = "5 minutes", late: str = "24 hours") -> DataFrame:
    """Sketched distinct users in sliding windows; state older than ``late`` is evicted."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.approx_count_distinct("user_id", 0.01).alias("users"))


def distinct_events(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(user_id, allowed, denied) running totals; a window opens at a user's first hit after the last one closed."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n, allowed, denied = state.get if state.exists else (-1, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for t in rows["ts"].astype("int64") // 1000 if rows["ts"].dtype.str.endswith("[ns]") else rows["ts"].astype("int64"):
            if opened < 0 or t >= opened + seconds * 1_000_000:
                opened, n = int(t), 0
            n += 1
            allowed, denied = (allowed + 1, denied) if n <= limit else (allowed, denied + 1)
        state.update((opened, n, allowed, denied))
        yield pd.DataFrame({"user_id": [key[0]], "allowed": [allowed], "denied": [denied]})

    schema = "user_id long, allowed long, denied long"
    return events.groupBy("user_id").applyInPandasWithState(update, schema, "opened long, n long, allowed long, denied long", "update", GroupStateTimeout.NoTimeout)


def latest_version(updates: DataFrame) -> DataFrame:
    """The summary with the newest generation, then the furthest coverage, of each session (columns session_id, generation, covered, body)."""
    return updates.groupBy("session_id").agg(F.max(F.struct("generation", "covered", "body")).alias("v")).select("session_id", "v.*")


def sync_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Feed each micro-batch to ``apply``; the checkpoint makes a restarted run go on where it stopped."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_corpus(stream: DataFrame, table: VersionedTable, checkpoint: str):  # noqa: ANN201
    """Keep a versioned table at the newest row of each key: every micro-batch is merged into the buckets of its keys.

    A late row loses against what is stored. A batch that is fed again after a failure is known by its number, so the table is right after any restart.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table.merge(batch, number, checkpoint)

    return sync_batches(stream, apply, checkpoint)


def new_keys(stream: DataFrame, known: VersionedTable, out: str, key: str, ts: str, checkpoint: str, ttl: str | None = None):  # noqa: ANN201
    """Write below ``out`` the first row of each key that no earlier row, of this or of an earlier run, has shown; ``known`` (key, ts) keeps them all.

    With a ``ttl``, an interval such as ``7 days``, a key is new again that long after it was last new. A batch that is fed again writes the same rows
    or, where it was finished, none. Null keys are left out.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if number <= known.manifest()["batches"].get(checkpoint, -1):
            return
        first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct(ts, *(c for c in batch.columns if c not in (key, ts)))).alias("r")).select("r.*")
        seen = known.read().select(F.col(key).alias("_key"), F.col(ts).alias("_ts"))
        still = (F.col(key) == F.col("_key")) & (F.lit(True) if ttl is None else F.col(ts) < F.col("_ts") + F.expr(f"INTERVAL {ttl}"))
        fresh = written(first.join(seen, still, "left_anti"), "new-keys")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        known.merge(fresh.select(key, ts), number, checkpoint)

    return sync_batches(stream, apply, checkpoint)


def json_sink(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
