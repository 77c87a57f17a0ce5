"""Versioned tables: late rows, buckets that stay as they are, batches fed again, checked rebuilds, two writers."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from textmill.session import scratch
from textmill.sources.versioned import Refused, VersionedTable
from textmill.streaming import live


def rows(spark, data):
    return spark.createDataFrame(data, "k long, `a.b` string, at int")


def held(table) -> dict:
    return {r["k"]: (r["a.b"], r["at"]) for r in table.read().collect()}


def times(table) -> dict:
    root = table.path.removeprefix("file:")
    return {b: {f: os.stat(f"{root}/{folder}/{f}").st_mtime_ns for f in os.listdir(f"{root}/{folder}") if f.endswith(".parquet")} for b, folder in table.manifest()["folders"].items()}


def test_merges_touch_only_their_buckets_and_late_rows_lose(spark):
    first = rows(spark, [(i, "old", 10) for i in range(200)] + [(None, "null key", 1)])
    table = VersionedTable(spark, scratch(spark, "versioned"), first.schema, ["k"], ["at"], 8)
    assert held(table) == {} and table.merge(first) == 1
    before = times(table)
    assert len(before) == 8 and all(before.values())
    assert table.merge(rows(spark, [(1, "late", 3), (2, "new", 11), (2, "newest", 12), (3, "as new", 10), (500, "more", None)])) == 2
    got = held(table)
    assert got[1] == ("old", 10) and got[2] == ("newest", 12) and got[3] == ("as new", 10) and got[500] == ("more", None) and got[None] == ("null key", 1) and len(got) == 202
    same = [b for b, files in times(table).items() if files == before[b]]
    assert 4 <= len(same) < 8
    assert table.merge(first.limit(0)) == 3 and held(table) == got
    table.vacuum()
    assert held(table) == got and held(VersionedTable(spark, table.path, first.schema, ["k"], ["at"])) == got
    assert VersionedTable(spark, table.path, first.schema, ["k"], ["at"], 99).buckets == 8


def test_batches_fed_again_and_two_writers(spark):
    data = rows(spark, [(1, "a", 1)])
    table = VersionedTable(spark, scratch(spark, "versioned"), data.schema, ["k"], ["at"], 4)
    assert table.merge(data, 0, "s") == 1 and table.merge(rows(spark, [(1, "again", 5)]), 0, "s") == 1 and held(table) == {1: ("a", 1)}
    assert table.merge(rows(spark, [(1, "b", 2)]), 0, "other") == 2 and table.merge(rows(spark, [(1, "c", 3)]), 1, "s") == 3
    old = table.manifest()
    table.merge(rows(spark, [(2, "x", 1)]))
    with pytest.raises(Refused, match="another call"):
        table._commit(old, {}, {})
    root = table.path.removeprefix("file:")
    with open(f"{root}/_versions/{99:012d}.json", "w") as f:  # a writer that died half-way
        f.write('{"version": 99, "fol')
    assert held(table) == {1: ("c", 3), 2: ("x", 1)}


def test_rebuilds_are_checked_before_they_are_seen(spark):
    data = rows(spark, [(i, "v1", 1) for i in range(20)])
    table = VersionedTable(spark, scratch(spark, "versioned"), data.schema, ["k"], ["at"], 4)
    assert table.rebuild(data) == 1
    for bad, why in ((data.limit(0), "rows"), (data.unionAll(data), "unique keys"), (rows(spark, [(None, "x", 1)]), "not null")):
        with pytest.raises(Refused, match=why):
            table.rebuild(bad)
    with pytest.raises(Refused, match="twenty rows"):
        table.rebuild(data.where("k < 5"), {"twenty rows": lambda made: made.count() == 20})
    assert table.manifest()["version"] == 1 and len(held(table)) == 20
    assert table.rebuild(data.withColumn("a.b", F.lit("v2")).where("k < 5"), {"five": lambda made: made.count() == 5}) == 2
    assert held(table) == {i: ("v2", 1) for i in range(5)}


def test_a_stream_that_is_restarted_and_fed_late_rows(spark):
    source, checkpoint = scratch(spark, "in"), scratch(spark, "state")
    parts = [[(1, "ten", 10), (2, "a", 1)], [(1, "three", 3), (2, "b", 2)], [(3, "c", 1), (2, "old", 0)]]
    table = VersionedTable(spark, scratch(spark, "synced"), rows(spark, []).schema, ["k"], ["at"], 4)
    for part in parts:
        rows(spark, part).coalesce(1).write.mode("append").parquet(source)
        live.sync_corpus(live.event_stream(spark, source, rows(spark, [])), table, checkpoint).awaitTermination()
    assert held(table) == {1: ("ten", 10), 2: ("b", 2), 3: ("c", 1)}
    assert table.manifest()["batches"][checkpoint] == 2
