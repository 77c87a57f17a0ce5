"""Streams folded in event time: equal to the batch form under disorder, repeats and restarts, and their state ends."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textmill.session import scratch
from textmill.streaming import live, ordered

SCHEMA = "k long, ts timestamp, id long, acquire boolean, amount double"
DAY = 86_400


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(ordered.PROVIDER[0], None)
    spark.conf.set(*ordered.PROVIDER)
    yield spark
    spark.conf.unset(ordered.PROVIDER[0]) if before is None else spark.conf.set(ordered.PROVIDER[0], before)


def rows(spark, data):
    return spark.createDataFrame(data, "k long, s long, id long, acquire boolean, amount double").select("k", F.timestamp_seconds("s").alias("ts"), "id", "acquire", "amount")


def plain_leases(data, capacity, seconds, end):
    """By trying every second."""
    active, queue, out = {}, [], [0, 0, 0, 0]
    by = {}
    for k, s, i, acquire, amount in data:
        by.setdefault(s, []).append((i, acquire, amount))

    def serve(s):
        while queue and len(active) < capacity:
            first = min(queue)
            queue.remove(first)
            active[first[2]] = s + seconds
            out[0] += 1
            out[3] += s - first[1]

    for s in range(min(by), end + 1):
        gone = [w for w, e in active.items() if e <= s]
        for w in gone:
            del active[w]
        out[1] += len(gone)
        serve(s)
        for i, acquire, amount in sorted(by.get(s, [])):
            who = str(i)
            if acquire and who in active:
                active[who] = s + seconds
            elif acquire and all(q[2] != who for q in queue):
                queue.append([amount or 0, s, who])
            elif not acquire:
                out[2] += active.pop(who, None) is not None
                queue[:] = [q for q in queue if q[2] != who]
            serve(s)
    return (*out, len(active), len(queue))


def test_streams_equal_batches_under_disorder_and_restarts(rocks):
    spark, rng = rocks, random.Random(8)
    data = [(k, s, rng.randrange(9), rng.random() < 0.7, float(rng.randrange(3))) for k in (1, 2, 3) for s in sorted(rng.sample(range(1000, 3000), 60))]
    cases = {
        "leases": (ordered.leases(2, 120), ["acquire", "id", "amount"]), "rate": (ordered.rate_limit(2, 300), []), "budget": (ordered.budget(20.0), ["amount"]),
    }
    disorder = sorted(data, key=lambda r: r[1] + rng.randrange(-400, 400))
    parts = [disorder[:90], disorder[60:], [(0, 9000, 0, True, 0.0)], [(0, 9100, 1, True, 0.0)]]  # some come twice; the last ones move the watermark
    for name, (fold, values) in cases.items():
        end = 9100 - 1500
        batch = {r.k: r[1:] for r in ordered.batch(rows(spark, data), ["k"], "ts", ["id", "acquire"], values, fold, end * 1_000_000).collect()}
        if name == "leases":
            assert batch == {k: plain_leases([r for r in data if r[0] == k], 2, 120, end) for k in (1, 2, 3)}
        source, checkpoint, out = (scratch(spark, x) for x in ("in", "state", "out"))
        for part in parts:  # a new query on the same checkpoint each time
            rows(spark, part).coalesce(1).write.mode("append").parquet(source)
            found = ordered.stream(live.event_stream(spark, source, rows(spark, [])), ["k"], "ts", ["id", "acquire"], values, fold, "1500 seconds", 90 * DAY)
            found.writeStream.foreachBatch(lambda df, n, o=out: df.withColumn("n", F.lit(n)).write.mode("append").parquet(o)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        last = {}
        for r in spark.read.parquet(out).orderBy("n").collect():
            last[r.k] = r[1:-1]
        assert {k: v for k, v in last.items() if k} == batch, name


def test_state_ends_after_its_idle_time(rocks):
    spark = rocks
    source, checkpoint, out = (scratch(spark, x) for x in ("in", "state", "out"))
    parts = [[(1, 100, 1, True, 5.0)], [(0, 2000, 0, True, 0.0)], [(0, 9000, 0, True, 0.0)], [(0, 9001, 5, True, 0.0)], [(1, 9500, 2, True, 7.0), (0, 12000, 0, True, 0.0)], [(0, 12001, 7, True, 0.0)], [(1, 50, 3, True, 1.0)]]
    for part in parts:
        rows(spark, part).coalesce(1).write.mode("append").parquet(source)
        found = ordered.stream(live.event_stream(spark, source, rows(spark, [])), ["k"], "ts", ["id"], ["amount"], ordered.budget(10.0), "10 seconds", 1000)
        found.writeStream.foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = [r.used for r in spark.read.parquet(out).where("k = 1").orderBy("n").collect()]
    assert got == [5.0, 7.0]  # the budget of key 1 was new again, and the row from before the watermark came to nothing


def test_leases_and_caches_of_all_events(spark, sf_dir):
    import json
    from collections import OrderedDict, defaultdict

    import duckdb

    from textmill.plans import QUERIES

    users = defaultdict(list)
    for u, s, i, kind, value, props in duckdb.sql(f"SELECT user_id, epoch_us(ts), event_id, event_type, value, props FROM '{sf_dir}/events.parquet' ORDER BY user_id, ts, event_id").fetchall():
        users[u].append((s, i, kind, value, json.loads(props)["k"]))
    cached = {r.user_id: r[1:] for r in QUERIES["t13_bounded_cache"](spark, sf_dir).collect()}
    leased = {r.user_id: r for r in QUERIES["t11_leases"](spark, sf_dir).collect()}
    assert set(cached) == set(leased) == set(users)
    for u, mine in users.items():
        held, n = OrderedDict(), [0, 0, 0, 0]
        for s, _, kind, _, k in mine:
            item = k // 5
            if kind == "error":
                n[3] += held.pop(item, None) is not None
            elif item in held and s < held[item]:
                held.move_to_end(item)
                n[0] += 1
            else:
                held.pop(item, None)
                held[item] = s + 86_400_000_000
                n[1] += 1
                if len(held) > 8:
                    held.popitem(last=False)
                    n[2] += 1
        assert tuple(cached[u]) == (*n, len(held))
        active, queue, granted, expired = {}, [], 0, 0  # every change of a lease, in order of time
        for s, _, kind, value, _ in mine:
            while active and min(active.values()) <= s:
                now = min(active.values())
                expired += sum(e == now for e in active.values())
                active = {w: e for w, e in active.items() if e > now}
                while queue and len(active) < 2:
                    first = queue.pop(queue.index(min(queue)))
                    active[first[2]], granted = now + 7_200_000_000, granted + 1
            who = "click" if kind == "purchase" else kind
            if kind == "purchase":
                active.pop(who, None)
                queue = [q for q in queue if q[2] != who]
            elif who in active:
                active[who] = s + 7_200_000_000
            elif who not in [q[2] for q in queue]:
                queue.append((value // 20, s, who))
            while queue and len(active) < 2:
                first = queue.pop(queue.index(min(queue)))
                active[first[2]], granted = s + 7_200_000_000, granted + 1
        r = leased[u]
        assert (r.granted, r.expired, r.active, r.waiting) == (granted, expired, len(active), len(queue)), u


def test_new_keys_with_a_time_to_live(spark):
    from textmill.sources.versioned import VersionedTable

    data = [[("a", 0, 1), ("a", 5, 2), ("b", 1, 3), (None, 1, 4)], [("a", 50, 5), ("c", 60, 6)], [("a", 200, 7), ("b", 90, 8)]]
    make = lambda part: spark.createDataFrame(part, "host string, s long, n long").select("host", F.timestamp_seconds("s").alias("at"), "n")
    source, state, out = (scratch(spark, x) for x in ("in", "state", "out"))
    known = VersionedTable(spark, scratch(spark, "known"), make([]).select("host", "at").schema, ["host"], ["at"], 4)
    for part in data:
        make(part).coalesce(1).write.mode("append").parquet(source)
        live.new_keys(live.event_stream(spark, source, make([])), known, out, "host", "at", state, "100 seconds").awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 3, 6, 7]
