"""Folds over a stream in the order of event time, whatever the order of arrival, with timers and with state that ends.

Rows wait in keyed state until the watermark has passed them; then they are folded in order, as the batch form folds them. What a
state itself has due (a lease that runs out) is folded in its place between them. A key that has had no row for ``idle`` loses its state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textmill.operators import sequences

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Fold:
    """A fold over rows (micros, *values): ``step`` gives the next state, ``due`` when something is to happen without a row (None: never)
    and ``fire`` what happens then; ``finish`` gives the output. States are what JSON can hold."""

    start: Callable[[], list]
    step: Callable[[list, tuple], list]
    finish: Callable[[list], tuple]
    output: str
    due: Callable[[list], int | None] = lambda _: None
    fire: Callable[[list, int], list] = lambda s, _: s

    def until(self, state: list, at: int) -> list:
        """The state after all that was due up to ``at``."""
        while (due := self.due(state)) is not None and due <= at:
            state = self.fire(state, due)
        return state

    def take(self, state: list, row: tuple) -> list:
        return self.step(self.until(state, row[0]), row)


def batch(rows: DataFrame, keys: list[str], ts: str, order: list[str], values: list[str], fold: Fold, end: int | None = None) -> DataFrame:
    """The fold over all rows of each key; with ``end``, in microseconds, what is due up to then happens as well."""
    timed = rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    finish = lambda s: fold.finish(s if end is None else fold.until(s, end))
    return sequences.fold(timed, keys, ["_at", *order], ["_at", *values], fold.start, fold.take, finish, f"{sequences.key_schema(rows, keys)}, {fold.output}")


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, keys: list[str], order: list[str], values: list[str], idle: int) -> None:
        self.fold, self.keys, self.order, self.values, self.idle = fold, keys, order, values, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "s string, last long, until long")
        self.waiting = handle.getMapState("waiting", "at long, place string", "v string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            for r in part[["at", *self.order, *self.values]].itertuples(index=False):
                plain = [None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x for x in r]
                if plain[0] <= passed:  # too late: what came after it is folded already
                    continue
                place = json.dumps(plain[1 : 1 + len(self.order)])
                self.waiting.updateValue((plain[0], place), (json.dumps(plain[1 + len(self.order) :]),))
                self.handle.registerTimer(-(-plain[0] // 1000))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.state.get() if self.state.exists() else None
        if held and passed <= held[2]:  # an earlier timer of this batch has done it
            return iter([])
        ready = sorted((k[0], json.loads(k[1]), k[1], json.loads(v[0])) for k, v in self.waiting.iterator() if k[0] <= passed)
        state, last = (json.loads(held[0]), held[1]) if held else (self.fold.start(), 0)
        if not ready and passed - last >= self.idle:
            self.state.clear()
            return iter([])
        for at, _, place, values in ready:
            state, last = self.fold.take(state, (at, *values)), at
            self.waiting.removeKey((at, place))
        state = self.fold.until(state, passed)
        self.state.update((json.dumps(state), last, passed))
        for at in {last + self.idle, self.fold.due(state)} - {None}:
            self.handle.registerTimer(max(-(-at // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        out = self.fold.finish(state)
        names = [x.split()[0] for x in self.fold.output.split(", ")]
        return iter([pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, **{n: [v] for n, v in zip(names, out, strict=True)}})])

    def close(self) -> None:
        pass


def stream(rows: DataFrame, keys: list[str], ts: str, order: list[str], values: list[str], fold: Fold, late: str = "1 hour", idle_seconds: int = 7 * 86_400) -> DataFrame:
    """The fold as a stream: a key's output again whenever the watermark has let rows of it, or something due, pass.

    ``order`` tells rows of one time apart: rows that are equal in it and in time are one row. Rows later than ``late`` are left out. The session
    must keep its state in RocksDB (PROVIDER).
    """
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    named = {f"{kind}{i}": c for kind, columns in (("o", order), ("v", values)) for i, c in enumerate(columns)}  # pandas keeps such names
    timed = timed.select(*keys, ts, F.unix_micros(ts).alias("at"), *(F.col(c).alias(n) for n, c in named.items()))
    schema = f"{sequences.key_schema(rows, keys)}, {fold.output}"
    made = _Ordered(fold, keys, [n for n in named if n[0] == "o"], [n for n in named if n[0] == "v"], idle_seconds * 1_000_000)
    return timed.groupBy(*keys).transformWithStateInPandas(made, schema, "Update", "EventTime")


# --- folds


def rate_limit(limit: int, seconds: int) -> Fold:
    """Hits allowed and denied; a window opens at the first hit after the last one closed."""

    def step(s: list, row: tuple) -> list:
        opened, n, allowed, denied = s
        opened, n = (row[0], 1) if opened is None or row[0] >= opened + seconds * 1_000_000 else (opened, n + 1)
        return [opened, n, allowed + (n <= limit), denied + (n > limit)]

    return Fold(lambda: [None, 0, 0, 0], step, lambda s: tuple(s[2:]), "allowed long, denied long")


def budget(cap: float) -> Fold:
    """Amounts granted while they fit under the cap; a rejected one uses nothing. A null amount is none."""

    def step(s: list, row: tuple) -> list:
        used, granted, rejected = s
        fits = used + (row[1] or 0.0) <= cap
        return [used + (row[1] or 0.0), granted + 1, rejected] if fits else [used, granted, rejected + 1]

    return Fold(lambda: [0.0, 0, 0], step, lambda s: (round(s[0], 4), s[1], s[2]), "used double, granted long, rejected long")


def leases(capacity: int, seconds: int) -> Fold:
    """Rows (micros, acquire, id, priority): at most ``capacity`` ids hold a lease, which runs out after ``seconds``.

    Who finds none free waits, by priority (low first), then time, then id, and gets the next that is given back or runs out. Acquiring again
    renews a lease and changes no place in the queue; giving back (acquire false) also takes a waiting id out of it.
    """
    ttl = seconds * 1_000_000

    def served(s: dict, at: int) -> dict:
        while s["queue"] and len(s["active"]) < capacity:
            first = min(s["queue"])
            s["queue"].remove(first)
            s["active"][first[2]] = at + ttl
            s["granted"], s["waited"] = s["granted"] + 1, s["waited"] + at - first[1]
        return s

    def step(state: list, row: tuple) -> list:
        s, (at, acquire, who, priority) = state[0], row
        who = str(who)
        if acquire:
            if who in s["active"]:
                s["active"][who] = at + ttl
            elif all(q[2] != who for q in s["queue"]):
                s["queue"].append([priority or 0, at, who])
        else:
            s["released"] += s["active"].pop(who, None) is not None
            s["queue"] = [q for q in s["queue"] if q[2] != who]
        return [served(s, at)]

    def fire(state: list, at: int) -> list:
        s = state[0]
        gone = [w for w, end in s["active"].items() if end <= at]
        for who in gone:
            del s["active"][who]
        s["expired"] += len(gone)
        return [served(s, at)]

    return Fold(
        lambda: [{"active": {}, "queue": [], "granted": 0, "expired": 0, "released": 0, "waited": 0}], step,
        lambda x: (x[0]["granted"], x[0]["expired"], x[0]["released"], x[0]["waited"] // 1_000_000, len(x[0]["active"]), len(x[0]["queue"])),
        "granted long, expired long, released long, waited_seconds long, active long, waiting long",
        due=lambda x: min(x[0]["active"].values(), default=None), fire=fire,
    )


def cache(seconds: int, most: int) -> Fold:
    """Rows (micros, item, invalidates): a cache of at most ``most`` items, each loaded at its miss for ``seconds``.

    A hit needs an item that is loaded and has not run out; the item used longest ago goes where one too many is loaded. Invalidating takes an item out.
    """

    def step(s: list, row: tuple) -> list:
        items, hits, misses, evicted, invalidated = s
        at, item, invalidates = row[0], str(row[1]), row[2]
        held = items.pop(item, None)  # the order of the items is that of their last use
        if invalidates:
            return [items, hits, misses, evicted, invalidated + (held is not None)]
        if held is not None and at < held:
            items[item] = held
            return [items, hits + 1, misses, evicted, invalidated]
        items[item] = at + seconds * 1_000_000
        if len(items) > most:
            del items[next(iter(items))]
            evicted += 1
        return [items, hits, misses + 1, evicted, invalidated]

    return Fold(lambda: [{}, 0, 0, 0, 0], step, lambda s: (*s[1:], len(s[0])), "hits long, misses long, evicted long, invalidated long, held long")
