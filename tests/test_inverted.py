"""The kept inverted index against scoring everything in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from textmill.operators.inverted import InvertedIndex
from textmill.session import scratch


def plain(docs: dict, queries: dict, k: int) -> dict:
    bags = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in docs.items()}
    mean = sum(b.total() for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for q, text in queries.items():
        terms = set(re.findall(r"[^\W_]+", (text or "").lower()))
        scores = {i: sum(math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * b.total() / mean)) for t in terms if t in b) for i, b in bags.items()}
        out[q] = sorted(((-round(s, 6), i) for i, s in scores.items() if s > 0))[:k]
    return out


def test_segments_ties_nulls_and_pruning(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = {i: " ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.choice([5, 20, 80, 300]))) for i in range(1500)}
    docs |= {2000 + i: "W1, w2; rare" for i in range(8)} | {3000: None, 3001: "", 3002: "Straße ÉTÉ " * 3}
    queries = {1: "w1 w2 rare", 2: "straße été", 3: "unknown", 4: None, 5: "w250 w251", 6: "w0 w1 w2 w3 w4"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    asks = spark.createDataFrame(list(queries.items()), "qid int, question string")
    index = InvertedIndex(spark, scratch(spark, "index"))
    assert index.search(asks, "qid", "question", 5).count() == 0
    for part in range(3):
        index.add(df.where(f"doc_id % 3 = {part}"), "doc_id", "text", f"part{part}", block=32)
    index.add(df, "doc_id", "text", "part1")  # a segment of that name is there: nothing is added twice
    later = InvertedIndex(spark, index.path)  # opened again
    assert later.segments() == ["part0", "part1", "part2"]

    def ranked(rows) -> dict:
        out: dict = {q: [] for q in queries}
        for r in sorted(rows, key=lambda r: (r.qid, r.rank)):
            out[r.qid].append((-r.score, r.id))
        return out

    want = plain(docs, queries, 5)
    found = ranked(later.search(asks, "qid", "question", 5).collect())
    assert {q: [i for _, i in v] for q, v in found.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(abs(a[0] - b[0]) < 2e-6 for q in want for a, b in zip(found[q], want[q], strict=True))
    asked = later.asked(asks, "qid", "question")
    scored, every = later.scored_postings(asked, 5)
    assert 0 < scored < 0.9 * every  # blocks below the bounds were not scored
    by_joins = {(r.q, r.id): r.score for r in later.joined(asked, 5).collect()}
    assert all(abs(by_joins[q, i] + s) < 2e-6 for q, v in want.items() for s, i in v)
