"""Exact searches of query sets: equal to comparing everything, without pairs of rows in the plan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textmill.functions import similarity
from textmill.operators import history, ranking
from textmill.plans import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def pairless(df) -> bool:
    return not any(x in plan(df) for x in ("NestedLoopJoin", "CartesianProduct"))


def everything(vectors, queries, k):
    """Every cosine by the expression, ranked."""
    both = vectors.crossJoin(queries).select("query_id", "vec_id", F.round(ranking.cosine(F.col("v"), F.col("query_vector")), 9).alias("score"))
    return sorted(map(str, ranking.top_k(both, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "vec_id", "score", "rank").collect()))


@pytest.mark.parametrize("k", [3, 40, 500])
def test_exact_neighbours_are_those_of_all_cosines(spark, monkeypatch, k):
    rng = random.Random(k)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x * rng.choice([1.0, 3.0]) for x in rng.choice(centers)] if rng.random() < 0.5 else [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, []), (None, [1.0] * 6), (306, [1.0] * 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<float>").repartition(3)
    queries = vectors.where("vec_id % 9 = 0 or vec_id >= 300").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector"))
    want = everything(vectors, queries, k)
    monkeypatch.setattr(ranking, "PRODUCTS", 500)
    for block in (10_000, 20):
        monkeypatch.setattr(ranking, "SMALL_QUERIES", block)
        found = ranking.knn(vectors, queries, "vec_id", "v", k)
        assert sorted(map(str, found.select("query_id", "vec_id", "score", "rank").collect())) == want


def test_recall_compares_no_pairs_of_rows(spark, sf_dir):
    assert pairless(QUERIES["e01_recall_at_k"](spark, sf_dir))


def test_exact_knn_compares_no_pairs_of_rows(spark, sf_dir):
    assert pairless(QUERIES["k01_exact_knn"](spark, sf_dir))


@pytest.mark.parametrize("k", [1, 7, 400])
def test_nearest_ids_are_those_of_all_distances(spark, monkeypatch, k):
    rng = random.Random(k)
    ids = [rng.randrange(-500, 900) for _ in range(250)] + [7, 7, 7, None]
    rows = spark.createDataFrame([(i,) for i in ids], "vec_id long").repartition(5)
    asked = [-10_000, -3, 7, 8, 500, 10_000]
    queries = spark.createDataFrame([(q,) for q in asked], "query_id long")
    monkeypatch.setattr(ranking, "PRODUCTS", 20)
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in ranking.nearest_ids(rows, queries, "vec_id", k).collect())
    assert found == sorted((q, i, x) for q in asked for i, x in enumerate(sorted((x for x in ids if x is not None), key=lambda x: (abs(x - q), x))[:k], 1))


def test_weighted_fusion_compares_no_pairs_of_rows(spark, sf_dir):
    assert pairless(QUERIES["k09_weighted_rrf"](spark, sf_dir))


def test_rerank_fusion_compares_no_pairs_of_rows(spark, sf_dir):
    assert pairless(QUERIES["k10_rerank_fusion"](spark, sf_dir))


def test_reply_matches_compare_no_pairs_of_rows(spark, sf_dir):
    assert pairless(QUERIES["f29_reply_matches"](spark, sf_dir))


@pytest.mark.parametrize("alike", [False, True])
def test_replies_are_those_of_all_pairs(spark, monkeypatch, alike):
    rng = random.Random(5)
    words = ["alpha", "alpine", "beta", "better", "gamma", "gala", "delta", "42", "Σίσυφος", "ﬁne"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pairs = [(i // 3, i % 3, say(rng.randint(1, 5)), say(rng.randint(3, 9)), i % 3 + 1, rng.choice(["", "?!", say(6)])) for i in range(150)]
    pairs += [(60 + i, 0, "alpha beta gamma", f"gala delta {say(2)}", 1, "") for i in range(8)] + [(70 + i, 0, "alpha beta gamma", "42 42 delta", 1, "") for i in range(8)] + [(None, 0, "alpha beta gamma", "better better", 1, ""), (80, 0, "zzzzzzzzzz", "q", 1, "")]
    names = ["conv_id", "turn", "said", "reply", "reply_turn", "around"]
    df = spark.createDataFrame(pairs, "conv_id long, turn long, said string, reply string, reply_turn long, around string").repartition(4)
    session = lambda a, b: 0.8 if alike else (a * b % 7) / 7
    like, want = similarity.bigram_cosine, {}
    for c, n, said, _, _, around in (p for p in pairs if p[0] is not None and (p[0] % 4 == 0 or p[0] >= 60) and sum(x.isalnum() for x in p[2]) >= 8):
        mine, found = [p[3] for p in pairs if p[0] == c], []
        for fc, fn, fsaid, reply, reply_turn, faround in pairs:
            if fc in (None, c) or like(said, fsaid) < 0.6 or (around and faround and like(around, faround) < 0.45) or max(like(reply, x) for x in mine) >= 0.96:
                continue
            found.append((round(0.6 * like(said, fsaid) + 0.2 * like(around, faround) + 0.2 * session(c, fc), 6), reply_turn, fc, fn))
        if found:
            want[c, n] = max(found)
    assert len(want) > 30 and (80, 0) not in want
    score = F.lit(0.8) if alike else F.coalesce(F.col("conv_id") * F.col("from_conv") % 7 / 7, F.lit(0.0))
    asked = df.where("conv_id % 4 = 0 or conv_id >= 60").select("conv_id", "turn", "said", "around")
    for most, rows, cells in ((10_000, 512, 1 << 23), (9, 7, 60)):
        monkeypatch.setattr(ranking, "SMALL_QUERIES", most)
        monkeypatch.setattr(history, "ROWS", rows)
        monkeypatch.setattr(history, "CELLS", cells)
        got = history.reply_matches(asked, df.select(names), 0.6, score, (0.8, 0.8) if alike else (0.0, 1.0)).where("from_conv is not null").collect()
        same = {(r.conv_id, r.turn): (r.score, r.from_conv, r.from_turn) for r in got}
        assert {k: v for k, v in same.items() if k in want and v[1] in {p[0] for p in pairs}} == {k: (s, c, n) for k, (s, _, c, n) in want.items()}


def test_flagship_builds_no_index_and_no_copies_of_texts(spark, sf_dir, monkeypatch):
    from textmill.operators import inverted, joins

    monkeypatch.setattr(inverted.InvertedIndex, "add", None)  # an index of all words took most of the time
    assert QUERIES["hybrid_retrieval"](spark, sf_dir).count() > 0
    facts = spark.createDataFrame([("of the",), ("x",)], "fact string")
    found = joins.contained_facts(spark.read.parquet(f"{sf_dir}/documents.parquet"), facts, "text", "fact", ["doc_id"])
    assert found.columns == ["doc_id", "fact"] and "Generate" not in plan(found)


@pytest.mark.parametrize("held", [1 << 19, 3])
def test_bm25_of_a_scan_is_that_of_joins(spark, monkeypatch, held):
    rng = random.Random(held)
    texts = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for i in range(400)] + [(500 + i, "a b c") for i in range(30)] + [(600, None), (601, "")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(rng.sample("abcdefghijz", 3))) for i in range(30)] + [(99, "zz"), (98, None)], "item long, said string")
    for name, value in {"HELD": held, "SLICE": 64, "CHUNK": 7}.items():
        monkeypatch.setattr(ranking, name, value)
    run = lambda: sorted(map(str, ranking.bm25(docs, queries, "id", "text", "item", "said", 12).select("item", "id", "score", "rank").collect()))
    scanned = run()
    monkeypatch.setattr(ranking, "SMALL_QUERIES", 1)
    want = run()
    assert len(scanned) > 300 and [r.split("score")[0] for r in scanned] == [r.split("score")[0] for r in want]


def test_selection_builds_no_index(spark, sf_dir, monkeypatch):
    from textmill.operators import inverted

    monkeypatch.setattr(inverted.InvertedIndex, "add", None)
    assert QUERIES["hybrid_selection"](spark, sf_dir).count() > 0
