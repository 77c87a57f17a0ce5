"""The kept neighbour graph against exact search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textmill.operators import graph_index, ranking
from textmill.operators.graph_index import GraphIndex
from textmill.plans import QUERIES
from textmill.session import scratch


def test_walks_find_nine_of_ten_neighbours_with_few_cosines():
    rng = np.random.default_rng(2)
    x = graph_index._unit(rng.standard_normal((12_000, 12)) @ rng.standard_normal((12, 48)) + 0.2 * rng.standard_normal((12_000, 48)))
    links = graph_index.link(x.astype(np.float32))
    assert links.shape == (12_000, graph_index.MOST_LINKS) and (links[:, : graph_index.LINKS // 2] >= 0).all() and not (links == np.arange(12_000)[:, None]).any()
    q = x[::200]
    places, scores, taken = graph_index.walk(x, links, np.arange(0, 12_000, 190), q, 10, 48)
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(places, want, strict=True)]) >= 0.9
    assert taken <= 0.05 * len(q) * len(x) and np.allclose(scores, np.take_along_axis(q @ x.T, places, 1))


def test_segments_edges_and_reopening(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (None, [1.0] * 8), (703, [1.0, 0.0]), (704, [1.0] * 7 + [None]), (705, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    asks = spark.createDataFrame([("a", x[0].tolist()), ("b", x[599].tolist()), ("c", None), ("d", [0.0] * 8), ("e", [2.0, 0.0]), ("f", [1.0, 1.0, 1.0])], "query_id string, query_vector array<double>")
    index = GraphIndex(spark, scratch(spark, "graph"))
    assert index.search(asks, 3).count() == 0
    index.add(df.where("coalesce(vec_id, 0) % 2 = 0"), "vec_id", "v", "even", shard=100)
    index.add(df.where("vec_id % 2 = 1"), "vec_id", "v", "odd", shard=100)
    index.add(df, "vec_id", "v", "odd")
    later = GraphIndex(spark, index.path)
    assert later.segments() == ["even", "odd"]
    exact = ranking.knn(df.where("vec_id < 600 or vec_id = 705"), asks.where("query_id in ('a', 'b')"), "vec_id", "v", 5).collect()
    found = later.search(asks, 5, "vec_id", beam=200).collect()
    by = lambda rows: {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in rows}
    assert {k: v for k, v in by(found).items() if k[0] in "ab"} == by(exact)
    assert [(r.query_id, r.vec_id, r.score) for r in found if r.query_id not in "ab"] == [("e", 703, 1.0)]
    taken, every = later.cosines(asks, 5, beam=8)
    assert 0 < taken < every


def test_query_recall(spark, sf_dir):
    found, exact = (QUERIES[n](spark, sf_dir) for n in ("k02_approximate_knn", "k01_exact_knn"))
    hits = found.join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    assert hits >= 0.9 * exact.count() and found.count() == exact.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
    assert found.groupBy("query_id").agg(F.max("rank").alias("n")).where("n <> 10").count() == 0
