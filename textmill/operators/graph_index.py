"""Approximate nearest neighbours by a kept graph: shards of vectors with links to their nearest ones, searched by beam.

A task links the vectors of a shard; shards lie in Parquet, so that later calls open the graph instead of building it. A search walks
every shard from its pivots along links to ever nearer vectors and computes cosines for what it meets only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators import ranking
from textmill.session import scratch

SHARD = 65_536  # vectors that a shard holds on average
LINKS = 16  # nearest vectors that a vector is linked to, besides those that link to it
MOST_LINKS = 32  # of both kinds; the nearest stay
PIVOTS = 64  # vectors of a shard that every query is compared with first
BEAM = 64
AT_ONCE = 256  # queries that walk a shard together
MOST_QUERIES = 100_000  # that may be broadcast; larger sets are searched in so large parts
SHARDS = "dims int, shard int, n int, ids array<long>, vectors binary, links binary, pivots binary"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def link(x: np.ndarray, links: int = LINKS, most: int = MOST_LINKS) -> np.ndarray:
    """(n, most) neighbours of unit vectors, -1 where there are fewer: the nearest ones, and those that a vector is a nearest one of."""
    n, k = len(x), min(links, len(x) - 1)
    if k <= 0:
        return np.full((n, 1), -1, np.int32)
    near, like = np.empty((n, k), np.int64), np.empty((n, k), x.dtype)
    for at in range(0, n, 512):  # 128 MB of cosines at most
        scores = x[at : at + 512] @ x.T
        rows = np.arange(len(scores))
        scores[rows, at + rows] = -np.inf
        near[at : at + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        like[at : at + 512] = np.take_along_axis(scores, near[at : at + 512], 1)
    a, b, w = np.repeat(np.arange(n), k), near.ravel(), like.ravel()
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    _, once = np.unique(a * n + b, return_index=True)
    a, b, w = a[once], b[once], w[once]
    order = np.lexsort((b, -w, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, np.arange(n))[a]
    out = np.full((n, most), -1, np.int32)
    stay = place < most
    out[a[stay], place[stay]] = b[stay]
    return out


def walk(x: np.ndarray, links: np.ndarray, pivots: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, cosines) of the k best that a beam search from the pivots meets for each unit query, -1 where there are fewer; and how many cosines it took.

    All queries step at once: each expands the nearest vector of its beam that it has not expanded, until none is left.
    """
    n, beam = len(x), max(beam, k)
    rows = np.arange(len(q))
    seen = np.zeros((len(q), n + 1), bool)  # the last one stands for no vector
    seen[:, n] = True
    places, scores = np.full((len(q), beam), n), np.full((len(q), beam), -np.inf)
    done = np.ones((len(q), beam), bool)
    taken = 0

    def merge(active: np.ndarray, ids: np.ndarray, got: np.ndarray) -> None:
        all_ids, all_scores = np.concatenate([places[active], ids], 1), np.concatenate([scores[active], got], 1)
        all_done = np.concatenate([done[active], ~np.isfinite(got)], 1)
        best = np.argsort(-all_scores, axis=1, kind="stable")[:, :beam]
        places[active], scores[active], done[active] = (np.take_along_axis(y, best, 1) for y in (all_ids, all_scores, all_done))

    seen[:, pivots] = True
    taken += len(q) * len(pivots)
    merge(rows, np.broadcast_to(pivots, (len(q), len(pivots))), q @ x[pivots].T)
    while True:
        active = rows[~done.all(axis=1)]
        if not len(active):
            break
        at = np.argmax(~done[active], axis=1)  # beams are in order, so the first is the nearest
        done[active, at] = True
        around = links[places[active, at]].astype(np.int64)
        around[around < 0] = n
        new = ~seen[active[:, None], around]
        seen[active[:, None], around] = True
        taken += int(new.sum())
        got = np.where(new, np.einsum("qd,qld->ql", q[active], x[np.minimum(around, n - 1)]), -np.inf)
        merge(active, around, got)
    return np.where(np.isfinite(scores[:, :k]), places[:, :k], -1), scores[:, :k], taken


def _shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    x = np.stack(rows["v"].to_list())
    unit = _unit(x.astype(np.float64)).astype(np.float32)
    pivots = np.sort(np.random.default_rng(len(x)).permutation(len(x))[:PIVOTS]).astype(np.int32)
    return pd.DataFrame({"dims": [key[0]], "shard": [key[1]], "n": [len(x)], "ids": [rows["id"].tolist()], "vectors": [x.astype("<f8").tobytes()], "links": [link(unit).astype("<i4").tobytes()], "pivots": [pivots.astype("<i4").tobytes()]})


class GraphIndex:
    """The segments below ``path``; each counts once Spark has committed it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        return sorted(str(s.getPath().getName()) for s in store.listStatus(folder) if store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def add(self, vectors: DataFrame, id_col: str, vector_col: str, segment: str, shard: int = SHARD) -> None:
        """Link vectors as a segment; a name that is there already is left as it is.

        Null ids and vectors, vectors of length zero and those with null or non-finite entries are left out; vectors of other lengths
        get shards of their own. Shards go by a hash of the id, so no label or source makes one larger.
        """
        if segment in self.segments():
            return
        v = F.col(f"`{vector_col}`").cast("array<double>")
        good = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))) & F.exists(v, lambda c: c != 0)
        rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), good.alias("good")).where("id is not null and good").select("id", "v")
        shards = max(1, -(-rows.count() // shard))
        keyed = rows.select("id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
        keyed.groupBy("dims", "shard").applyInPandas(_shard, SHARDS).write.mode("overwrite").parquet(f"{self.path}/{segment}")

    def search(self, queries: DataFrame, k: int, id_col: str = "id", beam: int = BEAM) -> DataFrame:
        """(query_id, id, score, rank): the k nearest that each query (query_id, query_vector) meets, by exact cosine, equal ones by id.

        Queries without a usable vector, and an empty index, give no row. A wider ``beam`` computes more cosines and misses fewer neighbours.
        """
        kind = queries.schema["query_id"].dataType
        out = T.StructType([T.StructField("query_id", kind), T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())])
        found = self.spark.createDataFrame([], out)
        for part in self._parts(queries):
            found = found.unionByName(self._walked(part, k, beam, out))
        return ranking.top_k(found.withColumn("score", F.round("score", 9)), ["query_id"], [F.desc("score"), F.col(id_col)], k)

    def cosines(self, queries: DataFrame, k: int, beam: int = BEAM) -> tuple[int, int]:
        """How many cosines a search computes, of how many that comparing everything would."""
        out = T.StructType([T.StructField("taken", T.LongType()), T.StructField("all", T.LongType())])
        sums = [self._walked(p, k, beam, out).agg(F.sum("taken").alias("taken"), F.sum("all").alias("all")).first() for p in self._parts(queries)]
        return sum(s.taken or 0 for s in sums), sum(s["all"] or 0 for s in sums)

    def _parts(self, queries: DataFrame) -> list[DataFrame]:
        parts = -(-queries.count() // MOST_QUERIES) if self.segments() else 0
        return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else queries for i in range(parts)]

    def _walked(self, queries: DataFrame, k: int, beam: int, out: T.StructType) -> DataFrame:
        v = F.col("query_vector").cast("array<double>")
        good = queries.select("query_id", v.alias("v")).where(F.exists("v", lambda c: c != 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))).collect()  # MOST_QUERIES about
        asked: dict[int, tuple[list, np.ndarray]] = {}
        for dims in {len(r.v) for r in good}:
            mine = [r for r in good if len(r.v) == dims]
            asked[dims] = ([r.query_id for r in mine], _unit(np.array([r.v for r in mine])))
        shared = self.spark.sparkContext.broadcast(asked)
        names = out.names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    if r.dims not in shared.value:
                        continue
                    who, q = shared.value[r.dims]
                    x = _unit(np.frombuffer(r.vectors, "<f8").reshape(r.n, r.dims))
                    ids = np.asarray(r.ids)
                    links, pivots = np.frombuffer(r.links, "<i4").reshape(r.n, -1), np.frombuffer(r.pivots, "<i4")
                    for at in range(0, len(q), AT_ONCE):
                        places, scores, taken = walk(x, links, pivots, q[at : at + AT_ONCE], k, beam)
                        if names[0] == "taken":
                            yield pd.DataFrame({"taken": [taken], "all": [len(q[at : at + AT_ONCE]) * r.n]})
                            continue
                        row, column = np.nonzero(places >= 0)
                        yield pd.DataFrame({names[0]: pd.Series([who[at + i] for i in row.tolist()], dtype=object), names[1]: ids[places[row, column]], names[2]: scores[row, column]})

        read = [self.spark.read.schema(SHARDS).parquet(f"{self.path}/{s}") for s in self.segments()]
        rows = read[0]
        for more in read[1:]:
            rows = rows.unionByName(more)
        return rows.mapInPandas(run, out)


def kept_graph(spark: SparkSession, name: str, vectors: DataFrame, id_col: str, vector_col: str) -> GraphIndex:
    """The graph of a table in this application's folder: built by the first call, opened by later ones; a changed table gets a graph of its own."""
    files = vectors.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    stamp = files.agg(F.md5(F.array_join(F.sort_array(F.collect_set(F.concat_ws("|", *files.columns))), ","))).first()[0]
    index = GraphIndex(spark, f"{scratch(spark, 'x').rsplit('/', 1)[0]}/indexes/{name}-{stamp}")
    index.add(vectors, id_col, vector_col, "all")
    return index
