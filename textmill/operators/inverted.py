"""An inverted index that outlives a call: segments of posting blocks in Parquet, searched by BM25 with block bounds.

A segment holds, for each term and block of documents, the documents with the term, how often they have it and how long they are, and
bounds on both. A block whose terms together cannot reach a query's k-th best score so far is not scored. Results are those
of scoring everything.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators import ranking
from textmill.session import scratch, written

BLOCK = 256  # documents of a block
SORTED = 4096  # documents that are put in order of their length before they are cut into blocks: alike lengths make bounds tight
SORTED_BYTES = 8 << 20
BUCKETS = 32  # folders that terms are spread over, so that few terms open few files
SEEDS = 4  # of the joined form: blocks of the highest bounds that are scored first
SMALL = 500_000  # rows (query, term) that may be broadcast
CHUNK = 512  # queries that are scored against a block at once
FIELDS = "term string, block long, n int, words long, most int, least int, ids array<long>, counts array<int>, lengths array<int>"
POSTING_BLOCKS = FIELDS + ", bucket int"
_WORD = re.compile(r"[^\W_]+")


def _cut(block: int) -> Callable:
    """(id, text) -> posting blocks; no posting leaves its task before it is in one."""

    def rows(docs: list[tuple[int, Counter]]) -> pa.RecordBatch:
        lists: dict[str, tuple[list, list]] = {}
        for at, (_, counts) in enumerate(docs):
            for term, n in counts.items():
                if term in lists:
                    lists[term][0].append(at)
                    lists[term][1].append(n)
                else:
                    lists[term] = ([at], [n])
        ids, sizes = np.array([i for i, _ in docs], np.int64), np.array([c.total() for _, c in docs], np.int32)
        n = np.array([len(p) for p, _ in lists.values()], np.int32)
        places = np.fromiter((x for p, _ in lists.values() for x in p), np.int64, n.sum())
        counts = np.fromiter((x for _, c in lists.values() for x in c), np.int32, n.sum())
        begin = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        each = lambda f, x: f.reduceat(x, begin[:-1]) if len(n) else x[:0]
        # blocks of short texts, which score highest, come first where blocks are in order
        tag = np.full(len(n), min(int(sizes[0]), (1 << 15) - 1) << 48 | xxhash.xxh3_64_intdigest(ids.tobytes()) >> 16, np.int64)
        lists_of = lambda x: pa.ListArray.from_arrays(pa.array(begin), pa.array(x))
        columns = [pa.array(list(lists), pa.string()), pa.array(tag), pa.array(n), pa.array(each(np.add, counts.astype(np.int64))), pa.array(each(np.maximum, counts)), pa.array(each(np.minimum, sizes[places])), lists_of(ids[places]), lists_of(counts), lists_of(sizes[places])]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FIELDS.split(", ")])

    def blocks(docs: list[tuple[int, Counter]]) -> Iterator[pa.RecordBatch]:
        docs.sort(key=lambda d: (d[1].total(), d[0]))
        for at in range(0, len(docs), block):
            yield rows(docs[at : at + block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((i, Counter(_WORD.findall((text or "").lower()))))
                size += len(text or "")
                if len(held) >= SORTED or size >= SORTED_BYTES:
                    yield from blocks(held)
                    held, size = [], 0
        if held:
            yield from blocks(held)

    return run


def _weight(count, length, mean, k1: float, b: float):  # noqa: ANN001, ANN202
    """What a term counts in a text by its frequency and the text's length; for numbers, arrays and columns."""
    return count * (k1 + 1) / (count + k1 * (1 - b + b * length / mean))


def _searched(shared, k: int, k1: float, b: float, measured: bool) -> Callable:  # noqa: ANN001
    """Posting blocks with ``t``, the number of their term, by block -> (q, id, score): each query's k best here, and what may tie with them.

    With ``measured``, (0, postings that were scored, postings of the queries' terms) for each block instead.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wants, idf, mean, n_queries = shared.value  # (term, query) pairs sorted by term
        first = np.searchsorted(wants[0], np.arange(len(idf) + 1))
        best = np.full((n_queries, k), -np.inf)
        count = np.zeros(2)

        def scored(rows: pd.DataFrame) -> pd.DataFrame | None:
            rows = rows.sort_values("t")
            terms = rows["t"].to_numpy()
            n = rows["n"].to_numpy()
            ids, place = np.unique(np.concatenate(rows["ids"].to_list()), return_inverse=True)
            share = _weight(np.concatenate(rows["counts"].to_list()).astype(float), np.concatenate(rows["lengths"].to_list()), mean, k1, b)
            weights = np.zeros((len(terms), len(ids)))
            weights[np.repeat(np.arange(len(terms)), n), place] = share * np.repeat(idf[terms], n)
            span = [np.arange(first[t], first[t + 1]) for t in terms]
            column, asker = np.repeat(np.arange(len(terms)), [len(s) for s in span]), wants[1][np.concatenate(span)]
            top = idf[terms] * _weight(rows["most"].to_numpy().astype(float), rows["least"].to_numpy(), mean, k1, b)
            bound = np.bincount(asker, top[column], n_queries)
            open_to = np.flatnonzero((bound > 0) & (bound >= best[:, 0] - 2e-6))
            count[:] += np.bincount(asker, n[column], n_queries)[open_to].sum(), n[column].sum()
            out = []
            for at in range(0, len(open_to), CHUNK):
                here = open_to[at : at + CHUNK]
                row = np.full(n_queries, -1)
                row[here] = np.arange(len(here))
                mine = row[asker] >= 0
                asks = np.zeros((len(here), len(terms)))
                asks[row[asker[mine]], column[mine]] = 1.0
                scores = asks @ weights
                scores[scores <= 0] = -np.inf
                low = best[here, 0]
                most = min(k, len(ids))
                both = np.concatenate([best[here], np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most :]], axis=1)
                best[here] = np.sort(np.partition(both, most, axis=1)[:, most:], axis=1)
                q, i = np.nonzero(np.isfinite(scores) & (scores >= np.maximum(low, best[here, 0])[:, None] - 2e-6))  # scores are rounded to six digits
                out.append(pd.DataFrame({"q": here[q], "id": ids[i], "score": scores[q, i]}))
            return pd.concat(out) if out else None

        held: list[pd.DataFrame] = []
        for batch in batches:
            edges = np.flatnonzero(batch["block"].to_numpy()[1:] != batch["block"].to_numpy()[:-1]) + 1
            for part in np.split(np.arange(len(batch)), edges):
                rows = batch.iloc[part]
                if held and len(rows) and held[0]["block"].iloc[0] != rows["block"].iloc[0]:
                    found = scored(pd.concat(held))
                    held = []
                    if found is not None and not measured:
                        yield found
                if len(rows):
                    held.append(rows)
        if held:
            found = scored(pd.concat(held))
            if found is not None and not measured:
                yield found
        if measured:
            yield pd.DataFrame({"q": [0], "id": [int(count[0])], "score": [float(count[1])]})

    return run


class InvertedIndex:
    """The segments below ``path``. A segment counts once Spark has committed it, so a build that fails leaves nothing that is read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        return sorted(str(s.getPath().getName()) for s in store.listStatus(folder) if store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "stats/_SUCCESS")))

    def add(self, docs: DataFrame, id_col: str, text_col: str, segment: str, block: int = BLOCK) -> None:
        """Index documents as a segment; a name that is there already is left as it is, so a repeated call adds nothing twice.

        Words are runs of letters and digits in lower case. Null texts have no words, but count as documents; rows
        with null ids are left out. Ids are integers, and no id may come twice.
        """
        if segment in self.segments():
            return
        rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        tasks = self.spark.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < tasks:  # a table in fewer files than there are cores is read by too few tasks
            rows = rows.repartition(tasks, "id")
        made = rows.mapInArrow(_cut(block), FIELDS).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        out = made.repartition("bucket").sortWithinPartitions("bucket", "term")
        out.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{segment}/blocks")
        words = self.spark.read.schema(POSTING_BLOCKS).parquet(f"{self.path}/{segment}/blocks").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        rows.select("id").agg(F.count("*").alias("docs")).join(words, F.lit(True)).write.mode("overwrite").parquet(f"{self.path}/{segment}/stats")

    def _read(self, kind: str, schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{kind}") for s in self.segments()])

    def size(self) -> tuple[int, float]:
        """Documents and their mean number of words."""
        found = self._read("stats", "docs long, words long").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        return found.docs, max(found.words / max(found.docs, 1), 1e-9)

    def asked(self, queries: DataFrame, query_col: str, text_col: str) -> DataFrame:
        """(q, term, idf, bucket): the different words of each query that any document has."""
        words = queries.select(F.col(query_col).alias("q"), F.explode(F.array_distinct(ranking.terms(text_col))).alias("term"))
        words = words.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        wanted = words.select("term", "bucket").distinct()
        wanted = F.broadcast(wanted) if wanted.limit(SMALL + 1).count() <= SMALL else wanted
        df = self._read("blocks", POSTING_BLOCKS).select("term", "bucket", "n").join(wanted, ["bucket", "term"]).groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        return words.join(df, ["bucket", "term"]).select("q", "term", "bucket", F.log(1 + (self.size()[0] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def search(self, queries: DataFrame, query_col: str, text_col: str, k: int, id_col: str = "id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query, id, score, rank): each query's k best documents by BM25, scores rounded to six digits, equal ones by id.

        The blocks of the queried terms are brought together by block, not by term, so common words are no hot keys. A task scores
        a block against all queries at once, but for those whose bound for it is below their k-th best score in this task. Queries' terms
        are broadcast behind a count; beyond it both are joined (:meth:`joined`). Queries without a word that the index
        has, and an empty index, give no row.
        """
        kind = queries.schema[query_col].dataType
        if not self.segments():
            return self.spark.createDataFrame([], f"{query_col} {kind.simpleString()}, {id_col} long, score double, rank int")
        asked = written(self.asked(queries, query_col, text_col), "asked-terms")
        if asked.count() > SMALL:
            found = self.joined(asked, k, k1, b)
        else:
            scored, names = self._scored_blocks(asked, k, k1, b, False)
            keyed = F.broadcast(self.spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("n", T.LongType()), T.StructField("name", kind)])))
            found = scored.join(keyed, F.col("q") == F.col("n")).select(F.col("name").alias("q"), "id", "score")
        found = found.select(F.col("q").alias(query_col), F.col("id").alias(id_col), F.round("score", 6).alias("score"))
        return ranking.top_k(found, [query_col], [F.desc("score"), F.col(id_col)], k)

    def scored_postings(self, asked: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> tuple[int, int]:
        """How many postings a search scores, of how many that its queries' terms have."""
        found = self._scored_blocks(asked, k, k1, b, True)[0].agg(F.sum("id").alias("scored"), F.sum("score").alias("all")).first()
        return found.scored or 0, int(found["all"] or 0)

    def _scored_blocks(self, asked: DataFrame, k: int, k1: float, b: float, measured: bool) -> tuple[DataFrame, list]:
        rows = asked.collect()  # SMALL at most
        names = sorted({r.q for r in rows}, key=lambda q: (q is not None, q))
        terms = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        place = {q: i for i, q in enumerate(names)}
        pairs = np.array(sorted((terms[r.term], place[r.q]) for r in rows), np.int64).reshape(-1, 2).T
        idf = np.zeros(len(terms))
        for r in rows:
            idf[terms[r.term]] = r.idf
        shared = self.spark.sparkContext.broadcast((pairs, idf, self.size()[1], len(names)))
        numbered = F.broadcast(self.spark.createDataFrame([(t, i, 0) for t, i in terms.items()], "term string, t int, bucket int").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")))
        opened = self._read("blocks", POSTING_BLOCKS).join(numbered, ["bucket", "term"]).select("block", "t", "n", "most", "least", "ids", "counts", "lengths")
        dealt = opened.repartition("block").sortWithinPartitions("block", "t")
        return dealt.mapInPandas(_searched(shared, k, k1, b, measured), "q long, id long, score double"), names

    def joined(self, asked: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(q, id, score) for query sets of any size: bounds by joins on the terms, the SEEDS blocks of the highest bounds scored
        first, and then those whose bound reaches the query's k-th best score there."""
        mean = self.size()[1]
        narrow = self._read("blocks", POSTING_BLOCKS).select("term", "bucket", "block", "most", "least").join(asked, ["bucket", "term"])
        bounds = written(narrow.groupBy("q", "block").agg(F.sum(F.col("idf") * _weight(F.col("most"), F.col("least"), mean, k1, b)).alias("bound")), "block-bounds")
        seeds = ranking.top_k(bounds, ["q"], [F.desc("bound"), F.col("block")], SEEDS, "_i").drop("_i")

        def scored(wanted: DataFrame) -> DataFrame:
            opened = self._read("blocks", POSTING_BLOCKS).join(wanted.select("q", "block").join(asked, "q"), ["bucket", "term", "block"])
            each = opened.select("q", "idf", F.explode(F.arrays_zip("ids", "counts", "lengths")).alias("p"))
            weight: Column = F.col("idf") * _weight(F.col("p.counts"), F.col("p.lengths"), mean, k1, b)
            return each.groupBy("q", F.col("p.ids").alias("id")).agg(F.sum(weight).alias("score"))

        first = written(scored(seeds), "seed-scores")
        kth = ranking.top_k(first, ["q"], [F.desc("score")], k, "_i").groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(0.0)).alias("least"))
        rest = bounds.join(seeds.select("q", "block"), ["q", "block"], "left_anti").join(kth, "q").where(F.col("bound") >= F.col("least") - 2e-6)
        return first.unionByName(scored(rest))


def kept_index(spark: SparkSession, name: str, source: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> InvertedIndex:
    """The index of rows made from a table, in this application's folder: built by the first call, opened by later ones.

    Its folder is named after the table's files with their sizes and times, so a table that has changed gets an index of its own.
    """
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    stamp = files.agg(F.md5(F.array_join(F.sort_array(F.collect_set(F.concat_ws("|", *files.columns))), ","))).first()[0]
    index = InvertedIndex(spark, f"{scratch(spark, 'x').rsplit('/', 1)[0]}/indexes/{name}-{stamp}")
    index.add(rows, id_col, text_col, "all")
    return index
