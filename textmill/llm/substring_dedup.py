"""Removal of repeated word windows with a log-structured index of window fingerprints."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import discard, materialize, prepare, rows_of, scratch_path, text_bytes, tidy

WINDOW = 35
GRAM = 18  # a window's fingerprint is the least hash of its 18-word grams
SPAN = WINDOW - GRAM + 1
BATCHES = 3
PRE_GROUPED = 1 << 19  # places that a task groups at once
FANOUT = 3  # runs of one tier that are compacted into one of the next
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) that may be broadcast; beyond it the join shuffles
NO_ID = -(1 << 63)

_BYTE_FACTOR, _WORD_FACTOR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor ** i and factor ** -i modulo 2 ** 64."""
    if factor not in _POWERS or len(_POWERS[factor][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for f in (factor, pow(factor, -1, 1 << 64)):
            steps = np.full(size, f, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[factor] = (made[0], made[1])
    up, down = _POWERS[factor]
    return up[:n], down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


def _ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: int) -> np.ndarray:
    up, down = _powers(factor, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts])


def _sliding(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """f over every ``width`` neighbours."""
    done, out = 1, x
    while done * 2 <= width:
        out = f(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return f(out[:-rest], out[rest:]) if rest else out


class Words:
    """The words of some texts in one buffer, a space after each, with word and gram hashes."""

    def __init__(self, texts: list[bytes | None]) -> None:
        split = [(t or b"").split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.buffer = b" ".join([b" ".join(w) for w in split if w]) + b" "
        data = np.frombuffer(self.buffer, np.uint8)
        self.ends = np.flatnonzero(data == 32) if self.firsts[-1] else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.hashes = _ranges_hash(data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BYTE_FACTOR)

    def least(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram hashes, window fingerprints (their sliding minimum), and which windows lie in one text."""
        n = len(self.hashes)
        if n < WINDOW:
            empty = np.zeros(0, np.uint64)
            return empty, empty, np.zeros(0, bool)
        at = np.arange(n - GRAM + 1)
        grams = _ranges_hash(self.hashes, at, at + GRAM, _WORD_FACTOR)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        return grams, _sliding(np.minimum, grams, SPAN), owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]


RUN = "fp long, context long, c int, ties boolean, id long, tag long, start int, n int"
PLACES = "fp long, context long, ties boolean, id long, tag long, start int, n int"


@tidy
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tag, text) -> a row for each stretch of windows with one fingerprint: where it is, and a digest of all its words.

    ``ties`` is set where the fingerprint's gram occurs twice close by, so that windows inside the stretch may be equal.
    """
    digest = xxhash.xxh3_64_digest
    for batch in batches:
        for first, texts in rows_of(batch, 2, 1 << 20):
            words = Words(texts)
            grams, mins, whole = words.least()
            if not whole.any():
                continue
            owner = np.repeat(np.arange(len(words.counts)), words.counts)
            here = owner[: len(mins)]
            edge = np.flatnonzero(np.concatenate([[True], (mins[1:] != mins[:-1]) | (here[1:] != here[:-1]) | (whole[1:] != whole[:-1]), [True]]))
            a, b = edge[:-1], edge[1:]
            a, b = a[whole[a]], b[whole[a]]
            begin, end, buffer = words.starts[a].tolist(), words.ends[b + (WINDOW - 2)].tolist(), words.buffer
            context = np.frombuffer(b"".join([digest(buffer[i:j]) for i, j in zip(begin, end, strict=True)]), ">i8").astype(np.int64)
            shown = np.where(whole, mins, np.uint64(0))
            padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), shown, np.zeros(SPAN - 1, np.uint64)])
            chosen = np.flatnonzero((_sliding(np.maximum, padded, SPAN) == grams) & (grams > 0))
            order = chosen[np.argsort(grams[chosen], kind="stable")]
            twice = (grams[order[1:]] == grams[order[:-1]]) & (order[1:] - order[:-1] <= SPAN)
            ties = np.isin(mins[a], grams[order[1:][twice]])
            row = pa.array(first + here[a])
            yield pa.RecordBatch.from_arrays(
                [pa.array(mins[a].view(np.int64)), pa.array(context), pa.array(ties), batch.column(0).take(row), batch.column(1).take(row), pa.array((a - words.firsts[here[a]]).astype(np.int32)), pa.array((b - a).astype(np.int32))],
                [x.split()[0] for x in PLACES.split(", ")],
            )


@tidy
def _seen_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places -> one row for each different stretch among PRE_GROUPED of them, with its count (2 at most) and one owner, before any shuffle."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        prints, contexts = (rows.column(c).to_numpy() for c in ("fp", "context"))
        order = np.lexsort((contexts, prints))
        new = np.concatenate([[True], (np.diff(prints[order]) != 0) | (np.diff(contexts[order]) != 0)])
        at = np.flatnonzero(new)
        counts = np.minimum(np.diff(np.append(at, len(order))), 2).astype(np.int32)
        ties = np.logical_or.reduceat(rows.column("ties").to_numpy(zero_copy_only=False)[order], at)
        first = rows.take(pa.array(order[at])).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([first.column("fp"), first.column("context"), pa.array(counts), pa.array(ties), *(first.column(c) for c in ("id", "tag", "start", "n"))], [x.split()[0] for x in RUN.split(", ")])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= PRE_GROUPED:
            yield out(pa.Table.from_batches(held))
            held = []
    if held:
        yield out(pa.Table.from_batches(held))


@tidy
def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tag, text, stretches of fp, c, start, n) -> a digest of the words of each of their windows."""
    digest = xxhash.xxh3_64_digest
    for batch in batches:
        ids, tags, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
        for first, texts in rows_of(batch, 2, 1 << 20):
            for i, text in enumerate(texts, first):
                words, rows = Words([text]), []
                begin, end = words.starts.tolist(), words.ends.tolist()
                for s in wanted[i].as_py():
                    for at in range(s["start"], s["start"] + s["n"]):
                        rows.append((s["fp"], int.from_bytes(digest(words.buffer[begin[at] : end[at + WINDOW - 1]]), "big", signed=True), s["c"], ids[i], tags[i], at))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["fp", "digest", "c", "id", "tag", "at"])


def _kept(column: int) -> Callable:
    """The row struct and its text, less the word ranges of list column ``column`` if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for first, texts in rows_of(batch, 1):
                for i, text in enumerate(texts):
                    words = (text or b"").split()
                    gone = batch.column(column)[first + i] if column else None
                    counts.append(len(words))
                    if gone is not None and gone.is_valid:
                        edges = np.zeros(len(words) + 1, np.int64)
                        for r in gone.as_py():
                            edges[r["start"]] += 1
                            edges[r["start"] + r["n"] + WINDOW - 1] -= 1
                        stay = np.cumsum(edges[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"]
            )

    return tidy(run)


MANIFEST = "version long, kind string, place string, level int"
SETTINGS = {
    # Spark reads a bucket of one file in its written order only under this setting
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # with it, Spark 4.1 takes a union of bucketed scans for bucketed but adds up their partitions: groups come apart
    "spark.sql.unionOutputPartitioning": "false",
}


@contextlib.contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """SETTINGS for the time of a block; afterwards the session is as it was."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class FingerprintIndex:
    """A log-structured index of window fingerprints in a shared folder, which later sessions can open and extend.

    A batch becomes a run: immutable, bucketed and sorted by fingerprint, with a digest and one owner for each different stretch of
    windows, and how often it was seen (2 at most). The new run is merge-joined with the live ones, which are read in the
    order they were written in: history is neither shuffled nor sorted again. FANOUT runs of a tier are compacted
    into one of the next, so a row is rewritten once a tier.

    The manifest names what is live. It gets a new version by :meth:`commit` alone, once for all batches of a call; until then
    nothing that an older version names is deleted, so a call that fails leaves the index as it was. Index methods run under :func:`settings`.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        self.version, live = self._newest()
        self.runs = [(r.place, r.level) for r in live if r.kind == "run"]
        self.texts = [r.place for r in live if r.kind == "text"]
        self.made: list[str] = []  # by this object, not committed yet
        self.stale: list[str] = []  # compacted, to be deleted by the next commit
        self.buckets = next((r.level for r in live if r.kind == "buckets"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        for name, _ in self.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RUN.replace(' long', ' BIGINT')}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{path}/{name}'")

    def _files(self, name: str) -> tuple:
        """(file system, whether it exists, path) of something in the index's folder."""
        spark = self.spark
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return store, store.exists(path), path

    def _newest(self) -> tuple[int, list]:
        """The newest version and its rows; 0 and none before the first one."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect() if self._files("manifest")[1] else []
        version = max((r.version for r in rows), default=0)
        return version, [r for r in rows if r.version == version]

    @contextlib.contextmanager
    def writing(self) -> Iterator[None]:
        """Only one writer at a time: a second one is refused. What was not committed when the block fails is deleted."""
        store, _, path = self._files("writer")
        store.mkdirs(path.getParent())
        if not store.createNewFile(path):
            raise RuntimeError(f"another call is writing to this index; if it is no more, delete {self.path}/writer")
        try:
            if self.version != self._newest()[0]:
                raise RuntimeError("the index was changed since it was opened")
            yield
        finally:
            for name in self.made:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                store.delete(self._files(name)[2], True)
            store.delete(path, False)

    def _write(self, rows: DataFrame) -> str:
        """Rows of a run, grouped inside the task that writes their bucket: one shuffle."""
        name = f"run_{uuid.uuid4().hex}"
        self.made.append(name)
        writer = self._merged(rows.repartition(self.buckets, "fp")).write.bucketBy(self.buckets, "fp").sortBy("fp")
        writer.option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        """One row a stretch; the owner is any one place, all of whose parts come from one row."""
        owner = [F.first(c).alias(c) for c in ("id", "tag", "start", "n")]
        return rows.groupBy("fp", "context").agg(F.least(F.sum("c"), F.lit(2)).cast("int").alias("c"), F.max("ties").alias("ties"), *owner)

    def live(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(r).select(*(x.split()[0] for x in RUN.split(", "))) for r, _ in self.runs])

    def probe(self, name: str, old: str) -> DataFrame:
        """The fingerprints of a run that an older run holds as well, by a merge join of both as they lie."""
        return self.spark.table(name).hint("merge").join(self.spark.table(old), "fp", "left_semi").select("fp")

    def add(self, places: DataFrame, more: bool = True) -> DataFrame:
        """Add a batch's places as a run -> the fingerprints that it shares with itself or with history. Where ``more`` batches
        will be joined with the runs, full tiers are compacted."""
        name = self._write(places.select(*(x.split()[0] for x in PLACES.split(", "))).mapInArrow(_seen_here, RUN))
        own = self.spark.table(name).groupBy("fp").agg(F.sum("c").alias("c"), F.max("ties").alias("ties")).where("c > 1 OR ties").select("fp")
        hits = materialize(reduce(DataFrame.union, [own, *(self.probe(name, old) for old, _ in self.runs)]).distinct(), "run-hits")
        self.runs.append((name, 0))
        level = 0
        while more and len(full := [r for r in self.runs if r[1] == level]) >= FANOUT:
            rows = reduce(DataFrame.unionByName, [self.spark.table(r) for r, _ in full])
            self.runs = [r for r in self.runs if r[1] != level] + [(self._write(rows), level + 1)]
            self.stale += [r for r, _ in full]
            level += 1
        return hits

    def shared(self, places: DataFrame) -> DataFrame:
        """Those fingerprints of ``places``, all of which the index holds, that were seen more than once."""
        seen = self.live().join(places.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.sum("c").alias("c"), F.max("ties").alias("ties"))
        return materialize(seen.where("c > 1 OR ties").select("fp"), "run-hits")

    def known(self, texts: DataFrame) -> DataFrame | None:
        """(id, tag, extra): those of ``texts`` that the index holds already, by id and text, and how many more of each are given than it holds."""
        if not self.texts:
            return None
        had = few(self.kept_texts().select("id", "tag"), texts, "id", "left_semi").groupBy("id", "tag").agg(F.count("*").alias("had"))
        given = texts.groupBy("id", "tag").agg(F.count("*").alias("given"))
        return materialize(given.join(had, ["id", "tag"]).select("id", "tag", F.greatest(F.col("given") - F.col("had"), F.lit(0)).cast("int").alias("extra")), "known-texts")

    def keep_texts(self, texts: DataFrame) -> None:
        """Texts (id, tag, text) of a batch, for checking later batches against them."""
        name = f"text_{uuid.uuid4().hex}"
        self.made.append(name)
        texts.select("id", "tag", "text").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.texts.append(name)

    def kept_texts(self) -> DataFrame:
        return self.spark.read.schema("id long, tag long, text binary").parquet(*(f"{self.path}/{t}" for t in self.texts))

    def commit(self) -> None:
        """Make all that was added since the index was opened part of it, at once, and delete what was compacted."""
        self.version += 1
        rows = [(self.version, "run", r, level) for r, level in self.runs] + [(self.version, "text", t, 0) for t in self.texts] + [(self.version, "buckets", "", self.buckets)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.made = []
        self._drop(self.stale)
        self.stale = []

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            discard(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def close(self, delete: bool = False) -> None:
        """Forget the tables in this session; the folder stays unless ``delete``."""
        for name in {*(r for r, _ in self.runs), *self.stale}:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if delete:
            store, _, path = self._files("")
            store.delete(path, True)
        self.runs, self.stale, self.made = [], [], []

    def repeated(self, hits: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
        """(id, tag, start, n): the stretches of ``places`` whose windows also start elsewhere, for fingerprints ``hits``.

        A stretch whose digest was seen twice is settled at once. Only where a fingerprint also has stretches of other words are
        single windows compared, each different stretch once, on digests of the texts of their owners.
        """
        live = self.live().join(hits, "fp", "left_semi")
        groups = materialize(self._merged(live), "stretch-groups")
        loose = materialize(groups.groupBy("fp").agg(F.min("c").alias("least")).where("least = 1").select("fp"), "loose")
        owners = materialize(
            groups.join(loose, "fp", "left_semi").groupBy("id", "tag").agg(F.collect_list(F.struct("fp", "c", "start", "n")).alias("stretches")), "loose-owners"
        )
        held = few(texts, owners, "id", "left_semi").join(owners, ["id", "tag"]).select("id", "tag", "text", "stretches")
        single = materialize(held.mapInArrow(_single_windows, "fp long, digest long, c int, id long, tag long, at int"), "single-windows")
        again = materialize(single.groupBy("fp", "digest").agg(F.count("*").alias("k"), F.max("c").alias("c")).where("k > 1 OR c > 1").select("fp", "digest"), "repeated-windows")
        edges = single.where("c = 1").join(again, ["fp", "digest"], "left_semi").select("id", "tag", F.col("at").alias("start"), F.lit(1).alias("n"))
        edges = edges.join(places.select("id", "tag").distinct(), ["id", "tag"], "left_semi") if self.texts else edges
        whole = places.select("fp", "context", "id", "tag", "start", "n").join(groups.where("c > 1").select("fp", "context"), ["fp", "context"], "left_semi")
        found = materialize(whole.select("id", "tag", "start", "n").union(edges).groupBy("id", "tag").agg(F.collect_set(F.struct("start", "n")).alias("gone")), "ranges")
        for old in (groups, loose, owners, single, again):
            discard(old)
        return found


def few(rows: DataFrame, named: DataFrame, key: str, how: str) -> DataFrame:
    """A semi or anti join on a key; the other side's keys are broadcast behind a count."""
    keys = named.select(key).distinct()
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, key, how)


PLACE_KEY = ["id", "tag", "fp", "context", "start"]


def _added(rows: DataFrame, known: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows of the documents that an index does not hold, and of those it holds fewer times than given, as often as are missing."""
    if known is None:
        return rows
    new = rows.join(known.select("id", "tag"), ["id", "tag"], "left_anti")
    more = rows.join(known.where("extra > 0"), ["id", "tag"]).dropDuplicates(key).withColumn("extra", F.explode(F.array_repeat(F.lit(0), F.col("extra"))))
    return new.unionByName(more.select(rows.columns))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, index_path: str | None = None) -> DataFrame:
    """Each row's other columns as struct ``row``, with ``n_words``, ``n_removed`` and the ``kept`` words joined by a space.

    A window is WINDOW consecutive words of one text; each word covered by a window whose word sequence also starts
    anywhere else goes. Windows are found through fingerprints: the least hash of a window's 18-word grams, so that
    neighbouring windows share one and the index holds about a tenth as many entries as there are windows; equal
    windows always have equal fingerprints. Documents are added in ``batches`` to the log-structured index; what it
    reports is verified on digests of the words themselves. Stretches are counted before any join, and joins on popular ones
    read plain tables that AQE can split.

    With ``index_path`` the index lies there, with the texts it was given, and stays: a later call finds the windows of its own
    documents that also start in those of earlier calls. Documents with the id and text of one that the index holds are that one, and
    not added or counted again: a call that is repeated gives what it gave before. A call that fails leaves the index as it
    was, and one that finds another writing is refused. Without ``index_path``, the index is deleted in the end.

    Null texts have no words. Rows with null ids take part as any other; repeated rows are copies of each other. Texts of
    fewer than WINDOW words lose nothing. Columns may have any names. Empty input gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*rest).alias("row"), text_bytes(text_col).alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"))
    keyed = rows.select("id", F.xxhash64("text").alias("tag"), "text")
    places = materialize(keyed.mapInArrow(_places, PLACES).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "places", "part")
    with settings(spark):
        index = FingerprintIndex(spark, index_path or scratch_path(spark, "index"))
        try:
            with index.writing():
                known = index.known(keyed) if index_path else None
                if index_path:
                    index.keep_texts(_added(keyed, known, ["id", "tag"]))
                hits = [index.add(_added(places.where(F.col("part") == i), known, PLACE_KEY), bool(index_path) or i + 1 < batches) for i in range(batches)]
                if known is not None:
                    hits.append(index.shared(places.join(known.select("id", "tag"), ["id", "tag"], "left_semi")))
                ranges = index.repeated(reduce(DataFrame.union, hits).distinct(), places, index.kept_texts() if index_path else keyed)
                if index_path:
                    index.commit()
        finally:
            index.close(delete=not index_path)
    for old in (places, *hits):
        discard(old)
    out = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    clean = few(rows, ranges, "id", "left_anti").select("row", "text").mapInArrow(_kept(0), out)
    cut = few(rows, ranges, "id", "left_semi").withColumn("tag", F.xxhash64("text")).join(ranges, ["id", "tag"], "left")
    return clean.union(cut.select("row", "text", "gone").mapInArrow(_kept(2), out))
