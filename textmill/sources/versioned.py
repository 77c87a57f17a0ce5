"""A keyed Parquet table that changes by whole versions: only touched buckets are rewritten, and readers see one version or the next.

Files are written beside the live ones; a version is a small manifest that names each bucket's folder, and exists once it is
complete. Batches that were merged before are known by their number and merged once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32


class Refused(RuntimeError):
    """A change that was not made: another writer was faster, or a rebuild failed a check."""


class VersionedTable:
    """Rows of ``schema`` by ``keys``, each at its newest by ``order``; equal orders go to the row that came last.

    ``buckets`` is fixed when the table is first written. Old folders stay for readers of older versions until :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.order = spark, path.rstrip("/"), schema, keys, order
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self.manifest().get("buckets", buckets)

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def manifest(self) -> dict:
        """The newest complete version: its number, buckets, the folder of each bucket, and the last batch of each source."""
        folder = self._path("_versions")
        names = sorted((str(s.getPath().getName()) for s in self._fs.listStatus(folder)), reverse=True) if self._fs.exists(folder) else []
        for name in names:
            stream = self._fs.open(self._path(f"_versions/{name}"))
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return json.loads(text)
            except ValueError:  # its writer died half-way
                continue
        return {"version": 0, "folders": {}, "batches": {}}

    def _commit(self, before: dict, folders: dict, batches: dict) -> int:
        version = before["version"] + 1
        made = {"version": version, "buckets": self.buckets, "folders": folders, "batches": batches}
        try:
            stream = self._fs.create(self._path(f"_versions/{version:012d}.json"), False)  # fails where another writer was faster
        except Exception as e:
            raise Refused(f"version {version} of {self.path} was written by another call") from e
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        return version

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _files(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        return self._files(sorted(self.manifest()["folders"].values()))

    def _written(self, rows: DataFrame) -> tuple[str, set[int]]:
        """Rows written by bucket below a new folder, and the buckets that have any."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name, {int(str(s.getPath().getName()).split("=")[1]) for s in self._fs.listStatus(self._path(name)) if "=" in str(s.getPath().getName())}

    def _newest(self, rows: DataFrame, *ties: str) -> DataFrame:
        kept = F.max_by(F.struct(*(F.col(f"`{c}`") for c in self.schema.names)), F.struct(*(F.col(f"`{c}`") for c in [*self.order, *ties])))
        return rows.groupBy(*(F.col(f"`{k}`") for k in self.keys)).agg(kept.alias("_row")).select("_row.*")

    def merge(self, fresh: DataFrame, batch: int | None = None, source: str = "") -> int:
        """Merge rows: a key keeps the newest of its stored and fresh row, so late rows lose. -> the version afterwards.

        A ``batch`` of a ``source`` that is not newer than the last one merged changes nothing: feeding it again is safe. Null keys are
        a key; rows with a null order are the oldest. Only buckets with fresh keys are read and rewritten; an empty batch writes none.
        """
        before = self.manifest()
        if batch is not None and batch <= before["batches"].get(source, -1):
            return before["version"]
        batches = before["batches"] | ({} if batch is None else {source: batch})
        fresh = fresh.select(*(F.col(f"`{c}`") for c in self.schema.names))
        touched = [r[0] for r in fresh.select(self._bucket()).distinct().collect()]  # at most ``buckets`` rows
        if not touched:
            return self._commit(before, before["folders"], batches)
        stored = self._files([before["folders"][str(b)] for b in touched if str(b) in before["folders"]])
        both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
        name, there = self._written(self._newest(both, "_fresh"))
        return self._commit(before, before["folders"] | {str(b): f"{name}/_bucket={b}" for b in there}, batches)

    def rebuild(self, rows: DataFrame, checks: dict[str, Callable[[DataFrame], bool]] | None = None) -> int:
        """Replace all rows by a new build, if it passes every check; else nothing changes and :class:`Refused` names what failed.

        The build is written whole, then read back and checked: that it has rows, that its keys are unique and not null, and ``checks``.
        """
        before = self.manifest()
        name, there = self._written(rows.select(*(F.col(f"`{c}`") for c in self.schema.names)))
        folders = {str(b): f"{name}/_bucket={b}" for b in there}
        built = self._files(sorted(folders.values()))
        some = F.coalesce(F.max(F.greatest(*(F.col(f"`{k}`").isNull().cast("int") for k in [*self.keys, self.keys[0]]))), F.lit(0))
        counts = built.groupBy(*(F.col(f"`{k}`") for k in self.keys)).agg(F.count("*").alias("_n")).agg(F.count("*").alias("keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), some.alias("nulls")).first()
        failed = [what for what, bad in (("rows", counts.rows == 0), ("unique keys", counts.rows != counts["keys"]), ("keys that are not null", counts.nulls == 1)) if bad]
        failed += [what for what, check in (checks or {}).items() if not failed and not check(built)]
        if failed:
            self._fs.delete(self._path(name), True)
            raise Refused(f"the build was not put in place: it fails {', '.join(failed)}")
        return self._commit(before, folders, before["batches"])

    def vacuum(self) -> None:
        """Delete what the newest version does not name; older versions can then not be read any more."""
        now = self.manifest()
        live = set(now["folders"].values())
        data = self._path("data")
        for build in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = f"data/{build.getPath().getName()}"
            parts = [f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(build.getPath())]
            for part in [name] if not live & set(parts) else [p for p in parts if "_bucket=" in p and p not in live]:
                self._fs.delete(self._path(part), True)
        for old in self._fs.listStatus(self._path("_versions")):
            if str(old.getPath().getName()) != f"{now['version']:012d}.json":
                self._fs.delete(old.getPath(), False)
