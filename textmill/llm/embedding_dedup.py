"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import discard, forest, materialize, prepare, tidy
from textmill.llm.components import connected_components

COSINE = 0.98
SAMPLE = 8192  # the quantisers are fitted on about so many vectors
LIST_SIZE = 256  # a label gets the fewest levels of lists that leave no more vectors than this in one on average
BRANCH = 64  # lists that each level splits a list into
SUBSPACES, CODES = 8, 32
REACH = 4.0  # probes go so many standard deviations of a random direction's share in one dimension far
BLOCK = 1024  # members and visitors of a list that one task compares at once
PAIRS = 1 << 16
BROADCAST_LISTS = 200_000  # rows (label, list, sizes) that may be broadcast


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centers = x[np.random.default_rng(11).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = np.argmin(_squares(x, centers), axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


@dataclass
class Quantizer:
    """Centers for each level of lists, each level splitting what the one above leaves, and for each subspace of the rest."""

    levels: list[np.ndarray]
    gaps: list[np.ndarray]
    books: list[np.ndarray]
    reach: float

    def split(self, residual: np.ndarray) -> list[np.ndarray]:
        return np.array_split(residual, len(self.books), axis=1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes, and how far each vector is from what its codes stand for."""
        codes, error = np.empty((len(residual), len(self.books)), np.uint8), np.zeros(len(residual))
        for j, (part, book) in enumerate(zip(self.split(residual), self.books, strict=True)):
            near = np.argmin(_squares(part, book), axis=1)
            codes[:, j] = near
            error += ((part - book[near]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def _step(self, level: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest center of a level to each vector, and flags of the centers whose lists are probed.

        A neighbour y in list j is nearer to center j than to any other, so x is at most |x - y| on the far side of the plane
        between its own center i and j: (|x-cj|^2 - |x-ci|^2) / (2 |ci-cj|) <= |x - y|, and equal to the share of x - y along
        ci - cj where y lies on the plane. ``reach`` bounds that share.
        """
        squares = _squares(rest, self.levels[level])
        own = np.argmin(squares, axis=1)
        probe = squares - squares[np.arange(len(rest)), own][:, None] <= 2 * self.reach * self.gaps[level][own] + 1e-9
        probe[np.arange(len(rest)), own] = True
        return own, probe

    def lists(self, x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's own list, what that list's centers leave of it, and all probed lists as (row, list)."""
        row, cell, rest, mine = np.arange(len(x)), np.zeros(len(x), np.int64), x, np.ones(len(x), bool)
        for level in range(depth):
            own, probe = self._step(level, rest)
            at, code = np.nonzero(probe)
            mine = mine[at] & (own[at] == code)
            row, cell, rest = row[at], cell[at] * BRANCH + code, rest[at] - self.levels[level][code]
        return cell[mine], rest[mine], row, cell

    def center(self, cell: int, depth: int) -> np.ndarray:
        digits = [(cell // BRANCH ** (depth - 1 - i)) % BRANCH for i in range(depth)]
        return sum((self.levels[i][d] for i, d in enumerate(digits)), np.zeros(sum(b.shape[1] for b in self.books)))

    def visits(self, x: np.ndarray, cells: np.ndarray, depth: int) -> np.ndarray:
        """Whether each vector probes the list beside it."""
        ok, rest = np.ones(len(x), bool), x
        for level in range(depth):
            code = (cells // BRANCH ** (depth - 1 - level)) % BRANCH
            ok &= self._step(level, rest)[1][np.arange(len(x)), code]
            rest = rest - self.levels[level][code]
        return ok


def fit(sample: np.ndarray, depth: int, cosine: float, reach: float = REACH) -> Quantizer:
    """Centers of ``depth`` levels and subspace centers of what they leave, all from the bounded sample."""
    levels, rest = [], sample
    for _ in range(depth):
        centers = _kmeans(rest, min(BRANCH, len(rest)))
        levels.append(centers)
        rest = rest - centers[np.argmin(_squares(rest, centers), axis=1)]
    parts = np.array_split(rest, min(SUBSPACES, sample.shape[1]), axis=1)
    share = min(1.0, reach / np.sqrt(sample.shape[1]))
    return Quantizer(levels, [np.sqrt(_squares(c, c)) for c in levels], [_kmeans(np.ascontiguousarray(p), min(CODES, len(p))) for p in parts], share * radius_of(cosine))


def levels_for(rows: int, list_size: int) -> int:
    """The fewest levels whose lists hold ``list_size`` of the rows or fewer on average."""
    depth = 0
    while rows > list_size * BRANCH**depth:
        depth += 1
    return depth


def radius_of(cosine: float) -> float:
    """The distance of unit vectors at this cosine, a little more for rounding."""
    return float(np.sqrt(2 - 2 * cosine)) + 1e-6


def _matrix(values: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), -1).astype(np.float64) if len(values) else np.zeros((0, 1))


def _unit(kind: str) -> Callable:
    """(id, label, embedding) -> (id, label, dims, raw bytes, null where a vector links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = [], []
            for label, v in zip(batch.column(1), batch.column(2), strict=True):
                data = None
                if label.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0  # -0.0 and 0.0 are one value
                    if np.isfinite(x).all() and x.any():
                        data = x.tobytes()
                raw.append(data)
                dims.append(None if data is None else len(data) // np.dtype(kind).itemsize)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dims", "raw"])

    return tidy(run)


def _normal(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


DEALT = "rep long, label string, depth int, copies long, cell long, own long, raw binary, code binary, error double"


def _deal(shared, kind: str) -> Callable:  # noqa: ANN001
    """(rep, label, depth, copies, raw) -> a row for each probed list; in the own one (cell = own) the vector is a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantizer = shared.value
        for batch in batches:
            depths = batch.column(2).to_numpy()
            for depth in np.unique(depths).tolist():
                mine = np.flatnonzero(depths == depth)
                for at in range(0, len(mine), 256):
                    part = batch.take(pa.array(mine[at : at + 256]))
                    x = _normal(_matrix(part.column(4), kind))
                    own, rest, row, cell = q.lists(x, depth)
                    codes, error = q.encode(rest)
                    pick = pa.array(row)
                    code = pa.array([c.tobytes() for c in codes], pa.binary()).take(pick)
                    columns = [*(part.column(i).take(pick) for i in range(4)), pa.array(cell), pa.array(own[row]), part.column(4).take(pick), code, pa.array(error[row])]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DEALT.split(", ")])

    return tidy(run)


def _search(shared, cosine: float, kind: str) -> Callable:  # noqa: ANN001
    """A block of a list's members against a block of its visitors -> links counted per vector, and edges that keep their components."""
    radius = radius_of(cosine)

    def run(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantizer = shared.value
        rows = pa.Table.from_batches(list(groups)).combine_chunks()
        cell, depth = key[1].as_py(), key[2].as_py()
        seat = rows.column("role").to_numpy()
        member, visitor = rows.filter(pa.array(seat == 0)), rows.filter(pa.array(seat == 1))
        if not len(member) or not len(visitor):
            return
        ids, weight = member.column("rep").to_numpy(), member.column("copies").to_numpy()
        exact = _normal(_matrix(member.column("raw").combine_chunks(), kind))
        codes = np.frombuffer(b"".join(member.column("code").to_pylist()), np.uint8).reshape(len(member), -1)
        error = member.column("error").to_numpy()
        who, own, copies = (visitor.column(c).to_numpy() for c in ("rep", "own", "copies"))
        x = _normal(_matrix(visitor.column("raw").combine_chunks(), kind))
        squares = np.zeros((len(x), len(codes)))
        for j, (piece, book) in enumerate(zip(q.split(x - q.center(cell, depth)), q.books, strict=True)):
            squares += _squares(piece, book)[:, codes[:, j]]
        # |x - y| >= |x - code(y)| - |y - code(y)|: what is pruned here cannot be a link
        a, b = np.nonzero((np.sqrt(squares) - error <= radius + 1e-7) & (who[:, None] != ids))
        linked = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + PAIRS]], exact[b[i : i + PAIRS]]) >= cosine for i in range(0, len(a), PAIRS)] or [np.zeros(0, bool)])
        a, b = a[linked], b[linked]
        if not len(a):
            return
        seen, links = [who[a]], [weight[b]]
        # a member that does not probe its visitor's own list meets that visitor only here
        far = np.flatnonzero(own[a] != cell)
        for i in range(0, len(far), PAIRS):
            some = far[i : i + PAIRS]
            missed = some[~q.visits(exact[b[some]], own[a[some]], depth)]
            seen.append(ids[b[missed]])
            links.append(copies[a[missed]])
        node, place = np.unique(np.concatenate(seen), return_inverse=True)
        count = np.bincount(place, np.concatenate(links)).astype(np.int64)
        child, root = forest(who[a], ids[b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([node, child])), pa.array(np.concatenate([count, root])), pa.array(np.concatenate([np.zeros(len(node), bool), np.ones(len(child), bool)]))],
            ["a", "b", "edge"],
        )

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, list_size: int = LIST_SIZE, reach: float = REACH
) -> DataFrame:
    """(id, n_links, component, kept) for each row; only vectors with one label and one length are compared.

    Equal vectors collapse to one representative with a count before the search; they link with each other. Quantisers are
    fitted on about SAMPLE vectors, all vectors are indexed. A label's vectors lie in inverted lists of one or more levels of
    BRANCH, as many as its rows need, so lists stay short at every size. Each vector visits all lists in which
    geometry allows a neighbour whose difference from it has at most ``reach`` standard deviations (of a random direction) along the
    line between two centers: with ``reach`` = sqrt(dimensions) or more, so always up to 16 dimensions, no link can be missed;
    beyond, one in some ten thousand may be if differences are spread evenly, and both vectors of a pair would have to miss the other.
    Table-lookup distances less each code's own error prune only what cannot be a link, and the cosine of what is left is taken
    in double precision. Long lists are dealt in blocks of members and of visitors that meet one by one, so no task holds
    a list. A block gives counts and a spanning forest.

    Vectors that are null, empty, zero, or hold null or non-finite components, or have a null label, link with nothing: they are
    their own component. Rows with a null id link nothing and have a null component. Repeated ids are one vector each
    time; components join them. Empty input gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    kind, arrays = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast(arrays).alias("embedding"))
    units = materialize(rows.mapInArrow(_unit(kind), "id long, label string, dims int, raw binary"), "vectors")
    usable = units.where("id is not null and raw is not null")
    classes = materialize(usable.groupBy("label", "raw").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("dims").alias("dims")), "vector-classes")
    labels = materialize(classes.groupBy("dims", "label").agg(F.count("*").alias("n")), "label-sizes")
    found = None
    for size in sorted(labels.groupBy("dims").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()):
        mine, depth = classes.where(F.col("dims") == size.dims), levels_for(size.most, list_size)
        share = int(min(1.0, SAMPLE / size.n) * (1 << 30))
        sample = mine.where(F.pmod(F.xxhash64("raw"), F.lit(1 << 30)) < share).select("raw").toPandas()["raw"]
        if not len(sample):
            sample = mine.select("raw").limit(1).toPandas()["raw"]
        quantizer = fit(_normal(np.frombuffer(b"".join(sorted(sample)), kind).reshape(len(sample), size.dims).astype(np.float64)), depth, cosine, reach)
        shared = spark.sparkContext.broadcast(quantizer)
        levels = sum((F.when(F.col("n") > list_size * BRANCH**i, 1).otherwise(0) for i in range(depth)), F.lit(0)).cast("int")
        leveled = mine.join(labels.where(F.col("dims") == size.dims).select("label", levels.alias("depth")), "label")
        dealt = materialize(leveled.select("rep", "label", "depth", "copies", "raw").mapInArrow(_deal(shared, kind), DEALT), "inverted-lists")
        where = ["label", "cell", "depth"]
        blocks = dealt.groupBy(*where).agg(*(F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int").alias(c) for c, n in (("m", F.count_if(F.expr("cell = own"))), ("v", F.count("*")))))
        blocks = materialize(blocks, "list-blocks")
        # where the lists' sizes are joined by a shuffle, blocks of one list still go to different tasks
        small = blocks.count() <= BROADCAST_LISTS
        placed = dealt.join(F.broadcast(blocks) if small else blocks, where).withColumn("m_at", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")).withColumn("v_at", F.pmod(F.xxhash64("rep"), F.col("v")).cast("int"))
        members = placed.where("cell = own").withColumn("v_at", F.explode(F.sequence(F.lit(0), F.col("v") - 1))).withColumn("role", F.lit(0))
        visitors = placed.withColumn("m_at", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("role", F.lit(1))
        group = [*where, "m_at", "v_at"]
        fields = [*group, "role", "rep", "copies", "own", "raw", "code", "error"]
        both = members.select(fields).unionByName(visitors.select(fields))
        pairs = (both if small else both.repartition(*group)).groupBy(*group).applyInArrow(_search(shared, cosine, kind), "a long, b long, edge boolean")
        pairs = materialize(pairs, "vector-links")
        discard(dealt)
        found = pairs if found is None else found.union(pairs)
    alone = units.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.col("id").isNotNull().alias("kept"))
    if found is None:
        return alone
    counts = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = connected_components(found.where("edge").select("a", "b"))
    groups = materialize(
        classes.select("label", "raw", "rep", "copies").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "raw", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("links"), F.coalesce("root", "rep").alias("group")),
        "vector-groups",
    )
    joined = units.join(groups, ["label", "raw"], "left")
    linked = F.col("id").isNotNull() & F.col("group").isNotNull()
    return joined.select(
        "id", F.when(linked, F.col("links")).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.col("group")).otherwise(F.col("id")).alias("component")
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
