"""Whitening and code compression against plain numpy, with rows that must not count."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textmill.llm import code_compression, whitening
from textmill.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def kept(sf_dir: str) -> pd.DataFrame:
    frame = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    return frame[[v is not None and len(v) > 0 and bool(np.isfinite(np.array(v, float)).all()) for v in frame.embedding]]


def plain_whitening(vectors: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Deviations, whitened values and eigenvalues by the full covariance matrix."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    centred = np.array(d, np.float64) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return np.array([sum(c * c for c in r) for r in d]), centred @ u / np.sqrt(e), e, np.trace(v)


def test_whitening_equals_the_full_covariance(spark, sf_dir):
    frame = kept(sf_dir).sort_values("vec_id")
    deviation, wanted, e, trace = plain_whitening(list(frame.embedding), 32)
    found = QUERIES["op11_embedding_whitening"](spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert len(found) == 32 * len(frame) and set(found.n) == {len(frame)} and found.identity_error.iloc[0] <= 1e-9
    assert found.deviation.to_numpy()[::32].tolist() == deviation.tolist()
    got = found.whitened.to_numpy().reshape(-1, 32)
    got = got * np.sign((got * wanted).sum(0))  # either sign
    assert np.abs(got - wanted).max() < 1e-7
    assert np.allclose(found.explained.to_numpy().reshape(-1, 32)[0], e / trace, rtol=1e-10)


def test_block_iteration_narrower_than_the_space(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24)) * np.geomspace(20, 0.5, 24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(df, components=4)
    _, _, e, trace = plain_whitening(x.tolist(), 4)
    assert model.passes > 2 and model.components.shape == (24, 4)
    assert np.allclose(model.eigenvalues, e, rtol=1e-12) and np.isclose(model.trace, trace)
    assert (model.residuals <= 1e-13 * e[0]).all() and whitening.identity_error(df, model) < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>, `a.b` string, row int, whitened int, v int, deviation int"
    rows = [(1, [1.0, 2.0]), (None, [2.0, -1.0]), (2, None), (3, [1.0, None]), (4, [NAN, 1.0]), (5, [1.0, -INF]), (6, [1.0]), (7, []), (1, [1.0, 2.0]), (8, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], schema)
    model = whitening.fit_whitening(df)
    out = whitening.whiten(df, model)
    assert sorted((r.row.vec_id or 0) for r in out.collect()) == [0, 1, 1, 8] and model.n == 4 and model.components.shape == (2, 2)
    deviation, _, _, _ = plain_whitening([rows[0][1], rows[1][1], rows[0][1], rows[9][1]], 2)
    assert sorted(int(r.deviation) for r in out.collect()) == sorted(deviation.tolist())
    assert out.schema["row"].dataType.fieldNames() == ["vec_id", "a.b", "row", "whitened", "v", "deviation"]
    empty = df.limit(0)
    assert whitening.whiten(empty, whitening.fit_whitening(empty)).count() == 0
    same = df.where("vec_id = 1")
    none = whitening.fit_whitening(same)
    assert none.n == 2 and len(none.eigenvalues) == 0 and whitening.whiten(same, none).count() == 0 and whitening.identity_error(same, none) == 0
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge, whitening.fit_whitening(huge)).count() == 3
    flat = spark.createDataFrame([(i, [float(i % 7), float(i % 7), 3.0]) for i in range(50)], "vec_id long, embedding array<double>")
    assert len(whitening.fit_whitening(flat).eigenvalues) == 1  # of rank one


def plain_codes(ids: list, vectors: list) -> tuple[dict, np.ndarray]:
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors], object)
    width = x.shape[1] // 16
    first = [i for _, i in sorted((a, i) for i, a in enumerate(ids))][:64]
    books = [[list(x[i, p * width : (p + 1) * width]) for i in first] for p in range(16)]

    def chosen() -> list[list[tuple[int, int]]]:
        return [[min((sum((a - b) ** 2 for a, b in zip(r[p * width : (p + 1) * width], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(16)] for r in x]

    for _ in range(2):
        now = chosen()
        for p in range(16):
            for j in range(len(books[p])):
                if own := [r[p * width : (p + 1) * width] for r, c in zip(x, now, strict=True) if c[p][1] == j]:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return {a: ("".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c)) for a, c in zip(ids, chosen(), strict=True)}, books


def test_codes_equal_plain_python(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((90, 48)), 2)
    x[60:] = x[:30]  # copies: equal distances, ties
    df = spark.createDataFrame([(1000 - i, i % 3 or None, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    books = code_compression.fit_codebooks(df)
    found = {r.row.vec_id: (r.code.hex(), r.error) for r in code_compression.encode(df, books).collect()}
    wanted, plain = plain_codes([1000 - i for i in range(90)], x.tolist())
    assert found == wanted
    assert books.entries.tolist() == plain and books.sha256 == hashlib.sha256(",".join(str(c) for p in plain for e in p for c in e).encode()).hexdigest()


@pytest.mark.parametrize("width", [1, 2, 4, 9])
def test_partial_distance_search_equals_all_distances(width):
    rng = np.random.default_rng(width)
    x, book = rng.integers(-9, 9, (3000, width)), rng.integers(-9, 9, (64, width))
    d = ((x[:, None] - book) ** 2).sum(2)
    entry, least = code_compression.nearest(x, book)
    assert (entry == d.argmin(1)).all() and (least == d.min(1)).all()
    same = code_compression.nearest(x, np.repeat(book[:1], 64, 0))
    assert (same[0] == 0).all()


def test_code_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, `a.b` string, code int, error string, id int"
    rows = [(5, [1.0, 2.0, 3.0], 1), (None, [0.0, 0.0, 0.0], None), (2, None, 1), (3, [1.0, None, 2.0], 1), (4, [NAN, 1.0, 1.0], 1), (6, [1.0], 1), (5, [1.0, 2.0, 3.0], 1), (7, [1e30, 0.0, 0.0], None), (8, [], 1)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], schema)
    books = code_compression.fit_codebooks(df)
    assert books.entries.shape == (16, 4, 1)
    coded = code_compression.label_errors(code_compression.encode(df, books))
    got = sorted((r.row.vec_id or 0, r.error, r.label_error) for r in coded.collect())
    assert got == [(0, 0, 0), (5, 0, 0), (5, 0, 0), (7, 0, 0)]
    assert coded.schema["row"].dataType.fieldNames() == ["vec_id", "label", "a.b", "code", "error", "id"]
    back = {r.row.vec_id: r.approximation for r in code_compression.decode(code_compression.encode(df, books), books).collect()}
    assert back[5] == [1.0, 2.0, 3.0]
    empty = df.limit(0)
    assert code_compression.label_errors(code_compression.encode(empty, code_compression.fit_codebooks(empty))).count() == 0
    with pytest.raises(ValueError):
        code_compression.fit_codebooks(df, entries=300)


def test_a_popular_label_is_summed_before_the_shuffle(spark):
    codes = spark.range(1000).select(F.struct(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("label")).alias("row"), F.col("id").alias("error"))
    out = code_compression.label_errors(codes).groupBy("row.label").agg(F.min("label_error").alias("a"), F.max("label_error").alias("b")).collect()
    wanted = {None: sum(i for i in range(1000) if i % 3 == 0)} | {k: sum(i for i in range(1000) if i % 3 and i % 2 == k) for k in (0, 1)}
    assert {r.label: r.a for r in out} == wanted == {r.label: r.b for r in out}
