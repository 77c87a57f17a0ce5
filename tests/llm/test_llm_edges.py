"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm import chat, decontamination, embedding_dedup, language_id, license_scan, line_dedup, packing, simhash, substring_dedup, token_store
from textmill.llm.common import forest, scratch_path
from textmill.llm.components import connected_components
from textmill.llm.simhash import _links

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, id string, kept string, fp int, tag string"
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "!!! 12", "en", "a", 6), (4, LONG, "en", "a", 9), (5, f"x {PASSAGE} y", "en", "a", 9), (6, f"{PASSAGE} z", "en", "b", 9),
    (None, f"q {PASSAGE}", "en", None, 9), (7, "same words here\nsame words here", None, "b", 9), (7, "same words here\nsame words here", None, "b", 9), (8, PASSAGE, "de", "b", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "i", "k", 1, "t") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(docs, empty):
    found = sorted((r.row.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(docs).collect())
    assert [f[:3] for f in found] == [(0, 41, 40), (1, 0, 0), (2, 0, 0), (3, 2, 0), (4, 30_000, 0), (5, 42, 40), (6, 41, 40), (7, 6, 0), (7, 6, 0), (8, 40, 40)]
    assert [f[3] for f in found if f[0] in (5, 6, 8)] == ["x y", "z", ""]
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substrings_repeated_inside_one_text_and_partial_overlaps(spark):
    a = [f"a{i}" for i in range(50)]
    rows = [(1, " ".join(a + ["mid"] + a[5:45])), (2, " ".join(["z"] * 60)), (3, " ".join(a[10:46] + ["end"])), (4, " ".join(a[:34]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {d: t.split() for d, t in rows}
    seen: dict[tuple, list] = {}
    for d, w in texts.items():
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    gone = {(d, i + j) for places in seen.values() if len(places) > 1 for d, i in places for j in range(35)}
    want = {d: " ".join(x for i, x in enumerate(w) if (d, i) not in gone) for d, w in texts.items()}
    for batches in (1, 2, 5):
        assert {r.row.doc_id: r.kept for r in substring_dedup.dedup_substrings(df, batches=batches).collect()} == want


def test_licenses(docs, empty, spark):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    assert license_scan.scan(docs, path).where("license is not null").count() == 0
    assert license_scan.scan(empty, path).count() == 0
    rows = [
        ("1", "LICENSE", "Released under the MIT License."), ("2", "a/x.txt", "code here"), ("3", "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), ("4", "a/b/c/y", "code"),
        ("5", "a/b/z", "text\nReleased under the ISC License.\nmore"), ("6", None, "none"), ("7", "a/b/w", None),
    ]
    df = spark.createDataFrame([(int(i), p, t) for i, p, t in rows], "doc_id long, path string, text string")
    found = {r.id: (r.license, r.found, r.directory) for r in license_scan.scan(df, F.col("path")).collect()}
    assert found == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", ""), 3: ("Apache-2.0", "own", None), 4: ("Apache-2.0", "inherited", "a/b"), 5: ("ISC", "own", None), 6: (None, None, None), 7: ("Apache-2.0", "inherited", "a/b"),
    }


def test_leaks(docs, empty, spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, "too short"), (3, None), (None, PASSAGE), (4, " ".join(PASSAGE.split()[:30] + [f"n{i}" for i in range(5)]))], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.n_shared) for r in decontamination.contaminated(docs, items).collect())
    assert found == [(d, i, n) for d in (5, 6, 8) for i, n in ((1, 36), (4, 26))]
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in decontamination.decontaminate(docs, items).collect()) == [0, 1, 2, 3, 4, 7, 7]


def test_a_short_item_is_found_in_a_long_document(spark):
    words = LONG.split()
    items = spark.createDataFrame([(1, " ".join(words[15_000:15_030]).upper())], "item_id long, text string")
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    assert decontamination.contaminated(docs, items).first().n_shared == 26


def test_simhash(docs, empty):
    found = {r.id: r.component for r in simhash.near_duplicates(docs).collect()}
    assert found[1] == found[2] == 1 and found[None] is None and found[7] == 7 and found[4] == 4
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()).count(7) == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 12)
    prints = np.unique(np.concatenate([base, *[base ^ (np.int64(1) << np.int64(b)) ^ (np.int64(1) << np.int64(63 - b % 7)) for b in range(40)]]))
    keys, rows = [], []
    for slot in range(64):
        segment = (prints.view(np.uint64) >> np.uint64(32 * (slot // 32))) & np.uint64(0xFFFFFFFF)
        keys.append((np.uint64(slot << 32) | (segment & ~np.uint64(1 << (slot % 32)))).view(np.int64))
        rows.append(prints)
    order = np.argsort(np.concatenate(keys), kind="stable")
    a, b = _links(np.concatenate(keys)[order], np.concatenate(rows)[order])
    x, y = np.nonzero(np.bitwise_count(prints[:, None] ^ prints) <= 3)
    root = lambda u, v: {n: dict(zip(*map(list, forest(u, v)), strict=True)).get(n, n) for n in prints.tolist()}
    assert root(a, b) == root(prints[x], prints[y])


def test_languages(docs, empty, spark):
    found = {r.row.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] in ("en", "de")
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert sorted(r.doc_id or 0 for r in language_id.known_language(docs).collect()) == [0, 4, 5, 6, 7, 7, 8]


def test_token_store(docs, empty, spark):
    path = scratch_path(spark, "t")
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    rows = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8] and rows[1].ids == rows[2].ids == [0]
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert [r.doc_id for r in token_store.read_tokens(spark, path, [5]).collect()] == [5]
    token_store.write_tokens(empty, path + "e", public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert token_store.digests(token_store.read_tokens(spark, path + "e")).count() == 0


def test_lines(docs, empty, spark):
    found = {r.row.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert found[1] == found[2] == (1, 0) and found[7] == (2, 0)
    assert line_dedup.dedup_lines(empty).count() == 0
    line = "  The very same Line of text\t"
    df = spark.createDataFrame([(i, f"{line}\nown {i}\n{line.upper()}") for i in range(1, 5)] + [(9, "é" * 10 + "\n"), (10, None)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.clean_lines(df).collect()}
    assert kept[1] == "own 1" and kept[4] == f"{line}\nown 4\n{line.upper()}" and kept[9] == "é" * 10 + "\n" and kept[10] == ""


def test_chats(spark, empty):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "a"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, 1, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.summarize(chat.format_examples(df)).collect()}
    assert found == {1: (2, 0), None: (1, 1), 2: (3, 2)}
    assert chat.summarize(chat.format_examples(df.limit(0))).count() == 0


def brute_vectors(rows):
    ok = {}
    for i, v, label in rows:
        x = None if v is None or None in v else np.array(v, float)
        if i is not None and label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = (label, x / np.linalg.norm(x))
    links = {(i, j) for i in ok for j in ok if i != j and ok[i][0] == ok[j][0] and len(ok[i][1]) == len(ok[j][1]) and ok[i][1] @ ok[j][1] >= 0.98}
    root = {i: i for i, _, _ in rows if i is not None}
    for _ in root:
        for i, j in links:
            root[i] = min(root[i], root[j])
    return {i: (sum(a == i for a, _ in links), root[i]) for i in root}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * 0.08 * (i % 4)).tolist(), i % 2) for i in range(90)]
    rows += [(100, rows[0][1], 0), (101, rows[0][1], 0), (102, [2 * x for x in rows[0][1]], 0), (103, [0.0] * 8, 0), (104, None, 0), (105, [1.0] * 8, None), (106, [float("nan")] + [1.0] * 7, 0), (107, [None] + [1.0] * 7, 0), (108, [], 0), (109, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.id: (r.n_links, r.component) for r in embedding_dedup.near_duplicates(df).collect()}
    assert found == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id = 104")).first()[:] == (104, 0, 104, True)


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path, 2).collect()
    assert {(p.doc_id, p.doc_tokens) for p in pieces if p.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    assert sum(len(p.ids) // 4 for p in pieces if p.doc_id == 4) == next(p.doc_tokens for p in pieces if p.doc_id == 4) > 3 * 4096
    assert packing.pack(empty, path, 2).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (139, 99)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 1 for i in range(2, 61)} | {i: 99 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def scanned_rows(df) -> int:
    """The rows that a table's scan gave when it was counted."""
    df.collect()
    plan, rows = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName().startswith("Scan orc"):
            rows += node.metrics().get("numOutputRows").get().value()
        plan += [node.children().apply(i) for i in range(node.children().size())] + ([node.plan()] if "QueryStage" in node.nodeName() else [])
    return rows


def test_stripes_are_skipped_by_statistics_and_bloom_filters(spark):
    from pyarrow import fs, orc

    path = scratch_path(spark, "pruned")
    docs = spark.range(0, 4000, 1, 1).select((F.col("id") * 10).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 0, stride=1000)
    files = [f.path for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(path.removeprefix("file:"))) if f.path.endswith(".orc")]
    assert sum(orc.ORCFile(f).nrows for f in files) == 4000 and {orc.ORCFile(f).compression for f in files} == {"ZSTD"}
    rows = spark.read.schema(token_store.LAYOUT).orc(path)
    assert scanned_rows(rows.where("doc_id = 20000")) == 1000  # one row group by its statistics
    assert scanned_rows(rows.where("doc_id = 20005")) == 0  # inside the range of a row group, but not in its Bloom filter
    assert scanned_rows(rows.where("n_tokens >= 0")) == 4000


def test_file_offsets_over_many_blocks(spark):
    parts = [(i, 1 + i % 7) for i in range(0, 3 * token_store.FILE_BLOCK, 997)]
    found = dict(token_store.file_offsets(spark.createDataFrame(parts, "part int, n_tokens long")).collect())
    assert found == dict(zip([p for p, _ in parts], np.concatenate([[0], np.cumsum([n for _, n in parts])[:-1]]).tolist(), strict=True))


ODD = ["a.b", "my col", "a:b", "a-b", "x,y", "text.", "row", "id", "tag"]


def test_columns_of_any_name(spark):
    rows = [(i, f"words {PASSAGE}\nA line that stands in all of them\n{i}", "en", *range(len(ODD))) for i in range(4)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *(T.StructField(c, T.LongType()) for c in ODD)]))
    for found in (substring_dedup.dedup_substrings(df), line_dedup.dedup_lines(df), language_id.identify(df, language_id.fit(df))):
        assert [[r.row[c] for c in ODD] for r in found.collect()] == [list(range(len(ODD)))] * 4
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        sf = scratch_path(spark, "stage-tables")
        spark.createDataFrame([(1, f"{PASSAGE} zz")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        kept = stage(spark, df, sf)
        assert kept.columns == df.columns and kept.count() == kept.select("`a.b`").count()
    dotted = df.withColumnRenamed("doc_id", "d.id").withColumnRenamed("text", "t.x")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert decontamination.decontaminate(dotted, items, "d.id", "t.x").count() == 0 and simhash.keep_one(dotted, "d.id", "t.x").count() > 0
    assert license_scan.scan(dotted, F.lit("p"), "d.id", "t.x").count() == 4 and packing.pack(dotted, public_tokenizers.path("word_bpe_49k.json"), 2, id_col="d.id", text_col="t.x").count() == 4
    assert line_dedup.clean_lines(df).columns == df.columns == language_id.known_language(df).columns == simhash.keep_one(df).columns


def test_an_index_is_extended_by_later_batches(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 200))) for _ in range(60)]
    texts += [f"{' '.join(texts[i].split()[: 5 + i])} {PASSAGE} {' '.join(texts[i + 1].split()[-90:])}" for i in range(0, 40, 2)] + ["z " * 36, "y x " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full = {r.row.doc_id: r.kept for r in substring_dedup.dedup_substrings(df).collect()}
    path = scratch_path(spark, "kept-index")
    for i in range(5):  # five runs: the first three are compacted
        batch = df.where(F.col("doc_id") % 5 == i)
        found = {r.row.doc_id: r.kept for r in substring_dedup.dedup_substrings(batch, batches=1, index_path=path).collect()}
        sofar = {r.row.doc_id: r.kept for r in substring_dedup.dedup_substrings(df.where(F.col("doc_id") % 5 <= i)).collect()}
        assert found == {d: sofar[d] for d in found}
    assert found == {d: full[d] for d in found} and len(found) > 10
    index = substring_dedup.FingerprintIndex(spark, path)
    assert sorted(level for _, level in index.runs) == [0, 0, 1]
    with substring_dedup.settings(spark):
        probe = index.probe(index.runs[-1][0], index.runs[0][0])
        plan = probe._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    index.close()


def test_line_filters_by_segment_equal_broadcast_ones(spark):
    rng = np.random.default_rng(6)
    lines = [f"line number {i} of the pool of lines" for i in range(300)]
    df = spark.createDataFrame([(i, "\n".join([*rng.choice(lines, 6), f"own line of document {i}"]), i) for i in range(200)], "id long, text string, tag long").select("id", "tag", F.col("text").cast("binary").alias("text"))
    by_broadcast, by_segment = (sorted(line_dedup.suspected_lines(df, n).collect()) for n in (1024, 0))
    assert by_broadcast == by_segment and 500 < len(by_broadcast) < 1300


def test_large_simhash_buckets_are_cut_by_bytes():
    rng = np.random.default_rng(8)
    low = np.unique(rng.integers(0, 1 << 32, 3000))
    prints = np.unique(np.concatenate([low, *(low ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 32, (3, 2)))]))
    assert len(prints) > simhash.LARGE_GROUP
    a, b = simhash._group_links(prints, 40)
    x, y = simhash._forest_of(prints)
    root = lambda u, v: dict(zip(*map(list, forest(u, v)), strict=True))
    assert root(a, b) == root(x, y)


def test_blocks_of_one_word_texts_stay_small():
    import tracemalloc

    tracemalloc.start()
    place = packing.windows([2] * packing.BLOCK_PIECES)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.bincount(place, [2] * packing.BLOCK_PIECES).max() <= 4096 and most < 500 << 20


def test_recall_of_bounded_probes(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(700, 64))
    rows = np.concatenate([base, base[:500] + rng.normal(size=(500, 64)) * 0.12, base[:200] + rng.normal(size=(200, 64)) * 0.1])
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    unit = np.array(rows, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.arange(len(unit))[:, None] % 2 == np.arange(len(unit)) % 2)
    np.fill_diagonal(near, False)
    for size in (1000, 4, 1):  # one list, one level and two
        found = {r.id: r.n_links for r in embedding_dedup.near_duplicates(df, list_size=size).collect()}
        assert all(found[i] <= n for i, n in enumerate(near.sum(1)))
        assert sum(found.values()) >= 0.999 * near.sum() > 500


def test_labels_are_bounded_and_nothing_is_dropped_without_a_model(spark):
    texts = [(i, f"some plain words of text number {i}", f"label{i % 40}") for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert sum(map(len, language_id.fit(df, most_languages=5).families.values())) == 5
    bare = df.select("doc_id", "text", F.lit(None).cast("string").alias("lang")).unionByName(spark.createDataFrame([(900, "12 !", None), (901, None, None)], df.schema))
    assert language_id.known_language(bare).count() == 400


def test_pipeline_stages_on_edge_rows(spark, tmp_path, docs, empty):
    import corpus_pipeline

    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, rows, str(tmp_path))
            assert found.columns == docs.columns and found.count() <= rows.count()
        packed = corpus_pipeline.pack_sequences(spark, rows, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()


def test_popular_simhash_buckets_are_cut_and_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = np.int64(0x1234567812345678)
    prints = {int(base)}
    while len(prints) < 900:  # one half is nearly the same in all
        p = int(base) ^ (int(rng.integers(0, 1 << 12)) << int(rng.integers(0, 20)))
        prints.add(p ^ (1 << int(rng.integers(32, 63)) if rng.random() < 0.3 else 0))
    prints |= {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 200)}
    df = spark.createDataFrame([(p,) for p in sorted(prints)], "fp long")
    plain = connected_components(simhash.fingerprint_links(df)).collect()
    monkeypatch.setattr(simhash, "popular_buckets", lambda d, most=50, f=simhash.popular_buckets: f(d, most))
    assert simhash.popular_buckets(df).count() >= 32
    cut = connected_components(simhash.fingerprint_links(df)).collect()
    assert sorted(map(tuple, cut)) == sorted(map(tuple, plain)) and len(plain) > 700
