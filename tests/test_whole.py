"""Queries on whole tables and whole texts, on tables whose ids lie beyond any first ones."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from textmill.functions import text
from textmill.operators import dedup
from textmill.plans import ORACLE_SQL, QUERIES

@pytest.fixture(scope="module")
def late_ids(sf_dir, tmp_path_factory) -> str:
    """Tables whose ids lie beyond any subset of first ids."""
    folder = tmp_path_factory.mktemp("late")
    for name, key in {"events": "event_id", "documents": "doc_id", "customer": "c_custkey", "supplier": "s_suppkey"}.items():
        duckdb.sql(f"COPY (SELECT * REPLACE ({key} + 1000000 AS {key}) FROM '{sf_dir}/{name}.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["p05_json_key_removal", "p06_json_merge", "f49_json_ids", "f50_canonical_json", "w03_ordinality", "j22_full_outer_allow_list"])
def test_no_subset_of_ids(spark, late_ids, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], late_ids)


def test_terms_after_the_first_words_count(spark, tmp_path):
    body = "alpha " + "x y " * 13
    docs = [(i, body, "en", "s") for i in range(11)] + [(11, body + "the of la " + " ".join(f"w{i}" for i in range(40)), "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert "11" in {r.id for r in QUERIES["k11_quota_selection"](spark, str(tmp_path)).collect()}
    assert min((r.position, r.id) for r in QUERIES["k12_prefix_reorder"](spark, str(tmp_path)).collect())[1] == "11"


def prefixes(turn: str) -> list[str]:
    return [re.split(r"[,.!?;:\n]", turn[: m.start()])[-1][-32:] for m in re.finditer(r"(?<![^\W_])(?:of|de|und)(?![^\W_])", turn)]


def test_each_cue_is_negated_by_the_words_before_it(spark, sf_dir):
    turns = ["x " * 40 + "the bank of it", "the of the", "the, of", "la der of", "a" * 31 + " of", "the " + "b" * 28 + " of", "the " + "b" * 30 + " of", "of de und", ""]
    df = spark.createDataFrame([(t,) for t in turns], "t string").select("t", text.cue_prefixes(F.col("t"), r"(?<![\p{L}\p{N}])(?:of|de|und)(?![\p{L}\p{N}])", r",.!?;:\n", 32).alias("p"))
    assert {r.t: r.p for r in df.collect()} == {t: prefixes(t) for t in turns}
    negated = lambda t: any(len(re.findall(r"(?<![^\W_])(?:la|the|der)(?![^\W_])", p)) % 2 for p in prefixes(t.lower()))
    wanted = sorted((c, n, negated(t)) for c, n, t in duckdb.sql(f"SELECT conv_id, turn, text FROM '{sf_dir}/conversations.parquet'").fetchall())
    assert sorted(map(tuple, QUERIES["f33_negation_parity"](spark, sf_dir).collect())) == wanted
    assert {x[2] for x in wanted} == {True, False}


def test_distinct_turns_after_many_copies_are_taken(spark):
    turns = ["Same  text"] * 150 + ["same text", "SAME text"] * 100 + ["b b b b b b b b b b", "b b b b b b b b b b b", "c", "d", "e"]
    rows = [(k, i, t) for k in (1, 2) for i, t in enumerate(turns)] + [(3, 0, None), (3, 1, ""), (3, 2, "x"), (None, 5, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    found = sorted((r.conv_id or 0, r.turn) for r in dedup.diversify(df, ["conv_id"], "turn", "text", limit=4).collect())
    assert found == [(0, 5)] + [(k, i) for k in (1, 2) for i in (0, 350, 352, 353)] + [(3, 0), (3, 2)]


def test_all_matching_and_all_ranked_rows(spark, sf_dir, tmp_path):
    duckdb.sql(f"COPY (SELECT * REPLACE (o_orderkey + 1000000 * i AS o_orderkey) FROM '{sf_dir}/orders.parquet', range(8) r(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (SELECT * REPLACE (l_suppkey + 1000 * i AS l_suppkey) FROM '{sf_dir}/lineitem.parquet', range(8) r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for name in ("p17_catalog_filter", "k17_parent_ranking"):
        compare(spark, QUERIES[name], ORACLE_SQL[name], str(tmp_path))
    assert QUERIES["p17_catalog_filter"](spark, str(tmp_path)).count() > 100
    ranked = QUERIES["k17_parent_ranking"](spark, str(tmp_path)).collect()
    assert len(ranked) > 50 and ranked == sorted(ranked, key=lambda r: (r.best, -r.n, r.l_suppkey))


def test_last_lines_with_numbers_are_no_dates(spark, tmp_path):
    endings = ["", None, "+1 (235) 555-2058 un.", "4512160218721939", "a\nwh 2019 thes.  ", "In March 2019", "March 20190", "\n \n"]
    docs = [(4 * i + k, None if t is None else f"Words of a text.\n{t}", f"src{k}") for i, t in enumerate(endings) for k in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    compare(spark, QUERIES["f05_footers"], ORACLE_SQL["f05_footers"], str(tmp_path))
