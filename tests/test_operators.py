"""Literal fixtures for operators, functions, sources and streams."""

from __future__ import annotations

import hashlib
import re
import json
import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill.functions import similarity, text
from textmill.operators import dedup, evaluation, joins, predicates, ranking, rollups, sequences
from textmill.plans.hybrid import flagship
from textmill.sources import files
from textmill.streaming import live, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_nearest_rank_percentiles(spark):
    import math
    import random

    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    assert rollups.percentiles(df.withColumn("k", F.lit(None).cast("int")), ["k"], "v", {"a": 0.5, "b": 0.95}).first()[:] == (None, 2.0, 4.0)
    rng = random.Random(1)
    values = {1: [rng.gauss(0, 5) for _ in range(3000)], 2: [float(rng.choice([0, 0, 0, 0, 7, 8])) for _ in range(2500)], 3: [1.5], 4: [None, None], 5: [rng.random() ** 9 * 1e9 for _ in range(1000)] + [None] * 50}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k int, v double")
    fractions = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = {r.k: r for r in rollups.percentiles(rows, ["k"], "v", fractions, settled=20).collect()}  # several passes
    for k, vs in values.items():
        kept = sorted(v for v in vs if v is not None)
        assert [found[k][n] for n in fractions] == [kept[max(1, math.ceil(round(len(kept) * f, 9))) - 1] if kept else None for f in fractions.values()], k
    assert rollups.percentiles(rows.limit(0), ["k"], "v", fractions).count() == 0


def test_facts_that_begin_alike_are_joined_on_other_words(spark):
    from textmill.operators import joins

    facts = spark.range(100_000).select(F.concat(F.lit("The name of "), F.col("id"), F.lit(" is x"), F.col("id")).alias("fact")).unionByName(spark.createDataFrame([("the",), ("!",), (None,)], "fact string"))
    queries = spark.createDataFrame([(1, "so the name of 77 is x77, they said"), (2, "the name of 5"), (3, None), (4, "name of 12 is x12")], "q int, text string")
    keys = joins.rarest_words(facts, "fact")
    assert keys.groupBy("_first").count().agg(F.max("count")).first()[0] <= 1
    assert sorted((r.q, r.fact) for r in joins.contained_facts(queries, facts, "text", "fact").collect()) == [(1, "The name of 77 is x77"), (1, "the"), (2, "the")]


def test_updates_by_revision_and_owner(spark):
    from textmill.operators import sequences

    rows = [(1, 0, 0, "a", False), (1, 1, 0, "a", False), (1, 2, 1, "b", False), (1, 3, 1, "a", True), (1, 4, 2, "b", False), (1, 5, None, "b", False), (2, 0, 1, "a", False)]
    df = spark.createDataFrame(rows, "k int, at int, want int, who string, free boolean")
    assert {r.k: r[1:] for r in sequences.compare_and_set(df, ["k"], ["at"], "want", "who", "free").collect()} == {1: (3, "b", 2, 1), 2: (0, None, 1, 0)}


def test_resizing_sorts_no_table(spark):
    from textmill.operators import selection

    df = spark.createDataFrame([(i // 2 * 3, f"t{i}") for i in range(40)], "id long, t string")
    out = selection.cycle(df, "id", 1.4)
    assert out.count() == 56 and out.where("copy = 1").agg(F.max("id")).first()[0] == 21
    assert "TakeOrdered" not in out._jdf.queryExecution().executedPlan().toString()


def test_spearman_of_equal_and_reversed_ranks(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(4)] + [("b", i, 3 - i) for i in range(4)] + [("c", 1, 1)], "k string, x int, y int")
    assert {r.k: r.rho for r in evaluation.spearman(df, ["k"], "x", "y").collect()} == {"a": 1.0, "b": -1.0, "c": 1.0}


def test_profile_choice(spark):
    rows = [("all", 48, 100.0, 900.0, 0.0), ("all", 72, 96.0, 700.0, 0.0), ("all", 80, 101.0, 500.0, 0.01), ("all", 24, 90.0, 400.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, size int, throughput double, p95_ms double, error_rate double")
    assert ranking.choose_profile(df, ["g"], ["size"]).first()["size"] == 72


def test_weighted_jaccard_of_motives(spark):
    a = similarity.motive_weights(F.lit("m"), F.array(F.lit("x"), F.lit("y")))
    b = similarity.motive_weights(F.lit("m"), F.array(F.lit("x"), F.lit("z")))
    assert one(spark, similarity.weighted_jaccard(a, b)) == pytest.approx(0.85 / 1.15)
    assert one(spark, similarity.weighted_jaccard(a, a)) == pytest.approx(1.0)


def test_formula_cells_are_escaped(spark):
    assert one(spark, text.escape_cell(F.lit("=2+2"))) == "'=2+2"
    assert one(spark, text.escape_cell(F.lit("2+2"))) == "2+2"


def test_codes_and_aliases(spark):
    codes = text.business_codes(F.lit("C/HR3 > C/HR3-AP"))
    assert one(spark, codes) == ["C/HR3", "C/HR3-AP"]
    assert one(spark, text.code_alias(F.lit("C/HR3-AP"))) == "CHR3AP"


def test_case_folding_is_not_lower_casing(spark):
    df = spark.createDataFrame([("Straße  ＡＢ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.fold("t")).collect()] == ["strasse ab", ""]


def test_text_similarity_of_empty_texts(spark):
    counts = lambda t: similarity.counted(similarity.bigram_counts(F.lit(t)))
    assert one(spark, similarity.map_cosine(counts(""), counts(""))) == 1.0
    assert one(spark, similarity.map_cosine(counts("ab"), counts(""))) == 0.0
    assert one(spark, similarity.map_cosine(counts("a"), counts("a"))) == pytest.approx(1.0)


def test_url_canonical_form(spark):
    df = spark.createDataFrame([("HTTP://Ex.ORG:443//a//b/?utm_source=x&b=2&a=1#top",), ("ftp://x/y",), ("https://x:8080/y",), ("https://x",)], "u string")
    assert [r[0] for r in df.select(text.canonical_url(F.col("u"))).collect()] == ["https://ex.org/a/b?a=1&b=2", None, None, "https://x/"]


def test_html_tables_keep_rows(spark):
    page = text.read_page("<html lang=de><title> T </title><table><tr><td>a<br>b<th>c</tr><tr><td> </td></tr></table><script>x</script>")
    assert page["tables"] == "a b | c" and page["title"] == "T" and page["language"] == "de" and "x" not in page["content"]


def test_state_difference(spark):
    source = spark.createDataFrame([(1, "h", "p"), (2, "h", "p"), (3, "x", "p"), (4, "h", "p")], "id int, hash string, path string")
    stored = spark.createDataFrame([(2, "h", "p"), (3, "h", "p"), (4, "h", "q"), (5, "h", "p")], "id int, hash string, path string")
    assert dict(joins.state_diff(source, stored).collect()) == {1: "new", 2: "current", 3: "changed", 4: "relocated", 5: "removed"}


def test_clamped_sum_is_not_a_clamped_total(spark):
    df = spark.createDataFrame([("u", i, d) for i, d in enumerate((80, 80, -50))], "k string, i int, d long")
    assert sequences.clamped_sum(df, ["k"], ["i"], "d", -100, 100, "s").first()["s"] == 50


def test_budget_rejects_what_does_not_fit(spark):
    df = spark.createDataFrame([("u", i, a) for i, a in enumerate((60.0, 50.0, 40.0))], "k string, i int, a double")
    assert sequences.budget_reservations(df, ["k"], ["i"], "a", 100).first()[:] == ("u", 100.0, 2, 1)


def test_fusion_does_not_depend_on_branch_order(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "q string, id int, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "q string, id int, rank int")
    first = ranking.reciprocal_rank_fusion([(a, 1.0), (b, 1.25)], ["q"], "id").orderBy("first_rank").collect()
    again = ranking.reciprocal_rank_fusion([(b, 1.25), (a, 1.0)], ["q"], "id").orderBy("first_rank").collect()
    assert first == again and [r.id for r in first] == [2, 3, 1]


def test_rerank_weights_are_scaled():
    assert ranking.normalized_weights(2, 1) == pytest.approx((4 / 3, 2 / 3))
    assert ranking.normalized_weights(float("nan"), 1) == pytest.approx((4 / 3, 2 / 3))


def test_near_duplicate_units():
    assert dedup.near_duplicate_units("abcdefghij", "abcdefghi") and not dedup.near_duplicate_units("abcdefghij", "abc")


def test_longest_run(spark):
    df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate((1, 5, 7, 1, 6, 9, 0))] + [("w", 0, 0.0)], "k string, i int, v double")
    found = {r.k: r[1:] for r in evaluation.longest_run(df, ["k"], ["i"], "v", 2.0).collect()}
    assert found == {"u": (2, 4, 3.0), "w": (0, 0, 0.0)}


def test_filter_contract_names_missing_columns(spark):
    with pytest.raises(ValueError, match="depth"):
        predicates.require_fields(spark.range(1), {"depth": 3}, {"depth": "depth"})


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(1, 40))
def test_chunks_keep_all_content_without_overlap(value, size):
    squeezed = "".join(value.split())
    chunks = text.merge_chunks(value, size, 0)
    assert "".join("".join(c.split()) for c in chunks) == squeezed
    assert all(len(c) <= size for c in chunks)


def test_jsonl_states(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('﻿{"a": 1}\n\n[1]\n{"a": \n{"a": 2}\n', encoding="utf-8")
    df = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert {r["_status"]: r["count"] for r in df.groupBy("_status").count().collect()} == {"ok": 2, "blank": 1, "not_object": 1, "invalid": 1}
    assert sorted(r.a for r in files.good_rows(df).collect()) == [1, 2]


def test_csv_headers_are_checked(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Employee ID,Name\n1,a\n")
    assert files.read_csv(spark, str(tmp_path / "x.csv"), {"employee id": "employee_id"}, ["employee_id", "name"]).columns == ["employee_id", "name"]
    with pytest.raises(ValueError, match="missing role"):
        files.read_csv(spark, str(tmp_path / "x.csv"), {"employee id": "employee_id"}, ["employee_id", "name", "role"])


def test_workbook_cells(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>head</t></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(buffer.getvalue())
    assert files.read_workbooks(spark, str(tmp_path)).first()["cells"] == ["head", "", "5"]


def test_markdown_sections_know_their_path():
    found = files.markdown_sections("intro\n# A\nx\n## B\n```\n# no\n```\n# C\n")
    assert [(s["title"], s["path"], s["start"]) for s in found] == [("", "", 1), ("A", "A", 2), ("B", "A > B", 4), ("C", "C", 8)]


def test_exports_and_replacement(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, "y")], "id int, name string")
    manifest = files.write_export(df, str(tmp_path / "csv"), "csv").collect()
    assert sum(r.rows for r in manifest) == 2
    for r in manifest:
        assert hashlib.sha256((tmp_path / "csv" / "parts" / r.part).read_bytes()).hexdigest() == r.sha256
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "parts")).where("id = 1").first()["name"] == "'=x"
    path = f"file://{tmp_path}/table"
    files.replace_table(df, path)
    files.replace_table(df.where("id = 2"), path)
    assert spark.read.parquet(path).count() == 1
    files.replace_table(df.where("id = 9"), path)
    assert not (tmp_path / "table").exists()


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3, "user_id").write.parquet(str(tmp_path / "in"))
    stream = live.event_stream(spark, str(tmp_path / "in"), events, 10)
    q = live.rate_limited(stream, 2, 86400).writeStream.format("memory").queryName("limited").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(90)
    batch = windows.fixed_windows(events, ["user_id"], "ts", ["event_id"], 2, 86400)
    assert sorted(spark.table("limited").collect()) == sorted(batch.collect())


def test_duplicates_in_a_stream_pass_once(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(50)
    for i in range(2):
        events.write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = live.distinct_events(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("once").count() == events.count()


def test_flagship_gives_eight_a_query(spark, sf_dir):
    found = flagship(spark, sf_dir)
    assert found.groupBy("item_id").count().where("count <> 8").isEmpty() and not found.isEmpty()


def test_scans_are_pruned_and_filters_pushed(spark, sf_dir):
    from textmill.plans import QUERIES

    plan = QUERIES["p02_export_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(o_custkey" in plan or "PushedFilters: [IsNotNull" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]


def test_quota_selection_meets_minimums_and_keeps_rank_order():
    from textmill.operators.selection import Candidate, prefix_reorder, quota_selection

    rows = [Candidate(str(i), i, scope) for i, scope in enumerate("aaabbc", 1)]
    assert [c.id for c in quota_selection(rows, {"c": 1, "b": 1}, 4)] == ["1", "2", "4", "6"]
    assert [c.id for c in prefix_reorder(rows, 2, {"c": 1})] == ["6", "1", "2", "3", "4", "5"]
    assert prefix_reorder(rows, 0, {"c": 1}) == rows


def test_covering_units_after_near_duplicates_go(spark):
    from textmill.operators.selection import covering_units

    texts = [(1, i, "x alone") for i in range(30)] + [(1, 30, "y too"), (1, 31, "x and y and much more of it all")] + [(2, 0, "x"), (2, 1, "z")] + [(3, 0, "y"), (3, 1, "x y")]
    df = spark.createDataFrame(texts, "k long, n long, text string")
    found = lambda needed, most: {r.k: r.units for r in covering_units(df, ["k"], "n", "n", "text", needed, most).collect()}
    assert found(["x", "y"], 20) == {1: [0, 30], 3: [1]} and found(["x", "y"], 60) == {1: [31], 3: [1]} and found(["x", "y", "z"], 99) == {}


def test_spans_and_overlaps():
    from textmill.functions import spans

    strip = spans.strip_repeated_prefix
    assert strip("hello world", "world again") == " again" and strip("the cat", "tomorrow") == "tomorrow"
    assert strip("... ABC DEF", "abc def and more") == " and more" and strip("x repeated", "Repeated, repeated! then") == "! then"
    assert strip("one two three four five", "two thrxe four five six") == " six" and strip(None, " a ") == "a" and strip("a", None) == ""
    assert spans.parse_events(["event: a\nda", "ta: 1\ndata: 2\n\nda", "ta: x\n\n"]) == [("a", "1\n2"), ("message", "x")]
    assert spans.table_blocks("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |  |\nend") == ["a: 1; b: 2\na: 3"]
    assert spans.collect_ids('{"x": {"id": [1, [2]]}, "id": 1}', ("id",)) == ["1", "2"]
    assert spans.remove_boilerplate("x\nx\n---\nPhone:\n123\n\n\ny", [])["text"] == "x\n\ny"
    assert spans.sentence_chunks("A b. C d. E f.", 9, 4) == ["A b. C d.", "C d. E f."]


def test_json_filters_and_edits_keep_types(spark):
    from textmill.operators import predicates

    docs = ['{"a": true, "n": 1, "s": "1", "l": [1, [2], {"k": null}], "o": {"x": 1.50, "y": [true]}}', '{"a": "true", "n": "1"}', '{"a": 1, "n": 1.0, "z": null}', "[1]", "bad", None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    ids = lambda f: [r.i for r in df.where(predicates.compile_filter(f, [], "d")).orderBy("i").collect()]
    assert ids({"a": True}) == [0] and ids({"a": "true"}) == [1] and ids({"n": 1}) == [0, 2] and ids({"n": ["1"]}) == [1] and ids({"z": None}) == [2] and ids({"z": [None, 5]}) == [2]
    assert ids({"l": [[1]]}) == [0] and ids({"l": [[{"k": None}, [2]]]}) == [0] and ids({"l": [[3]]}) == [] and ids({"o": {"y": [True]}}) == [0] and ids({"o": {"x": 1.5}}) == [0] and ids({"a": []}) == []
    out = df.select("i", predicates.drop_json_keys("d", ["n", "l"]).alias("less"), predicates.merge_json("d", {"n": F.lit(None).cast("int"), "new": F.array(F.lit(1), F.lit(2))}).alias("more")).orderBy("i").collect()
    assert json.loads(out[0].less) == {"a": True, "s": "1", "o": {"x": 1.5, "y": [True]}} and out[4].less is None
    assert json.loads(out[1].more) == {"a": "true", "n": None, "new": [1, 2]} and json.loads(out[5].more) == {"n": None, "new": [1, 2]}


def test_urls_against_the_standard_library(spark):
    from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

    from textmill.functions import text

    base = "https://Ex.org/a/b/c?x=1#f"
    hrefs = ["../d", "./e/../f/", "//Other.org:443/x", "?q=1", "/p//q/?b=2&a=%C3%A9+x&utm_source=z", "g?sso=1&B=~*", "http://u@h.org:8080/", "ftp://x/", "#top", "mailto:x", "..", "h%20i", "https://ex.org", "?a&b=&=c", "a\u200bb"]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")

    def plain(h: str) -> str | None:
        h = h.replace("\u200b", "").strip()
        if not h or h.startswith(("#", "mailto:")):
            return None
        u = urlsplit(urljoin(base, h))
        if u.scheme not in ("http", "https") or u.port not in (None, 443):
            return None
        path = re.sub("/{2,}", "/", u.path).rstrip("/") or "/"
        q = urlencode(sorted(p for p in parse_qsl(u.query, keep_blank_values=True) if p[0].lower() not in text.TRACKING_KEYS))
        return f"https://{u.hostname}{path}{'?' + q if q else ''}"

    assert {r.h: r.c for r in df.select("h", text.canonical_url(F.col("h"), F.lit(base)).alias("c")).collect()} == {h: plain(h) for h in hrefs}


def test_windows_rows_and_contexts(spark):
    from textmill.functions import structure

    row = spark.range(1).select(structure.centered(F.lit("alpha beta gamma delta"), F.lit(6), F.lit(10), 12).alias("w")).first()
    assert row.w == "alpha beta gamma"
    boxes = [("b", 50, 0, 60, 10), ("a", 0, 1, 10, 11), ("c", 12, 2, 20, 12), ("v", 90, 0, 92, 40), ("d", 0, 30, 10, 40)]
    pages = spark.createDataFrame([(1, [tuple(map(float, b[1:])) for b in boxes], [b[0] for b in boxes]), (2, [], [])], "k int, p array<struct<x0:double,y0:double,x1:double,y1:double>>, t array<string>")
    pages = pages.select("k", F.transform(F.arrays_zip("t", "p"), lambda z: F.struct(z["t"].alias("t"), *(z["p"][n].alias(n) for n in ("x0", "y0", "x1", "y1")))).alias("boxes"))
    assert {r.k: [x.t for x in r.rows] for r in pages.select("k", structure.page_rows(F.col("boxes")).alias("rows")).collect()} == {1: ["a c | b", "v", "d"], 2: []}
    box = lambda t, y: {"t": t, "x0": 0.0, "y0": y, "x1": 10.0, "y1": y + 8}
    lost = lambda texts, parsed: structure.missing_rows([box(t, 10.0 * i) for i, t in enumerate(texts)], parsed)
    assert lost(["one two", "One  two!", "three four five", "six"], "one two six") == ["three four five"]
    assert lost(["red red"], "red blue") == ["red red"] and lost(["total 5", "other row", "total 5"], "") == ["total 5", "other row", "total 5"]
    assert structure.missing_rows([box("total 5", 0.0), box("Total 5", 0.4)], "") == ["total 5"] and structure.missing_rows([], None) == []
    assert structure.rows_of_level("t\n| Level | W |\n|---|---|\n| G9, G8 | SL1 |\n| SL1 | x |\nend", "level", frozenset(["SL1"])) == "| Level | W |\n|---|---|\n| SL1 | x |"


def test_chunks_keep_rows_items_and_sections_whole():
    from textmill.functions.structure import structured_chunks

    rows = [f"| {i} | {'r' * 20} |" for i in range(12)]
    items = [f"- item {i} {'i' * 20}\n  more {i}" for i in range(9)]
    text = "# S\n\n" + "\n\n".join(f"paragraph {i} " + "p" * 60 for i in range(6)) + "\n\n| a | b |\n|---|---|\n" + "\n".join(rows) + "\n\n# T\n" + "\n".join(items) + "\n\n" + "x" * 400
    chunks = structured_chunks(text, 160, 20)
    assert all(len(c[2]) <= 160 for c in chunks) and [c[0] for c in chunks] == sorted((c[0] for c in chunks[:-3]), key=["paragraph", "table", "list"].index) + ["paragraph"] * 3
    tables, lists = [c[2] for c in chunks if c[0] == "table"], [c[2] for c in chunks if c[0] == "list"]
    assert all(t.startswith("## S\n| a | b |\n|---|---|\n") for t in tables) and [r for t in tables for r in t.split("\n")[3:]] == rows
    assert all(x.startswith("## T\n") for x in lists) and "\n".join(x.removeprefix("## T\n") for x in lists) == "\n".join(items)
    assert structured_chunks(None, 10, 2) == [] and structured_chunks("| a |\n|---|", 99, 0) == [("table", "", "| a |\n|---|")]


def test_folds_and_batches_of_a_long_key(spark):
    from textmill.operators import sequences
    from textmill.sources import files

    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id", F.when(F.col("id") % 3 == 0, -35).otherwise(15).alias("d"))
    want = {}
    for i in range(5000):
        want[i % 2] = max(-100, min(100, want.get(i % 2, 0) + (-35 if i % 3 == 0 else 15)))
    assert dict(sequences.clamped_sum(df, ["k"], ["id"], "d", -100, 100, "score").collect()) == want
    assert sequences.clamped_sum(df.limit(0), ["k"], ["id"], "d", -100, 100, "score").count() == 0
    assert [len(b) for b in files.in_batches(spark.range(0, 25, 1, 3), 10)] == [10, 10, 5]


def test_bm25_by_joins_gives_the_same(spark, sf_dir, monkeypatch):
    from textmill.operators import ranking

    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    run = lambda: sorted(map(tuple, ranking.bm25(docs, items.withColumnRenamed("text", "q"), "doc_id", "text", "item_id", "q", 5).select("item_id", "doc_id", "score", "rank").collect()))
    first = run()
    monkeypatch.setattr(ranking, "MOST_TERMS", 3)
    assert run() == first and len(first) > 20
