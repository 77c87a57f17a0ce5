"""Quotes, citations, contexts and page rows against plain Python over the same tables."""

from __future__ import annotations

import difflib
import hashlib
import re
import unicodedata
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from textmill.functions import quotes
from textmill.operators import citations
from textmill.plans import QUERIES
from textmill.plans.matches import cited


def rows(sf_dir: str, sql: str) -> list[tuple]:
    return duckdb.sql(sql.replace("{", f"'{sf_dir}/").replace("}", ".parquet'")).fetchall()


def plain_span(text: str, quote: str) -> tuple[int, int] | None:
    """By trying every place of the text, character by character."""
    if not quote:
        return None
    if quote in text:
        return text.index(quote), text.index(quote) + len(quote)
    fold = lambda c: [x for x in unicodedata.normalize("NFKC", c).casefold() if x.isalnum() or x in "+#"]
    flat = [(x, i) for i, c in enumerate(text) for x in fold(c)]
    want = [x for c in quote for x in fold(c)]
    for at in range(len(flat) - len(want) + 1 if want else 0):
        if flat[at][0] == want[0] and [x for x, _ in flat[at : at + len(want)]] == want:
            return flat[at][1], flat[at + len(want) - 1][1] + 1
    return None


def test_spans_of_quotes():
    cases = [
        ("one  Two three", "one two", (0, 8)), ("abc", "zzz", None), ("\u0130\u0130\u0130\u0130 say hello world abc", "hello world abX", None), ("\u0130\u0130\u0130\u0130 say Hello world abc", "hello, WORLD", (9, 20)),
        ("\uff21\uff22\uff23 \ufb01ne stra\u00dfe", "abc fine STRASSE", (0, 14)), ("say \u201cit\u2019s\u201d C++", "its c++", (5, 14)), ("C", "c++", None), ("", "x", None), ("x", "", None), ("a - b", "-", (2, 3)), ("ab", "~", None),
        ("the cat sat", "the sat", None), ("x1.5", "15", (1, 4)), ("\u00bd cup", "1 2 CUP", (0, 5)), ("aba aba", "ABA", (0, 3)),
    ]
    for text, quote, want in cases:
        assert quotes.find_quotes(text, [quote])[0] == want == (plain_span(text, quote)), (text, quote)
    many = [q for _, q, _ in cases] + [None]
    for text, _, _ in cases:  # by automaton as one by one
        assert quotes.find_quotes(text, many) == [None if q is None else plain_span(text, q) for q in many]
    assert quotes.find_quotes(None, ["a", None]) == [None, None]


def test_a_popular_source_is_cut_and_nothing_is_lost(spark):
    text = " ".join(f"Word{i}" for i in range(900))
    asked = spark.range(900).select(F.lit(1).alias("s"), F.concat(F.lit("WORD"), F.col("id")).alias("q"), "id").unionByName(spark.createDataFrame([(2, "a", 900), (None, "b", 901), (3, None, 902), (1, "word5", 903), (1, "word5", 903)], "s int, q string, id long"))
    texts = spark.createDataFrame([(1, text), (3, "x"), (4, "unused")], "s int, text string")
    found = quotes.locate(asked, texts, "s", "q", "text").collect()
    assert len(found) == 905 and {r.id: r.span.text for r in found if r.id < 900} == {i: f"Word{next(j for j in range(900) if f'Word{j}'.startswith(f'Word{i}'))}"[: len(f"Word{i}")] for i in range(900)}
    assert {(r.id, r.span.known, r.span.start) for r in found if r.id >= 900} == {(900, False, None), (901, False, None), (902, True, None), (903, True, text.index("Word5"))}


def plain_outcome(r, sources: dict, targets: dict) -> tuple:
    if None in (r.target, r.source_ref, r.highlight, r.quote):
        return "rejected", "invalid_shape", None
    if r.source_ref not in sources:
        return "rejected", "unknown_source", None
    scope, text = sources[r.source_ref]
    span, shown = plain_span(text, r.quote), plain_span(targets[r.target], r.highlight)
    if span is None:
        return "rejected", "quote_not_in_source", None
    norm = lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).casefold()).strip()
    high, said = targets[r.target][slice(*shown)] if shown else r.highlight, text[slice(*span)]
    codes = lambda x: set(re.findall(r"(?i)(?<![a-z0-9])(?:SL\d+(?:G\d+)?|ETP\d+|TP\d+|G\d+|P\d+)(?![a-z0-9])", norm(x)))

    def named(x: str) -> set:
        got = {s for s, terms in citations.AUTHORITY.items() if any(t in norm(x) for t in terms)}
        return got | ({"job_level"} if re.search(r"(?<![a-z0-9])(?:g\d+|sl\d+(?:g\d+)?)(?![a-z0-9])", norm(x)) else set())

    if (need := named(high) or named(said)) and scope not in need:
        return "rejected", "authority_scope_conflict", span
    if codes(high) and codes(said) - codes(high):
        return "rejected", "conflicting_business_code", span
    if shown is None:
        return "related", "highlight_not_in_output", span
    n = norm(high)
    han = len(re.findall("[\u3400-\u9fff]", n))
    good = n and high.strip() not in citations.GENERIC and len(n) <= 160 and len([x for x in high.splitlines() if x.strip()]) <= 2 and len(re.findall("[。！？.!?；;]", n)) <= 2 and len(re.findall("[,，、]", n)) <= 3
    good = good and (han >= 3 if han else len(re.findall("[a-z][a-z0-9+#.-]*", n)) >= 2) and any(c.isalnum() for c in n)
    if not good:
        return "related", "generic_or_short_highlight", span
    if not norm(said) or len(norm(said)) > 600 or len([x for x in said.splitlines() if x.strip()]) > 8:
        return "related", "overbroad_source_quote", span
    return "anchor", None, span


def test_citations(spark, sf_dir):
    references, sources, targets = cited(spark, sf_dir)
    sources, targets = {r.source_ref: (r.scope, r.text) for r in sources.collect()}, {r.target: r.text for r in targets.collect()}
    want = {r.ref_id: plain_outcome(r, sources, targets) for r in references.collect()}
    found = {r.ref_id: r for r in QUERIES["x27_citation_outcomes"](spark, sf_dir).collect()}
    assert {k: (r.outcome, r.reason) for k, r in found.items()} == {k: w[:2] for k, w in want.items()}
    assert {k: (r.quote_start, r.quote_end) for k, r in found.items() if r.quote_start is not None} == {k: w[2] for k, w in want.items() if w[2]}
    cites = {r.ref_id: r.source_ref for r in references.collect()}
    assert all(r.quote_hash == hashlib.md5(sources[cites[k]][1][r.quote_start : r.quote_end].encode()).hexdigest() for k, r in found.items() if r.quote_start is not None)
    counts = Counter(w[:2] for w in want.values())
    assert {(r.outcome, r.reason): r.n for r in QUERIES["x27_rejection_counters"](spark, sf_dir).collect()} == counts
    assert {"unknown_source", "quote_not_in_source", "authority_scope_conflict", "conflicting_business_code", "invalid_shape", "highlight_not_in_output", "generic_or_short_highlight", "overbroad_source_quote", None} == {k[1] for k in counts}
    merged = defaultdict(lambda: [set(), 0])
    for k, w in want.items():
        if w[0] != "rejected":
            merged[cites[k]][0].add(k)
            merged[cites[k]][1] += w[0] == "anchor"  # each reference has its own target, so no anchor repeats another
    assert {r.source_ref: [r.targets, r.anchors] for r in QUERIES["x27_merged_sources"](spark, sf_dir).collect()} == {k: [len(t), n] for k, (t, n) in merged.items()}


def test_anchors_are_merged_by_priority(spark):
    schema = "answer int, ref int, target string, source_ref string, outcome string, highlight_span struct<text:string>, quote_span struct<text:string>"
    data = [(1, 2, "t", "skill", "anchor", ("A  b",), ("Q",)), (1, 5, "t", "kb", "anchor", ("a B",), ("q",)), (1, 7, "u", "kb", "related", (None,), ("q",)), (1, 8, "u", "kb", "rejected", (None,), (None,)), (2, 1, "t", "kb", "anchor", ("a b",), ("q",))]
    df = spark.createDataFrame(data, schema)
    anchors, sources = citations.merged(df, "answer", "ref", F.when(F.col("source_ref") == "skill", 1).otherwise(0))
    assert sorted((r.answer, r.target, r.source_ref, r.highlight, r.place) for r in anchors.collect()) == [(1, "t", "kb", "a B", 2), (2, "t", "kb", "a b", 1)]
    assert sorted((r.answer, r.source_ref, r.targets, r.anchors) for r in sources.collect()) == [(1, "kb", 2, 1), (2, "kb", 1, 1)]


def test_context_of_a_quote():
    text = "# A\nfirst line\n\nThe quote here\nnext one\n# B\nother\nLast:\n- item:\ng5 rule\nG6 rule"
    context = quotes.quote_context
    assert context(text, "the  quote") == "# A\n\nThe quote here\n\nnext one" and context(text, "Next-one") == "# A\n\nThe quote here\n\nnext one"
    assert context(text, "other") == "# B\n\nother" and context("x", "absent words") == "absent words" and context(None, None) == ""
    assert context(text, "here next") == "# A\n\nfirst line\n\nThe quote here\n\nnext one"
    codes = re.compile(r"(?i)\bg\d\b")
    assert context(text, "g5 rule", codes) == "Last:\n\n- item:\n\ng5 rule" and context(text, "g5 rule") == "Last:\n\ng5 rule\n\nG6 rule"
    long = context("a" * 2000 + " quoted " + "b" * 2000, "quoted")
    assert len(long) <= 900 and long[0] == long[-1] == "…" and long.index("quoted") == 300
    assert context("x" * 1000, "x" * 1000) == "x" * 898 + "…"


def test_contexts_of_all_documents(spark, sf_dir):
    from textmill.plans.structure import _markdown

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", _markdown().alias("m")).collect()
    found = dict(QUERIES["x28_source_context"](spark, sf_dir).collect())
    several = 0
    for r in docs:
        second = (r.text or "").split("\n")[1:2]
        quote = (second[0] if second else "").strip(" ").upper()
        span = plain_span(r.m or "", quote)
        if span is None:
            assert found[r.doc_id] == quote[:898] + "…" * (len(quote) > 900) if len(quote) > 900 else found[r.doc_id] == quote
            continue
        lines, at, mine = (r.m or "").splitlines(keepends=True), 0, []
        for i, line in enumerate(lines):  # the lines that the span touches
            if at < span[1] and at + len(line) > span[0]:
                mine.append(i)
            at += len(line)
        lines = [x.strip() for x in lines]
        head = lambda x: bool(x) and (re.match(r"#{1,6}\s+\S", x) or (not re.match(r"[-*+]\s|\d+[.)、]", x) and len(x) <= 80 and x[-1] in ":："))
        tops = [i for i, x in enumerate(lines) if head(x)]
        top = max((i for i in tops if i <= mine[0]), default=None)
        end = min((i for i in tops if i > mine[-1]), default=len(lines))
        near = [i for i in range(mine[-1] + 1, end) if lines[i]][:1] or [i for i in range(mine[0]) if lines[i] and i > (-1 if top is None else top)][-1:]
        want = "\n\n".join(lines[i] for i in sorted({*mine, *near, *([top] if top is not None else [])}) if lines[i])
        if len(want) <= 900:
            assert found[r.doc_id] == want
            several += len(near)
        else:
            assert found[r.doc_id].strip("…") in want and len(found[r.doc_id]) <= 900
    assert several > 10


def test_lost_rows_of_all_documents(spark, sf_dir):
    want = []
    for d, t in rows(sf_dir, "SELECT doc_id, coalesce(text, '') FROM {documents}"):
        lines = t.split("\n")
        words = lambda x: re.findall(r"\w+", x.casefold())
        parsed = "\n".join(x for i, x in enumerate(lines) if i % 3 != 1)
        left = Counter(words(parsed))
        for x in lines:  # the second box of a line lies on the first one
            mine = Counter(words(x))
            if not mine:
                continue
            found = sum((mine & left).values())
            left = left - mine
            if "".join(words(x)) not in "".join(words(parsed)) and 1 - found / mine.total() >= 0.15:
                want.append((d, x.strip()))
    assert sorted(map(tuple, QUERIES["x24_page_fallback"](spark, sf_dir).collect())) == sorted(want) and want


def test_page_rows_of_all_orders(spark, sf_dir):
    pages = defaultdict(list)
    for o, p, disc, n, q, tax in rows(sf_dir, "SELECT l_orderkey, l_partkey, l_discount, l_linenumber, l_quantity, l_tax FROM {lineitem}"):
        x, y = float(disc) * 3000, float(n * 4 + q % 7)
        pages[o].append((x, y, x + (2 if p % 9 == 0 else 20 + float(tax) * 100), y + 8, str(p)))
    found = defaultdict(list)
    for r in QUERIES["x23_spatial_rows"](spark, sf_dir).orderBy("l_orderkey", "at").collect():
        found[r.l_orderkey].append(r.t)
    assert set(found) == set(pages)
    for o, boxes in pages.items():
        tall = [b for b in boxes if b[3] - b[1] > 2.5 * max(1.0, b[2] - b[0])]
        groups: list[list] = []
        for b in sorted((b for b in boxes if b not in tall), key=lambda b: ((b[1] + b[3]) / 2, b[0], b[4])):
            last = groups[-1] if groups else []
            if last and abs((b[1] + b[3]) / 2 - sum(x[1] + x[3] for x in last) / 2 / len(last)) <= max(2.0, 0.55 * 8):
                last.append(b)
            else:
                groups.append([b])
        made = []
        for g in groups:
            g.sort(key=lambda b: (b[0], b[4]))
            made.append((min(b[1] for b in g), g[0][0], "".join(("" if not i else " | " if b[0] - g[i - 1][2] > 12 else " ") + b[4] for i, b in enumerate(g))))
        made += [(b[1], b[0], b[4]) for b in tall]
        assert sorted(found[o]) == sorted(x[2] for x in made), o


def test_repeated_prefixes_of_all_turns(spark, sf_dir):
    turns = defaultdict(list)
    for c, n, role, t in rows(sf_dir, "SELECT conv_id, turn, role, text FROM {conversations} ORDER BY conv_id, turn, role, text"):
        turns[c].append((n, role, t))
    found = {(r.conv_id, r.turn, r.role): (r.asked, r.rest) for r in QUERIES["x14_repeated_prefixes"](spark, sf_dir).collect()}
    form = lambda x: [(y, i) for i, c in enumerate(unicodedata.normalize("NFKC", x or "").strip(), 1) for y in c.casefold() if y.isalnum()]
    stripped = 0
    frame = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.expr("2 + int(pmod(xxhash64(conv_id, turn), 39))").alias("n")).distinct()
    length = {(r.conv_id, r.turn): r.n for r in frame.collect()}
    for c, mine in turns.items():
        for i, (n, role, t) in enumerate(mine):
            before = mine[i - 1][2] if i else None
            tail = (before or "")[-length[c, n] :]
            kind = (i + 1 + c) % 5
            head = [tail, tail.upper(), re.sub(r"(?m)^(.{3}).", r"\1x", tail, count=1) if not tail.startswith("\n") else tail, tail + "... " + tail, ""][kind]
            said = head + ", " + (t or "")
            asked, rest = found[c, n, role]
            if asked != hashlib.md5("|".join(x for x in (before, said) if x is not None).encode()).hexdigest():
                continue  # a line feed at the cut: another text was asked
            old, new, whole, done = "".join(x for x, _ in form(before)), form(said), unicodedata.normalize("NFKC", said).strip(), 0
            while True:
                left = "".join(x for x, _ in new[done:])
                for size in range(min(120, len(old), len(left)), 3, -1):
                    a, b = old[-size:], left[:size]
                    if a == b or (size >= 6 and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.92):
                        break
                else:
                    break
                done += size
            assert rest == (whole[new[done - 1][1] :] if done else whole), (c, n)
            stripped += bool(done)
    assert stripped > len(found) // 5
