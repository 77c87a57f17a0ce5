"""Queries that SQL does not express, against plain Python over the same tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb

from textmill.functions import similarity, spans, text
from textmill.plans import QUERIES


def rows(sf_dir: str, sql: str) -> list[tuple]:
    return duckdb.sql(sql.replace("{", f"'{sf_dir}/").replace("}", ".parquet'")).fetchall()


def md5(x: str) -> str:
    return hashlib.md5(x.encode()).hexdigest()


def test_fold(spark, sf_dir):
    import unicodedata

    want = {d: md5(" ".join(unicodedata.normalize("NFKC", t).split()).casefold()) for d, t in rows(sf_dir, "SELECT doc_id, text FROM {documents}")}
    assert dict(QUERIES["f01_fold"](spark, sf_dir).collect()) == want


def alike(a: str, b: str) -> bool:
    x, y = sorted((" ".join(a.lower().split()), " ".join(b.lower().split())), key=len)
    return x == y or (bool(x) and x in y and len(x) / len(y) >= 0.85)


def distinct(sf_dir: str, limit: int) -> list[tuple]:
    kept: dict[int, list] = defaultdict(list)
    for c, n, t in rows(sf_dir, "SELECT conv_id, turn, text FROM {conversations} ORDER BY conv_id, turn, text"):
        if len(kept[c]) < limit and not any(alike(t or "", u) for _, u in kept[c]):
            kept[c].append((n, t or ""))
    return [(c, n, t) for c, found in kept.items() for n, t in found]


def test_diversified_units(spark, sf_dir):
    assert sorted(map(tuple, QUERIES["u12_greedy_distinct"](spark, sf_dir).collect())) == sorted(x[:2] for x in distinct(sf_dir, 4))
    order = sorted(distinct(sf_dir, 8), key=lambda x: (x[1], x[0], x[2]))[:64]
    assert sorted(map(tuple, QUERIES["k07_unit_diversification"](spark, sf_dir).collect())) == sorted(x[:2] for x in order)


def test_covering_units(spark, sf_dir):
    import itertools

    units = defaultdict(list)
    for c, n, t in distinct(sf_dir, 8):
        units[c].append((n, t, {"of", "the"} & set(re.findall(r"[^\W_]+", t.lower()))))
    want = {}
    for c, mine in units.items():
        fits = [p for k in range(1, len(mine) + 1) for p in itertools.combinations(range(len(mine)), k) if set().union(*(mine[i][2] for i in p)) == {"of", "the"} and sum(len(mine[i][1]) for i in p) <= 4000]
        if fits:
            want[c] = ",".join(str(mine[i][0]) for i in min(fits, key=lambda p: (len(p), -sum(len(mine[i][2]) for i in p), p)))
    assert dict(QUERIES["k14_covering_units"](spark, sf_dir).collect()) == want and want


def chunked(t: str, size: int, overlap: int) -> list[str]:
    """What the chunks must be: whole lines while they fit, else a new chunk that begins with the end of the last one."""
    out, now = [], ""
    for piece in (p.strip() for p in re.split(r"\n\s*\n|\n", t)):
        if not piece:
            continue
        if now and len(now) + 1 + len(piece) > size:
            out += [x for i in range(0, len(now), size) if (x := now[i : i + size].strip())]
            tail = now[-overlap:].strip()
            now = f"{tail}\n{piece}" if tail and len(tail) + 1 + len(piece) <= size else piece
        else:
            now = f"{now}\n{piece}" if now else piece
    return out + [x for i in range(0, len(now), size) if (x := now[i : i + size].strip())]


def test_chunks(spark, sf_dir):
    docs = rows(sf_dir, "SELECT doc_id, text FROM {documents}")
    want = sorted((d, i, c) for d, t in docs for i, c in enumerate(chunked(t, 2048, 160)))
    assert sorted(map(tuple, QUERIES["f17_overlapping_chunks"](spark, sf_dir).collect())) == want
    found = defaultdict(list)
    for r in QUERIES["f18_sentence_chunks"](spark, sf_dir).orderBy("doc_id", "index").collect():
        found[r.doc_id].append(r.chunk)
    for d, t in docs:
        sentences = [s.strip() for s in re.findall(r"[^.!?。！？\n]+[.!?。！？]*", t) if s.strip()]
        at = 0
        for c in found[d]:  # every chunk is a run of whole sentences that goes on where the last one ended, or a little before
            assert len(c) <= 1000 or c in sentences
            starts = [i for i in range(max(0, at - 60), at + 1) if " ".join(sentences[i:]).startswith(c)]
            assert starts
            at = max(i + len([1 for _ in re.findall(r"[^.!?。！？]+[.!?。！？]*", c)]) for i in starts[-1:])
        assert at >= len(sentences) or not sentences or sentences[-1] in (found[d] or [""])[-1]


def test_boilerplate(spark, sf_dir):
    noise = re.compile(r"^(Released|Licensed) under")
    for r in QUERIES["f37_boilerplate"](spark, sf_dir).collect():
        assert r.noise >= 0
    want = {d: sum(bool(noise.search(x.strip())) for x in t.split("\n")) for d, t in rows(sf_dir, "SELECT doc_id, text FROM {documents}")}
    assert {r.doc_id: r.noise for r in QUERIES["f37_boilerplate"](spark, sf_dir).collect()} == want


def test_sections_images_and_codes(spark, sf_dir):
    docs = rows(sf_dir, "SELECT doc_id, source, lang, length(text), text FROM {documents}")
    found = defaultdict(list)
    for r in QUERIES["s07_markdown_sections"](spark, sf_dir).collect():
        found[r.doc_id].append((r.title, r.level, r.path, r.start))
    assert all(found[d][:2] == [(s, 1, s, 1), (lang, 2, f"{s} > {lang}", 2)] for d, s, lang, _, t in docs if not re.search(r"^#{1,6}\s", t, re.M))
    assert sorted(map(tuple, QUERIES["x10_image_references"](spark, sf_dir).collect())) == sorted((d, f"img/{d}.png") for d, *_ in docs)


def test_pages_and_links(spark, sf_dir):
    pages = rows(sf_dir, "SELECT page_id, html FROM {pages}")
    hrefs = {p: re.findall(r'<a [^>]*href="([^"]+)"', re.sub(r"(?s)<!--.*?-->", "", h)) for p, h in pages}
    found = {r.page_id: (r.language, r.n_links) for r in QUERIES["s10_html_pages"](spark, sf_dir).collect()}
    assert found == {p: ((re.search(r'<html lang="([^"]*)"', h) or ["", ""])[1], len(hrefs[p])) for p, h in pages}
    links = defaultdict(set)
    for p, found_here in hrefs.items():
        for x in found_here:
            links[x].add(p)
    assert {r.link: (r.first_page, r.pages) for r in QUERIES["u14_link_dedup"](spark, sf_dir).collect()} == {x: (min(p), len(p)) for x, p in links.items()}


def bigrams(t: str) -> Counter:
    plain = "".join(c for c in t.lower() if c.isalnum())
    return Counter(plain[i : i + 2] for i in range(len(plain) - 1)) or Counter([plain] if plain else [])


def cosine(a: str, b: str) -> float:
    x, y = bigrams(a), bigrams(b)
    if not x or not y:
        return float(not x and not y)
    return sum(x[g] * y[g] for g in x) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5


def test_reply_matches(spark, sf_dir):
    turns = defaultdict(list)
    for c, n, role, t in rows(sf_dir, "SELECT conv_id, turn, role, text FROM {conversations} ORDER BY conv_id, turn, role, text"):
        turns[c].append((n, role, t))
    pairs = [(c, n, t, x[i + 1][2], x[i + 1][0], "\n".join(u for _, _, u in x[max(0, i - 2) : i])) for c, x in turns.items() for i, (n, role, t) in enumerate(x[:-1]) if role == "user" and x[i + 1][1] == "assistant"]
    want = {}
    for c, n, said, _, _, around in (p for p in pairs if p[0] % 100 == 0):
        found = []
        for fc, fn, fsaid, reply, reply_turn, faround in pairs:
            like, near = cosine(said, fsaid), cosine(around, faround)
            if (c, n) == (fc, fn) or like < 0.6 or (around and faround and near < 0.45) or any(cosine(reply, p[3]) >= 0.96 for p in pairs if p[0] == c):
                continue
            found.append((round(0.6 * like + 0.2 * near + 0.2 * (1.0 if c == fc else 0.8), 6), c == fc, reply_turn, fc, fn))
        if found:
            best = max(found)
            want[c, n] = (best[3], best[4], best[0])
    assert {(r.conv_id, r.turn): (r.from_conv, r.from_turn, r.score) for r in QUERIES["f29_reply_matches"](spark, sf_dir).collect()} == want
    assert similarity.bigram_cosine("", None) == 1.0 and similarity.bigram_cosine("a", "") == 0.0


def test_selected_candidates_meet_quotas_and_keep_order(spark, sf_dir):
    langs = dict(rows(sf_dir, "SELECT doc_id, lang FROM {documents}"))
    ranked = defaultdict(list)
    from textmill.plans.hybrid import reranked

    for r in reranked(spark, sf_dir).select("item_id", "doc_id", "position").collect():
        ranked[r.item_id].append((r.position, r.doc_id))
    chosen = defaultdict(list)
    for r in QUERIES["hybrid_selection"](spark, sf_dir).orderBy("query_id", "position").collect():
        chosen[r.query_id].append(int(r.id))
    assert set(chosen) == set(ranked)
    for q, picked in chosen.items():
        order = [d for _, d in sorted(ranked[q])]
        assert picked == sorted(picked, key=order.index) and len(picked) == min(8, len(order))
        for lang, least in {"fr": 1, "de": 1, "en": 2}.items():
            assert sum(langs[d] == lang for d in picked) >= min(least, sum(langs[d] == lang for d in order))


def ranked_items(spark, sf_dir) -> dict[int, list]:
    from textmill.plans.selection import _ranked

    items = defaultdict(list)
    for r in _ranked(spark, sf_dir).orderBy("query_id", "rank").collect():
        items[r.query_id].append((r["rank"], r.id, r.scope, r.source, set(r.terms)))
    return items


def answers(spark, sf_dir, name: str) -> dict[int, list]:
    found = defaultdict(list)
    for r in QUERIES[name](spark, sf_dir).orderBy("query_id", "position").collect():
        found[r.query_id].append(r.id)
    return found


def test_quotas_of_all_items(spark, sf_dir):
    liked, want = {"the", "of", "la"}, {}
    for q, rows in ranked_items(spark, sf_dir).items():
        taken: list = []
        for scope in ("fr", "de", "en", "en", None):  # the minimums, one place after the other; then whatever is best
            for _ in range(1 if scope else 8 - len(taken)):
                shown = set().union(*(t[4] & liked for t in taken))
                pool = [r for r in rows if r not in taken and scope in (None, r[2])]
                gain = lambda r, shown=shown: len((r[4] & liked) - shown)
                pool = [r for r in pool if gain(r) == max(map(gain, pool))]
                if scope:  # among equal gains the most liked words
                    pool = [r for r in pool if len(r[4] & liked) == max(len(x[4] & liked) for x in pool)]
                taken += pool[:1]
        want[q] = [r[1] for r in sorted(taken)]
    assert answers(spark, sf_dir, "k11_quota_selection") == want and want


def test_prefixes_of_all_items(spark, sf_dir):
    want = {}
    for q, rows in ranked_items(spark, sf_dir).items():
        head: list = []
        for scope in ("en", "en", "en", "es"):
            known = set().union(*(h[4] for h in head))
            pool = sorted((r for r in rows if r not in head and r[2] == scope), key=lambda r, known=known: (len(r[4] & known) - len(r[4]), -len(r[4]), r[0]))
            head += pool[:1]
        while len(head) < min(8, len(rows)):
            rest = [r for r in rows if r not in head]
            rare = [r for r in rest if Counter(h[3] for h in head)[r[3]] < 2]
            head.append((rare or rest)[0])
        want[q] = [r[1] for r in head + [r for r in rows if r not in head]]
    assert answers(spark, sf_dir, "k12_prefix_reorder") == want and want


def test_structured_chunks_lose_no_word(spark, sf_dir):
    from textmill.plans.structure import _markdown

    found = defaultdict(list)
    for r in QUERIES["f19_structured_chunks"](spark, sf_dir).orderBy("doc_id", "index").collect():
        found[r.doc_id].append(r)
    words = lambda t: re.findall(r"[^\W_]+", t)
    for d, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _markdown().alias("m")).collect():
        chunks = found[d]
        assert all(len(c.text) <= 1000 or c.kind != "paragraph" for c in chunks) and [c["index"] for c in chunks] == list(range(len(chunks)))
        have = Counter(w for c in chunks for w in words(f"{c.section} {c.text}"))
        rest = Counter(w for line in (text or "").split("\n") if not line.startswith("#") for w in words(line)) - have
        assert sum(rest.values()) <= 0.02 * max(50, sum(have.values())), (d, rest.most_common(5))


def test_parts_of_other_queries(spark, sf_dir):
    assert spans.event_milestones([(0.5, "event: a\nda"), (1.0, "ta: x\n\n"), (2.0, "data: y\n\n")]) == [("a", "x", 1.0), ("message", "y", 2.0)]
    assert text.merge_chunks("a\n\nb", 10, 2) == ["a\nb"]
