"""Structure of texts: footers, structure-preserving chunks, envelopes, projections, record chunks, links of a page, templates."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.spans import let
from textmill.functions.text import canonical_url, clean_inline, merge_chunks

_EDGES = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def strip_footer(text: Column, signature: list[str | None], link_at: int, link_prefix: str, owner_at: int, near_end: int = 20, date: str = r"\b(19|20)\d{2}\b") -> Column:
    """(content, last_changed, owner, removed): a text without its editorial footer.

    A footer is the whole ``signature`` of non-blank lines, null standing for any, within the last ``near_end`` of them; its link and its
    owner line (after the last comma) must fit. A short line before it in which ``date`` is found, any year
    unless a site's dates have a stricter form, is the date of the last change.
    """
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u00a0\u3000", "  "), "[\u200b-\u200d\ufeff]", "")
    lines = F.transform(F.split(plain, r"\r?\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line"))), lambda x: x["line"] != "")

    def said(rows: Column, place: Column) -> Column:
        return F.get(rows, place)["line"]

    def footer(rows: Column) -> Column:
        n = F.size(rows)
        places = F.when(n > 0, F.sequence(F.greatest(n - near_end, F.lit(0)), n - 1)).otherwise(F.array().cast("array<int>"))
        marks = [(k, s.lower()) for k, s in enumerate(signature) if s is not None]

        def fits(p: Column) -> Column:
            found = p + len(signature) <= n
            for k, mark in marks:
                found = found & (F.lower(said(rows, p + k)) == mark)
            owner = F.trim(F.regexp_extract(said(rows, p + owner_at), ",([^,]*)$", 1))
            return F.coalesce(found & F.lower(said(rows, p + link_at)).startswith(link_prefix.lower()) & (owner != ""), F.lit(False))

        return F.array_max(F.filter(places, fits))

    def result(rows: Column, p: Column) -> Column:
        before = said(rows, p - 1)
        dated = F.coalesce((p > 0) & (F.char_length(before) <= 64) & before.rlike(date), F.lit(False))
        end = F.when(p.isNull(), F.size(lines)).otherwise(F.when(dated, F.get(rows, p - 1)["at"]).otherwise(F.get(rows, p)["at"]))
        owner = clean_inline(F.regexp_extract(said(rows, p + owner_at), ",([^,]*)$", 1))
        return F.struct(
            strip(F.array_join(F.slice(lines, F.lit(1), end), "\n")).alias("content"), F.when(dated, clean_inline(before)).otherwise("").alias("last_changed"),
            F.when(p.isNotNull(), owner).otherwise("").alias("owner"), p.isNotNull().alias("removed"),
        )

    # each step is evaluated once, however often the next one names it
    found = F.transform(F.array(numbered), lambda rows: F.struct(rows.alias("rows"), footer(rows).alias("p")))
    return F.element_at(F.transform(found, lambda x: result(x["rows"], x["p"])), 1)


_LIST_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")


def _units(text: str) -> list[tuple[str, str, list[str], list[str]]]:
    """(kind, section, head lines, items): paragraphs, lists and tables of a Markdown text in order."""
    units: list[tuple[str, str, list[str], list[str]]] = []
    section, kind = "", ""
    for line in text.split("\n"):
        heading = re.match(r"#{1,6}\s+(.+?)\s*#*\s*$", line)
        now = "" if heading or not line.strip() else "table" if line.lstrip().startswith("|") else "list" if _LIST_ITEM.match(line) or (kind == "list" and line[:1].isspace()) else "paragraph"
        if heading:
            section = heading[1]
        elif now and now != kind:
            units.append((now, section, [], []))
        kind = now
        if not now:
            continue
        _, _, head, items = units[-1]
        if now == "table" and len(head) < 2 and (not head or re.fullmatch(r"\s*\|[\s:|-]+\|?\s*", line)) and not items:
            head.append(line.strip())
        elif now == "list" and not _LIST_ITEM.match(line):
            items[-1] += "\n" + line.rstrip()
        else:
            items.append(line.strip())
    return units


def structured_chunks(text: str | None, size: int, overlap: int) -> list[tuple[str, str, str]]:
    """(kind, section, text): tables and lists are cut between rows and items only, under their section and table head, each time;
    paragraphs of one section are joined up to ``size``, and only a longer one is cut."""
    chunks: list[tuple[str, str, str]] = []
    waiting: list[str] = []
    last = ""

    def flush() -> None:
        if waiting:
            chunks.extend(("paragraph", last, c) for c in merge_chunks("\n".join(waiting), size, overlap))
            waiting.clear()

    for kind, section, head, items in _units(text or ""):
        if kind == "paragraph":
            if section != last or len("\n".join([*waiting, *items])) > size:
                flush()
            waiting += items
            last = section
            continue
        flush()
        top = ([f"## {section}"] if section else []) + (["\n".join(head)] if head else [])
        held: list[str] = []
        for item in [*items, None]:
            if held and (item is None or len("\n".join([*top, *held, item])) > size):
                chunks.append((kind, section, "\n".join([*top, *held])))
                held = []
            held.append(item or "")
        if not items and head:
            chunks.append((kind, section, "\n".join(top)))
        last = section
    flush()
    return chunks


_CHUNK = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "section", "text")]))


def chunks_by_structure(text: Column, size: int, overlap: int) -> Column:
    @F.pandas_udf(_CHUNK)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("kind", "section", "text"), c, strict=True)) for c in structured_chunks(t, size, overlap)])

    return run(text)


def centered(text: Column, start: Column, end: Column, size: int) -> Column:
    """About ``size`` characters around [start, end), moved out to the nearest white space."""
    room = F.greatest(F.lit(0), size - (end - start))
    a = F.greatest(F.lit(0), start - F.floor(room / 2)).cast("int")
    b = F.least(F.char_length(text), end + room - F.floor(room / 2)).cast("int")
    before = F.char_length(F.regexp_extract(F.substring(text, F.lit(1), a), r"(\S*)\z", 1))
    after = F.char_length(F.regexp_extract(F.substring(text, b + 1, F.char_length(text)), r"^(\S*)", 1))
    return strip(F.substring(text, a - before + 1, b - a + before + after))


def paragraph_envelope(parent: Column, units: Column, most_units: int = 3, least_saving: int = 240, most_share: float = 0.85, gap: str = "\n\n") -> Column:
    """The smallest whole paragraphs of a text around its first ``most_units`` units; empty where a unit does not stand there
    exactly once, or where too little would be saved."""
    whole = strip(parent)

    def around(p: Column) -> Column:
        spans = F.transform(F.slice(units, 1, most_units), lambda u: F.struct(F.call_function("locate", u, p, F.lit(1)).alias("a"), F.char_length(u).alias("n"), F.call_function("locate", u, p, F.call_function("locate", u, p, F.lit(1)) + 1).alias("again")))
        safe = (F.size(spans) > 0) & F.forall(spans, lambda s: (s["a"] > 0) & (s["again"] == 0) & (s["n"] > 0))
        first = F.array_min(F.transform(spans, lambda s: s["a"] - 1))
        last = F.array_max(F.transform(spans, lambda s: s["a"] - 1 + s["n"]))
        head = F.substring(p, F.lit(1), first)
        start = F.when(head.contains(gap), F.char_length(head) - F.char_length(F.substring_index(head, gap, -1))).otherwise(0)
        stop = last + F.char_length(F.substring_index(F.substring(p, last + 1, F.char_length(p)), gap, 1))
        focused = strip(F.substring(p, start + 1, stop - start))
        n = F.char_length(p)
        return F.when(safe & (n - F.char_length(focused) >= least_saving) & (F.char_length(focused) <= n * most_share), focused).otherwise("")

    return F.element_at(F.transform(F.array(whole), around), 1)


def rows_of_level(text: str | None, column: str, allowed: frozenset[str]) -> str:
    """The Markdown tables of a text with those rows alone whose cell in ``column`` names an allowed level."""
    cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")] if line.strip().startswith("|") else []
    lines, kept, i = (text or "").split("\n"), [], 0
    while i + 1 < len(lines):
        header, rule = cells(lines[i]), cells(lines[i + 1])
        if not header or len(rule) != len(header) or not all(re.fullmatch(r":?-+:?", c) for c in rule):
            i += 1
            continue
        j = i + 2
        while j < len(lines) and cells(lines[j]):
            j += 1
        at = next((k for k, c in enumerate(header) if c.casefold() == column.casefold()), None)
        if at is not None and (rows := [x for x in lines[i + 2 : j] if at < len(cells(x)) and allowed & set(re.split(r"[\s,;/]+", cells(x)[at]))]):
            kept.append("\n".join([lines[i], lines[i + 1], *rows]))
        i = j
    return "\n\n".join(kept)


def table_rows_of(text: Column, column: str, allowed: list[str]) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rows_of_level(t, column, frozenset(allowed)))

    return run(text)


def record_chunks(prefix: Column, body: Column, size: int, placeholder: str) -> Column:
    """A record's chunks: its whole prefix, a blank line and a piece of its body each; records are never mixed."""
    text = F.when(strip(F.coalesce(body, F.lit(""))) == "", placeholder).otherwise(strip(body))
    room = F.greatest(size - F.char_length(prefix) - 2, F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)), room)
    pieces = F.filter(F.transform(starts, lambda i: strip(F.substring(text, i, room))), lambda x: x != "")
    return F.transform(pieces, lambda x: F.concat(prefix, F.lit("\n\n"), x))


def page_links(html: Column, url: Column, blocked: list[str]) -> Column:
    """Canonical links of a page's navigation to other pages of its host, each once and in order; blocked extensions are left out."""
    menu = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<nav\b[^>]*>(.*?)</nav>"), F.lit(1)), " ")
    found = F.regexp_extract_all(menu, F.lit(r"""(?is)<a\b[^>]*\shref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    here = canonical_url(url)
    host = F.regexp_extract(here, "^https://([^/]+)", 1)
    pattern = "(?i)\\.(" + "|".join(map(re.escape, blocked)) + ")$"
    links = F.transform(found, lambda x: canonical_url(x, url))
    return F.array_distinct(F.filter(links, lambda x: x.isNotNull() & (x != here) & (F.regexp_extract(x, "^https://([^/]+)", 1) == host) & ~F.regexp_replace(x, "[?].*$", "").rlike(pattern)))


def meta_refresh(html: Column, url: Column, most_seconds: float = 5.0) -> Column:
    """Where a page sends its reader at once, as a canonical URL."""
    content = F.regexp_extract(html, r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*content\s*=\s*["']([^"']*)["']""", 1)
    seconds = F.regexp_extract(content, r"^\s*([0-9.]+)\s*;", 1).try_cast("double")
    target = F.regexp_extract(content, r"(?i);\s*url\s*=\s*(\S+)", 1)
    return F.when((seconds <= most_seconds) & (target != ""), canonical_url(target, url))


def render(template: Column, fields: dict[str, Column]) -> Column:
    """``{{ name }}`` replaced by the field's text, unknown names by nothing."""
    out = template
    for name, value in fields.items():
        mark = rf"\{{\{{\s*{re.escape(name)}\s*\}}\}}"
        plain = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"([\\$])", r"\\$1")
        out = F.regexp_replace(out, F.lit(mark), plain)
    return strip(F.regexp_replace(out, r"\{\{[^}]*\}\}", ""))


BOX = "struct<t:string,x0:double,y0:double,x1:double,y1:double>"
ROW = "struct<y0:double,x0:double,x1:double,y1:double,t:string>"


def page_rows(boxes: Column) -> Column:
    """The rows that a page's boxes (t, x0, y0, x1, y1) form, as (y0, x0, x1, y1, t) from top to bottom.

    Boxes 2.5 times as high as wide are rows of their own. The others come by vertical center; one belongs to the row before
    it where its center is off that row's mean center by at most 0.55 of the lower height of both, or 2. Inside a row boxes
    go by their left edge, apart by `` | `` where the gap is over 1.5 heights of the box before. Null lists give none.
    """
    height, width = (lambda b: F.greatest(F.lit(1.0), b["y1"] - b["y0"])), (lambda b: F.greatest(F.lit(1.0), b["x1"] - b["x0"]))
    upright = lambda b: height(b) > 2.5 * width(b)
    center = lambda b: (b["y0"] + b["y1"]) / 2
    boxes = boxes.cast(f"array<{BOX}>")
    lying = F.array_sort(F.transform(F.filter(boxes, lambda b: ~upright(b)), lambda b: F.struct(center(b).alias("c"), b["x0"].alias("x0"), b.alias("b"))))
    state = f"struct<row:int,n:int,c:double,h:double,out:array<struct<row:int,x0:double,b:{BOX}>>>"
    start = F.from_json(F.lit('{"row":0,"n":0,"c":0,"h":0,"out":[]}'), state)

    def place(s: Column, x: Column) -> Column:
        tall = x["b"]["y1"] - x["b"]["y0"]
        reach = F.greatest(F.lit(2.0), 0.55 * F.least(F.greatest(F.lit(1.0), tall), F.greatest(F.lit(1.0), s["h"] / s["n"])))
        same = (s["n"] > 0) & (F.abs(x["c"] - s["c"] / s["n"]) <= reach)
        row = s["row"] + F.when(same, 0).otherwise(1)
        sums = [(F.when(same, s[k]).otherwise(0) + v).alias(k) for k, v in (("n", F.lit(1)), ("c", x["c"]), ("h", tall))]
        return F.struct(row.alias("row"), *sums, F.concat(s["out"], F.array(F.struct(row.alias("row"), x["x0"].alias("x0"), x["b"].alias("b")))).alias("out"))

    def joined(placed: Column, row: Column) -> Column:
        mine = F.transform(F.array_sort(F.filter(placed, lambda p: p["row"] == row)), lambda p: p["b"])
        return let(mine, cells)

    def cells(mine: Column) -> Column:
        texts = F.transform(mine, lambda b, i: F.concat(F.when(i == 0, "").when(b["x0"] - F.get(mine, i - 1)["x1"] > 1.5 * height(F.get(mine, i - 1)), " | ").otherwise(" "), F.coalesce(b["t"], F.lit(""))))
        edge = lambda f, k: f(F.transform(mine, lambda b: b[k])).alias(k)
        return F.struct(edge(F.array_min, "y0"), edge(F.array_min, "x0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"), F.trim(F.array_join(texts, "")).alias("t"))

    placed = F.aggregate(lying, start, place, lambda s: s["out"])
    rows = let(placed, lambda p: F.transform(F.array_distinct(F.transform(p, lambda x: x["row"])), lambda row: joined(p, row)).cast(f"array<{ROW}>"))
    alone = F.transform(F.filter(boxes, upright), lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["y1"].alias("y1"), F.coalesce(b["t"], F.lit("")).alias("t")))
    return F.array_sort(F.concat(rows, alone.cast(f"array<{ROW}>")))


def _overlap(a: dict, b: dict) -> float:
    """The share of both boxes' area that they have in common."""
    area = lambda x: max(0.0, x["x1"] - x["x0"]) * max(0.0, x["y1"] - x["y0"])
    common = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
    both = area(a) + area(b) - common
    return common / both if both > 0 else 0.0


def missing_rows(rows: list[dict], parsed: str | None, least: float = 0.15, same: float = 0.8) -> list[str]:
    """Rows (t, x0, y0, x1, y1) of a page that its parse lost, in order: neither contained in it nor, but for less than ``least`` of their words, among its words.

    A row uses up the parse's words that it has, whether lost or not. A row whose words and place (``same`` of the area in common) repeat an
    earlier one is that one; equal words elsewhere on the page are a row of their own. Rows without words are nothing.
    """
    words = lambda t: re.findall(r"\w+", (t or "").casefold())
    left, whole = Counter(words(parsed)), "".join(words(parsed))
    seen: dict[str, list[dict]] = {}
    lost = []
    for row in rows:
        mine = Counter(words(row["t"]))
        key = "".join(words(row["t"]))
        if not mine or any(_overlap(row, other) >= same for other in seen.get(key, [])):
            continue
        seen.setdefault(key, []).append(row)
        found = (mine & left).total()
        left -= mine
        if key not in whole and 1 - found / mine.total() >= least:
            lost.append(row["t"].strip())
    return lost


@F.pandas_udf(T.ArrayType(T.StringType()))
def lost_rows(rows: pd.Series, parsed: pd.Series) -> pd.Series:
    """``missing_rows`` of lists of (t, x0, y0, x1, y1)."""
    return pd.Series([missing_rows([] if r is None else list(r), p) for r, p in zip(rows, parsed, strict=True)])
