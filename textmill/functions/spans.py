"""Spans, chunks of whole units, boilerplate, overlaps: what needs a cursor over one text runs as Arrow functions."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*\s*|\n+")


def sentence_chunks(text: str | None, size: int, overlap: int) -> list[str]:
    """Whole sentences up to ``size`` characters; a new chunk repeats the last sentences that fit in ``overlap``."""
    units = [u.strip() for u in _SENTENCE.findall(text or "") if u.strip()]
    chunks, current = [], []
    length = lambda xs: sum(map(len, xs)) + max(0, len(xs) - 1)
    for unit in units:
        if current and length([*current, unit]) > size:
            chunks.append(" ".join(current))
            tail: list[str] = []
            for u in reversed(current):
                if length([u, *tail]) > overlap or length([u, *tail, unit]) > size:
                    break
                tail.insert(0, u)
            current = tail
        current.append(unit)
    return chunks + ([" ".join(current)] if current else [])


def table_blocks(markdown: str | None, rows_per_block: int = 8) -> list[str]:
    """Markdown tables as blocks of ``header: value`` lines, the header repeated in each block."""
    blocks, header, rows = [], None, []

    def close() -> None:
        for at in range(0, len(rows), rows_per_block):
            blocks.append("\n".join("; ".join(f"{h}: {v}" for h, v in zip(header, r, strict=False) if v) for r in rows[at : at + rows_per_block]))

    for line in [*(markdown or "").split("\n"), ""]:
        cells = [c.strip() for c in line.strip().strip("|").split("|")] if line.strip().startswith("|") else None
        if cells is None:
            if header:
                close()
            header, rows = None, []
        elif header is None:
            header = cells
        elif not all(re.fullmatch(r":?-+:?", c or "-") for c in cells):
            rows.append(cells)
    return blocks


def _spoken(text: str | None) -> tuple[str, str, list[int]]:
    """A transcript in one form, its letters and digits folded, and where in that form each of those ends."""
    plain = unicodedata.normalize("NFKC", text or "").strip()
    each = [(c, i) for i, char in enumerate(plain, 1) for c in char.casefold() if c.isalnum()]
    return plain, "".join(c for c, _ in each), [i for _, i in each]


def _nearly(a: str, b: str, ratio: float) -> bool:
    alike = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return alike.quick_ratio() >= ratio and alike.ratio() >= ratio


def strip_repeated_prefix(previous: str | None, text: str | None, least: int = 4, most: int = 120, near: int = 6, ratio: float = 0.92) -> str:
    """A transcript without the starts that repeat the end of the one before, one after another.

    Letters and digits alone are compared, without case: the longest of ``least`` to ``most`` that are equal, or alike by ``ratio`` if there
    are ``near`` or more. The text is in NFKC without blanks at its ends; what separates the repeat from the rest stays with the rest. Nulls count as empty.
    """
    _, ending, _ = _spoken(previous)
    plain, saying, ends = _spoken(text)
    done = 0
    while True:
        rest = saying[done:]
        sizes = range(min(most, len(ending), len(rest)), least - 1, -1)
        size = next((n for n in sizes if ending.endswith(rest[:n]) or (n >= near and _nearly(ending[-n:], rest[:n], ratio))), 0)
        if not size:
            return plain[ends[done - 1] :] if done else plain
        done += size


def remove_boilerplate(text: str | None, noise: list[str], label: str = r"(?i)^(contact|phone|e-?mail|fax)\b") -> dict:
    """The text without noise lines, contact labels and values, lone punctuation, repeats and runs of blanks, with counters."""
    counts = {"noise": 0, "contact": 0, "punctuation": 0, "repeat": 0}
    kept: list[str] = []
    after_label = False
    for line in (re.sub(r"[​-‏⁠﻿]", "", x).rstrip() for x in (text or "").split("\n")):
        plain = line.strip()
        if plain and any(re.search(p, plain) for p in noise):
            counts["noise"] += 1
        elif re.search(label, plain):
            counts["contact"] += 1
            after_label = plain.endswith(":")
            continue
        elif after_label and plain:
            counts["contact"] += 1
        elif plain and not any(c.isalnum() for c in plain):
            counts["punctuation"] += 1
        elif plain and kept and kept[-1].strip() == plain:
            counts["repeat"] += 1
        elif plain or (kept and kept[-1]):
            kept.append(plain and line)
        after_label = False
    return {"text": "\n".join(kept).strip("\n"), **counts}


def collect_ids(document: str | None, keys: tuple[str, ...]) -> list[str]:
    """Values of the keys at any depth of a JSON document, in order, each once; lists may nest."""
    found: dict[str, None] = {}

    def walk(node, wanted: bool) -> None:  # noqa: ANN001
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, k in keys)
        elif isinstance(node, list):
            for v in node:
                walk(v, wanted)
        elif wanted and node is not None:
            found[str(node)] = None

    try:
        walk(json.loads(document or "null"), False)
    except ValueError:
        return []
    return list(found)


def parse_events(chunks: list[str]) -> list[tuple[str, str]]:
    """Server-sent events (event, data) from text cut anywhere."""
    events, name, data = [], "message", []
    for line in "".join(chunks).replace("\r\n", "\n").split("\n"):
        if not line:
            if data:
                events.append((name, "\n".join(data)))
            name, data = "message", []
        elif line.startswith("event:"):
            name = line[6:].strip()
        elif line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))
    return events


def event_milestones(chunks: list[tuple[float, str]]) -> list[tuple[str, str, float]]:
    """(event, data, time) of server-sent events cut anywhere into timed chunks; an event's time is that of the chunk that completes it."""
    out, held = [], ""
    for at, chunk in chunks:
        held = (held + chunk).replace("\r\n", "\n")
        while "\n\n" in held:
            block, held = held.split("\n\n", 1)
            out += [(*e, at) for e in parse_events([block + "\n\n"])]
    return out


_STRINGS = T.ArrayType(T.StringType())
_CLEANED = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("noise", "contact", "punctuation", "repeat"))])
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def sentences(text: Column, size: int, overlap: int) -> Column:
    @F.pandas_udf(_STRINGS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentence_chunks(t, size, overlap))

    return run(text)


def tables(text: Column) -> Column:
    @F.pandas_udf(_STRINGS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(table_blocks)

    return run(text)


def cleaned(text: Column, noise: list[str]) -> Column:
    @F.pandas_udf(_CLEANED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([remove_boilerplate(t, noise) for t in texts], columns=_CLEANED.names)

    return run(text)


def located_in_order(text: Column, parts: Column) -> Column:
    """(start, stop) of each part in the text, each looked for from the end of the last one that was found; null where it is not there."""
    span = "struct<start:int,stop:int>"
    start = F.struct(F.lit(1).alias("cursor"), F.array().cast(f"array<{span}>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        at = F.call_function("locate", part, text, s["cursor"])
        here = F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.char_length(part)).alias("stop")))
        return F.struct(F.when(at > 0, at + F.char_length(part)).otherwise(s["cursor"]).alias("cursor"), F.concat(s["found"], F.array(here)).alias("found"))

    return F.aggregate(parts, start, step, lambda s: s["found"])


def ids_in(document: Column, keys: tuple[str, ...]) -> Column:
    @F.pandas_udf(_STRINGS)
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: collect_ids(d, keys))

    return run(document)


def page_severity(native_tokens: Column, recall: Column, structure_risk: Column) -> Column:
    """severe: 80 tokens or more with recall under 0.65; moderate: 20 or more under 0.88, or fewer with 8 lost, or a structure risk."""
    lost = (1 - recall) * native_tokens
    moderate = ((native_tokens >= 20) & (recall < 0.88)) | ((native_tokens < 20) & (lost >= 8)) | structure_risk
    return F.when((native_tokens >= 80) & (recall < 0.65), "severe").when(moderate, "moderate").otherwise("none")


def trigger_matches(text: Column, triggers: list[str]) -> Column:
    """How many triggers occur: CJK ones as substrings, others at word boundaries."""
    low = F.lower(text)
    hits = [(low.contains(t.lower()) if re.search("[぀-鿿]", t) else low.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(t.lower())}(?![\p{{L}}\p{{N}}])")).cast("int") for t in triggers]
    return sum(hits[1:], hits[0])


def canonical_json(document: Column) -> Column:
    """A JSON text with its keys sorted at every level."""
    return F.to_json(F.try_parse_json(document))


def without_repeated_prefix(previous: Column, text: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(before: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([strip_repeated_prefix(p, t) for p, t in zip(before, texts, strict=True)])

    return run(previous, text)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def labels(path: Column) -> Column:
    """A path's labels in single blanks, without empty ones and without those that repeat the one before."""
    plain = F.filter(F.transform(F.coalesce(path, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    return let(plain, lambda p: F.filter(p, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(p, i - 1)))))


def navigation_path(parent: Column, local: Column, leaf: Column, generic: tuple[str, ...] = ("home", "start")) -> Column:
    """A page's own path, ended by its leaf, joined to the one it was reached by, at the longest end of that which starts it, without case.

    Generic labels at the head go as long as another is left. Nulls count as empty.
    """
    plain_leaf = F.trim(F.regexp_replace(F.coalesce(leaf, F.lit("")), r"(?U)\s+", " "))
    low = lambda x: F.transform(x, F.lower)

    def ended(own: Column, end: Column) -> Column:
        there = (end == "") | F.coalesce(F.lower(F.get(own, F.size(own) - 1)) == F.lower(end), F.lit(False))
        return F.when(there, own).otherwise(F.concat(own, F.array(end)))

    def joined(before: Column, own: Column) -> Column:
        sizes = F.sequence(F.lit(0), F.least(F.size(before), F.size(own)))
        meets = lambda n: F.when(n == 0, True).otherwise(low(F.slice(before, F.size(before) - n + 1, n)) == low(F.slice(own, F.lit(1), n)))
        return labels(F.concat(before, F.slice(own, F.array_max(F.filter(sizes, meets)) + 1, F.size(own))))

    def headed(path: Column) -> Column:
        telling = F.array_position(F.transform(path, lambda x: F.lower(x).isin(*generic)), False)
        first = F.greatest(F.lit(1), F.when(telling == 0, F.size(path)).otherwise(telling)).cast("int")
        return F.slice(path, first, F.size(path))

    own = let(labels(local), lambda x: let(plain_leaf, lambda end: ended(x, end)))
    return let(labels(parent), lambda before: let(own, lambda x: let(joined(before, x), headed)))


_EVENTS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("data", T.StringType()), T.StructField("at", T.DoubleType())]))


@F.pandas_udf(_EVENTS)
def milestones(streams: pd.Series) -> pd.Series:
    """Events of streams of (at, chunk) structs."""
    return streams.map(lambda s: [dict(zip(("name", "data", "at"), e, strict=True)) for e in event_milestones([(c["at"], c["chunk"]) for c in s])])
