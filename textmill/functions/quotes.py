"""Quotes found in texts whatever their case, width, white space and punctuation, with spans of the original text.

Texts are folded with a map back to their own offsets, so what is found is always a literal part of the text. Nothing but formatting
may differ: a changed, left out or moved letter or digit is no match.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT = "+#"  # kept besides letters and digits
MANY = 8  # so many quotes of one text are looked for in one pass
QUOTES = 256  # quotes of one text that one task's row holds
BROADCAST_SOURCES = 100_000
CONTEXT = 900


class _Folds(dict):
    """Code point -> what it is compared as, worked out once for each."""

    def __missing__(self, code: int) -> str:
        wide = unicodedata.normalize("NFKC", chr(code)).casefold()
        self[code] = "".join(c for c in wide if c.isalnum() or c in KEPT)
        return self[code]


FOLDS = _Folds()


class Folded:
    """A text, its folded form, and for each folded character where it comes from."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.key = text.translate(FOLDS)

    @cached_property
    def origin(self) -> np.ndarray:
        codes, which = np.unique(np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        widths = np.array([len(FOLDS[c]) for c in codes.tolist()], np.int64)[which]
        return np.repeat(np.arange(len(self.text)), widths)

    def span(self, at: int, size: int) -> tuple[int, int]:
        """The part of the text whose folded form is ``size`` characters from ``at``."""
        return int(self.origin[at]), int(self.origin[at + size - 1]) + 1


def _firsts(text: str, wanted: set[str]) -> dict[str, int]:
    """Where each wanted string first occurs; many of them are found by one automaton."""
    if len(wanted) < MANY:
        return {w: at for w in wanted if (at := text.find(w)) >= 0}
    import ahocorasick

    automaton, found = ahocorasick.Automaton(), {}
    for w in wanted:
        automaton.add_word(w, w)
    automaton.make_automaton()
    for end, w in automaton.iter(text):
        if w not in found:
            found[w] = end - len(w) + 1
            if len(found) == len(wanted):
                break
    return found


def find_quotes(text: str | None, quotes: list[str | None]) -> list[tuple[int, int] | None]:
    """The span of each quote in the text: its first literal occurrence, else the first with the same folded form.

    Null and empty quotes, those without a letter or digit that do not occur literally, and all quotes of a null text have none.
    """
    literal = _firsts(text, {q for q in quotes if q}) if text else {}
    rest = {q: q.translate(FOLDS) for q in quotes if q and q not in literal}
    folded = Folded(text or "")
    keyed = _firsts(folded.key, {k for k in rest.values() if k}) if rest else {}
    out: list[tuple[int, int] | None] = []
    for q in quotes:
        if q in literal:
            out.append((literal[q], literal[q] + len(q)))
        elif q in rest and rest[q] in keyed:
            out.append(folded.span(keyed[rest[q]], len(rest[q])))
        else:
            out.append(None)
    return out


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(T.ArrayType(SPAN))
def spans_of(texts: pd.Series, quotes: pd.Series) -> pd.Series:
    """Spans of lists of quotes in their texts."""
    found = (find_quotes(t, list(q)) for t, q in zip(texts, quotes, strict=True))
    return pd.Series([[None if s is None else {"start": s[0], "end": s[1]} for s in spans] for spans in found])


def located(text: Column, quote: Column) -> Column:
    """The span of one quote in a text of the same row."""
    return F.get(spans_of(text, F.array(quote)), F.lit(0))


@F.pandas_udf(T.StringType())
def comparable(texts: pd.Series) -> pd.Series:
    """What is compared of a text: its letters, digits, plus and number signs, folded."""
    return texts.map(lambda t: None if t is None else t.translate(FOLDS))


def span_text(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def locate(requests: DataFrame, texts: DataFrame, source: str, quote: str, text: str, name: str = "span") -> DataFrame:
    """``requests`` with ``name``: (known, start, end, text) of their quote in the text of their source.

    A source's quotes are brought together, at most QUOTES in a row, so its text is folded and searched once for
    all of them; a source with more has as many rows as it needs, none of which grows with it. ``known`` says whether the
    source is there. Sources have one row each; requests may repeat, and keep nulls.
    """
    counts = requests.groupBy(source).agg(F.count("*").alias("_n")).where(F.col("_n") > QUOTES)
    popular = counts.select(F.col(source).alias("_popular"), F.ceil(F.col("_n") / QUOTES).cast("int").alias("_parts"))
    popular = F.broadcast(popular) if popular.count() <= BROADCAST_SOURCES else popular
    packed = requests.select(F.struct(*(F.col(f"`{c}`") for c in requests.columns)).alias("_row"), F.col(source).alias("_source"), F.col(quote).alias("_quote"))
    packed = packed.join(popular, F.col("_source").eqNullSafe(F.col("_popular")), "left")
    part = F.pmod(F.xxhash64("_row"), F.coalesce("_parts", F.lit(1))).cast("int")
    groups = packed.groupBy("_source", part.alias("_part")).agg(F.collect_list(F.struct("_row", "_quote")).alias("_asked"))
    known = texts.select(F.col(source).alias("_there"), F.col(text).alias("_text"))
    joined = groups.join(known, F.col("_source") == F.col("_there"), "left")
    joined = joined.withColumn("_spans", spans_of("_text", F.transform("_asked", lambda a: a["_quote"])))
    each = joined.select("_text", F.col("_there").isNotNull().alias("_known"), F.explode(F.arrays_zip("_asked", "_spans")).alias("_x"))
    span = F.col("_x._spans")
    return each.select("_x._asked._row.*", F.struct(F.col("_known").alias("known"), span["start"].alias("start"), span["end"].alias("end"), span_text(F.col("_text"), span).alias("text")).alias(name))


# --- context of a quote

_HEADING = re.compile(r"[ \t]*(?:#{1,6}[ \t]+\S.*|(?![-*+][ \t]|\d+[.)、])[^\n]{0,79}[:：])[ \t]*")


def _lines(text: str) -> tuple[list[str], list[int]]:
    """Lines and the offsets they begin at."""
    parts = text.splitlines(keepends=True)
    return [p.strip() for p in parts], [0, *np.cumsum([len(p) for p in parts]).tolist()][: len(parts)]


def quote_context(source: str | None, quote: str | None, codes: re.Pattern | None = None, most: int = CONTEXT) -> str:
    """What a reader needs around a quote: its lines, the heading of their section, and the line that follows in it, else the one before.

    Parts are a blank line apart. A neighbour that names a code (``codes``) which the quote does not is left out. A quote that is not there
    stands for itself. Longer contexts are cut around the quote, to ``most`` characters with an ellipsis at each cut end. Nulls count as empty.
    """
    source, quote = source or "", quote or ""
    span = find_quotes(source, [quote])[0]
    if span is None:
        return _cut(quote, quote, most)
    lines, begins = _lines(source)
    first, last = (bisect.bisect_right(begins, x) - 1 for x in (span[0], max(span[0], span[1] - 1)))
    heads = [i for i, x in enumerate(lines) if x and _HEADING.fullmatch(x)]
    before, after = bisect.bisect_right(heads, first), bisect.bisect_right(heads, last)
    head = heads[before - 1] if before else None
    stop = heads[after] if after < len(heads) else len(lines)
    named = lambda x: {m.group().upper() for m in codes.finditer(unicodedata.normalize("NFKC", x))} if codes else set()
    mine = named(quote)

    def neighbour(candidates: range) -> list[int]:
        near = next((i for i in candidates if lines[i]), None)
        return [] if near is None or (mine and named(lines[near]) - mine) else [near]

    follows = neighbour(range(last + 1, stop))
    leads = [] if follows else neighbour(range(first - 1, -1 if head is None else head, -1))
    chosen = sorted({*([] if head is None else [head]), *leads, *range(first, last + 1), *follows})
    return _cut("\n\n".join(lines[i] for i in chosen if lines[i]), quote, most)


def _cut(context: str, quote: str, most: int) -> str:
    if len(context) <= most:
        return context
    room = most - 2  # for the ellipses
    low = min(max(0, max(0, context.find(quote)) - room // 3), len(context) - room)
    return "…" * (low > 0) + context[low : low + room].strip() + "…" * (low + room < len(context))


def context_of(source: Column, quote: Column, codes: str | None = None, most: int = CONTEXT) -> Column:
    pattern = re.compile(codes) if codes else None

    @F.pandas_udf(T.StringType())
    def run(sources: pd.Series, quotes: pd.Series) -> pd.Series:
        return pd.Series([quote_context(s, q, pattern, most) for s, q in zip(sources, quotes, strict=True)])

    return run(source, quote)
