"""Text, URL and code functions as Column expressions; Arrow functions only where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The query keys that only track, and the words that vote for a language.
TRACKING_KEYS = ["sso", "shownavigation", "locale", "utm_source", "utm_medium", "utm_campaign", "wt_mc"]
GERMAN_WORDS = ["der", "die", "das", "für", "mit", "und", "von", "wir"]
ENGLISH_WORDS = ["and", "for", "of", "the", "to", "we", "with"]


def _fold(value: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", value or "").split()).casefold()


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, case-folded."""
    return texts.map(_fold)


def alphanumeric(text: Column, keep: str = "%") -> Column:
    """Lower-case letters, digits and ``keep``; all else one space."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{re.escape(keep)}]+", " "))


def clean_inline(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), " 　", "  ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[​-‍﻿]", ""), r"\s+", " "))


def compare_form(text: Column, prefixes: list[str]) -> Column:
    """For comparisons: ampersands spelled out, one leading prefix cut, alphanumeric."""
    spelled = alphanumeric(F.replace(text, F.lit("&"), F.lit(" and ")), "")
    return F.trim(F.regexp_replace(spelled, "^(" + "|".join(map(re.escape, prefixes)) + ") ", ""))


_URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_PLAIN_CLEAN = "[\u200b-\u200d\ufeff]"


def url_parts(url: Column) -> list[Column]:
    """Scheme, authority, path and query of an absolute or relative URL, empty where there is none."""
    return [F.regexp_extract(url, _URL_PARTS, i) for i in range(1, 5)]


def join_url(base: Column, href: Column) -> Column:
    """``href`` as seen from the page ``base``: absolute, of the same scheme, of the same host, a query, or relative to the page's folder."""
    scheme, host, path, _ = url_parts(base)
    to_scheme, to_host, to_path, query = url_parts(href)
    folder = F.regexp_extract(path, "^(.*/)", 1)
    steps = F.split(F.when(to_path.startswith("/"), to_path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), to_path)), "/")
    ends_in_dots = F.element_at(steps, -1).isin(".", "..")
    walked = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    there = F.concat(F.array_join(walked, "/"), F.when(ends_in_dots, "/").otherwise(""))
    asked = F.when(href.contains("?"), F.concat(F.lit("?"), query)).otherwise("")
    return (
        F.when(to_scheme != "", href).when(to_host != "", F.concat(scheme, F.lit(":"), href))
        .when(to_path == "", F.concat(scheme, F.lit("://"), host, path, asked)).otherwise(F.concat(scheme, F.lit("://"), host, there, asked))
    )


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encoded(text: Column) -> Column:
    """Percent-encoded but for letters, digits and _.-~; a space is a plus."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, base: Column | None = None, hosts: dict[str, str] | None = None) -> Column:
    """https, lower-case host, no port but 443, no fragment, slashes collapsed, decoded query pairs sorted without tracking keys; else null.

    Zero-width characters go; a relative URL is joined to ``base``; ``hosts`` names aliases of hosts.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), _PLAIN_CLEAN, ""), r"\s+", " "))
    whole = clean if base is None else join_url(base, clean)
    scheme, authority, path, query = url_parts(whole)
    named = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    for alias, host in (hosts or {}).items():
        named = F.when(named == alias, host).otherwise(named)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(F.regexp_extract(x, "=(.*)$", 1)).alias("v")))
    items = F.transform(F.array_sort(F.filter(pairs, lambda x: ~F.lower(x["k"]).isin(TRACKING_KEYS))), lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"])))
    way = F.regexp_replace(F.regexp_replace(F.trim(path), "/{2,}", "/"), "/+$", "")
    joined = F.concat(F.lit("https://"), named, F.when(way == "", "/").otherwise(way), F.when(F.size(items) > 0, F.concat(F.lit("?"), F.array_join(items, "&"))).otherwise(""))
    skipped = clean.rlike("(?i)^(#|javascript:|mailto:|tel:|data:)") | (clean == "")
    return F.when(~skipped & F.lower(scheme).isin("http", "https") & (named != "") & port.isin("", "443"), joined)


def unique_rule_match(text: Column, rules: dict[str, str]) -> Column:
    """The one rule that matches; none or several give an empty string."""
    hits = F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in rules.items())), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 1, hits[0]).otherwise("")


def path_parts(text: Column, separator: str = r"\s*>\s*") -> Column:
    return F.filter(F.transform(F.split(clean_inline(text), separator), clean_inline), lambda x: x != "")


def level(parts: Column, i: int, levels: int, joiner: str = " > ") -> Column:
    """Level i (0-based) of a path; the last one takes all that is left."""
    if i < levels - 1:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return F.when(F.size(parts) >= levels, F.array_join(F.slice(parts, F.lit(levels), F.greatest(F.size(parts) - (levels - 1), F.lit(1))), joiner)).otherwise("")


def keyword_topic(text: Column, tiers: list[dict[str, list[str]]], default: str) -> Column:
    """The first topic, tier by tier, one of whose keywords is contained."""
    chain = F.lit(default)
    for tier in reversed(tiers):
        for topic, keywords in reversed(tier.items()):
            found = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(text), k))
            chain = F.when(found, topic).otherwise(chain)
    return chain


def business_codes(text: Column) -> Column:
    """Distinct codes such as C/HR3-AP, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{1,4}(?:/[A-Z0-9]{1,6})+(?:-[A-Z0-9]{1,4})*\b"), F.lit(0)))


def code_alias(code: Column) -> Column:
    return F.regexp_replace(code, "[^A-Za-z0-9]", "")


def contains_term(text: Column, term: str) -> Column:
    """Short terms, and those with %, need word boundaries; others may stand anywhere. Empty terms never match."""
    needle = re.sub(r"[^\w%]+", " ", term.lower()).strip()
    if not needle:
        return F.lit(False)
    if re.fullmatch(r"[a-z0-9%]+", needle) and (len(needle.replace("%", "")) <= 4 or "%" in needle):
        return text.rlike(f"(?<![a-z0-9]){re.escape(needle)}(?![a-z0-9])")
    return text.contains(needle)


def hard_chunks(text: Column, size: int) -> Column:
    """Stripped pieces of ``size`` characters, blanks left out."""
    whole = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(whole), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.regexp_replace(F.substring(whole, i, F.lit(size)), r"^\s+|\s+$", "")), lambda x: x != "")


def merge_chunks(text: str | None, size: int, overlap: int) -> list[str]:
    """Blank-line pieces joined up to ``size``; on overflow the next chunk starts with the last ``overlap`` characters if they fit."""
    overlap, chunks, current = max(0, min(overlap, size // 2)), [], ""

    def hard(x: str) -> list[str]:
        return [y for i in range(0, len(x), size) if (y := x[i : i + size].strip())]

    for piece in filter(None, (p.strip() for p in re.split(r"\n\s*\n|\n", text or ""))):
        joined = f"{current}\n{piece}" if current else piece
        if not current or len(joined) <= size:
            current = joined
            continue
        chunks += hard(current)
        tail = current[-overlap:].strip() if overlap else ""
        joined = f"{tail}\n{piece}" if tail else piece
        current = joined if len(joined) <= size else piece
    return chunks + (hard(current) if current else [])


def chunks(text: Column, size: int, overlap: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: merge_chunks(t, size, overlap))

    return run(text)


class _Page(HTMLParser):
    """Title, language, visible text, links and table rows of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.language, self.texts, self.links, self.rows = "", "", [], [], []
        self._hidden, self._in_title, self._cell = 0, False, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        if tag == "html":
            self.language = values.get("lang") or ""
        elif tag in ("script", "style", "noscript"):
            self._hidden += 1
        elif tag == "title":
            self._in_title = True
        elif tag == "a" and values.get("href"):
            self.links.append(values["href"])
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
            self._cell = True
        elif tag == "br" and self._cell:
            self.rows[-1][-1] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript"):
            self._hidden = max(0, self._hidden - 1)
        elif tag == "title":
            self._in_title = False
        elif tag in ("td", "th"):
            self._cell = None

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        elif not self._hidden:
            if self._cell:
                self.rows[-1][-1] += data
            self.texts.append(data)


def read_page(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    rows = [[" ".join(c.split()) for c in r] for r in page.rows]
    return {
        "title": " ".join(page.title.split()), "language": page.language, "content": " ".join(" ".join(page.texts).split()), "links": page.links,
        "tables": "\n".join(" | ".join(r) for r in rows if any(r)),
    }


_PAGE = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType()) if n == "links" else T.StringType()) for n in ("title", "language", "content", "links", "tables")]
)


@F.pandas_udf(_PAGE)
def parse_html(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=["title", "language", "content", "links", "tables"])


def detect_language(text: Column) -> Column:
    """zh by script, else stop words vote between German and English."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    german, english = F.size(F.filter(found, lambda w: w.isin(GERMAN_WORDS))), F.size(F.filter(found, lambda w: w.isin(ENGLISH_WORDS)))
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").when(text.rlike("[㐀-鿿]"), "zh").when(german > english, "de").when(english > 0, "en").otherwise("unknown")


def script_counts(text: Column) -> Column:
    return F.struct(F.regexp_count(text, F.lit("[぀-ヿ]")).alias("kana"), F.regexp_count(text, F.lit("[一-鿿]")).alias("han"), F.regexp_count(text, F.lit("[A-Za-z]")).alias("latin"))


def negated(prefix: Column, operators: str) -> Column:
    """An odd number of negating operators in a cue's clause negates it."""
    return F.regexp_count(prefix, F.lit(operators)) % 2 == 1


def cue_prefixes(text: Column, cue: str, boundaries: str, window: int) -> Column:
    """For each place of a cue, what stands before it in its clause, at most ``window`` characters."""
    near, far = f"(?<=(?:^|[{boundaries}])([^{boundaries}]{{0,{window - 1}}}))", f"(?<=([^{boundaries}]{{{window}}}))"
    parts = [F.regexp_extract_all(text, F.lit(f"(?={cue})(?:{near}|{far}){cue}"), F.lit(i)) for i in (1, 2)]
    # where the second way matches, the first group can hold what was tried before
    return F.zip_with(*parts, lambda a, b: F.when(b != "", b).otherwise(a))


def excel_date(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,;、，；\n]"), lambda x: F.trim(x)), lambda x: x != "")


def parse_rate(rule: Column, limit: int, window: int) -> Column:
    """``5/minute`` -> (limit, window_seconds), with defaults for anything else."""
    pattern = r"^\s*(\d+)\s*/\s*(minute|hour|second|m|h|s)\s*$"
    unit = F.substring(F.regexp_extract(rule, pattern, 2), 1, 1)
    ok = rule.rlike(pattern)
    return F.struct(
        F.when(ok, F.greatest(F.regexp_extract(rule, pattern, 1).try_cast("int"), F.lit(1))).otherwise(limit).alias("limit"),
        F.when(ok, F.when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)).otherwise(window).alias("window_seconds"),
    )


def estimate_tokens(text: Column) -> Column:
    n = F.char_length(F.trim(text))
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4))).otherwise(0).cast("long")


def escape_cell(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def excel_cell(text: Column, most: int = 32767, marker: str = " [truncated]") -> Column:
    clean = escape_cell(F.regexp_replace(text, "[\u0000-\u0008\u000b\u000c\u000e-\u001f]", ""))
    return F.when(F.char_length(clean) > most, F.concat(F.substring(clean, 1, most - len(marker)), F.lit(marker))).otherwise(clean)


def image_references(markdown: Column) -> Column:
    found = F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[?#].*$", "")), lambda x: ~F.lower(x).rlike("^(data:|https?:)"))


def url_identity(url: Column, folded: list[str]) -> Column:
    """The canonical URL without the query keys that only choose a view of one page."""
    canonical = canonical_url(url)
    keys = "|".join(map(re.escape, folded))
    return F.regexp_replace(F.regexp_replace(canonical, rf"(?<=[?&])({keys})=[^&]*&?", ""), "[?&]$", "")


def query_terms(text: Column, expansions: dict[str, list[str]]) -> Column:
    """The distinct words in order, then what they expand to."""
    said = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    table = F.create_map(*(x for k, v in expansions.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    more = F.flatten(F.transform(said, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(said, more))


def context_label(parts: dict[str, Column]) -> Column:
    """``name: value`` for each part that is not empty, one a line."""
    return F.concat_ws("\n", *(F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in parts.items()))


def rating_label(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)\brating\s*[:=]\s*([a-e][+-]?)", 1)), F.lit(""))
