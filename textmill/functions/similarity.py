"""Similarities, weights and the anchor state model as Column expressions."""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bigram_counts(text: Column) -> Column:
    """Counts of character bigrams of the letters and digits; of single characters where there is one."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    width = F.when(F.char_length(plain) >= 2, 2).otherwise(1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(plain) - width + 1, F.lit(1))), lambda i: F.substring(plain, i, width))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(grams)


def counted(grams: Column) -> Column:
    distinct = F.array_distinct(grams)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda g: F.size(F.filter(grams, lambda x: x == g)).cast("double")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two count maps; both empty: 1, one empty: 0."""
    dot = _total(F.transform(F.map_entries(a), lambda e: e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0))))
    norm = lambda m: F.sqrt(_total(F.transform(F.map_values(m), lambda x: x * x)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def motive_weights(primary: Column, secondary: Column) -> Column:
    """Alone the primary weighs 1; else 0.7, and 0.3 is shared by at most two secondaries."""
    others = F.slice(F.filter(F.array_distinct(secondary), lambda x: x.isNotNull() & (x != primary)), 1, 2)
    shares = F.map_from_arrays(F.concat(F.array(primary), others), F.concat(F.array(F.lit(0.7)), F.transform(others, lambda _: F.lit(0.3) / F.size(others))))
    return F.when(F.size(others) == 0, F.create_map(primary, F.lit(1.0))).otherwise(shares)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of least over sum of greatest weights."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.struct(F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("low"), F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("high")))
    low, high = _total(F.transform(F.map_values(both), lambda v: v["low"])), _total(F.transform(F.map_values(both), lambda v: v["high"]))
    return F.when(high > 0, low / high).otherwise(1.0)


def trait_similarity(a: list[Column], b: list[Column], gate: float = 35, floor: float = 0.75) -> Column:
    """1 - mean difference / 100, null if a single trait differs by more than the gate or the result is under the floor."""
    gaps = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    score = 1 - sum(gaps[1:], gaps[0]) / (100 * len(gaps))
    return F.when((F.greatest(*gaps) <= gate) & (score >= floor), score)


def mixed_similarity(context: Column, personality: Column, motive: Column, threshold: float = 0.78) -> Column:
    score = 0.55 * context + 0.25 * personality + 0.20 * motive
    return F.when((motive >= 0.5) & personality.isNotNull() & (score >= threshold), score)


def softmax(logits: Column) -> Column:
    """Of an array, shifted by its largest."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda p: p / _total(powers))


def yes_probability(yes: Column, no: Column) -> Column:
    top = F.greatest(yes, no)
    return F.exp(yes - top) / (F.exp(yes - top) + F.exp(no - top))


def bounded_step(value: Column, target: Column, stimulus: Column, most: float = 0.35) -> Column:
    """A step towards the target, at most ``most`` and the stimulus' size, only in the stimulus' direction."""
    step = F.greatest(F.lit(-most), F.least(F.lit(most), target - value))
    budget = F.abs(stimulus)
    aligned = F.when(F.signum(step) == F.signum(stimulus), F.signum(step) * F.least(F.abs(step), budget)).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value + aligned))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1)."""
    width, height = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


@functools.lru_cache(maxsize=4096)
def _bigrams(text: str) -> tuple[Counter, float]:
    plain = "".join(c for c in text.lower() if c.isalnum())
    counts = Counter(map("".join, zip(plain, plain[1:]))) if len(plain) > 1 else Counter([plain] if plain else [])
    return counts, math.sqrt(sum(n * n for n in counts.values()))


def bigram_cosine(a: str | None, b: str | None) -> float:
    """Cosine of two texts' bigram counts; both empty: 1, one empty: 0."""
    (x, m), (y, n) = _bigrams(a or ""), _bigrams(b or "")
    if not x or not y:
        return float(not x and not y)
    if len(y) < len(x):
        x, y = y, x
    return sum(c * y[g] for g, c in x.items() if g in y) / (m * n)


@functools.cache
def _alphanumeric() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of the different bigrams that ``bigram_cosine`` compares, by row and gram, and each row's norm."""
    plain = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(plain)), [len(t) for t in plain])
    stay = _alphanumeric()[codes]
    codes, rows = codes[stay].astype(np.int64), rows[stay]
    size = np.bincount(rows, minlength=len(plain))
    pairs = np.flatnonzero(rows[1:] == rows[:-1])
    alone = np.flatnonzero(size[rows] == 1)
    keys = np.concatenate([rows[pairs] << 42 | codes[pairs] << 21 | codes[pairs + 1], rows[alone] << 42 | codes[alone] << 21 | (1 << 21) - 1])
    keys, counts = np.unique(keys, return_counts=True)
    rows = keys >> 42
    return rows, keys & (1 << 42) - 1, counts, np.sqrt(np.bincount(rows, counts.astype(float) ** 2, len(plain)))


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Like ``map_cosine`` of ``bigram_counts``, in time that grows with the texts, not with their square."""
    return pd.Series([bigram_cosine(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def most_alike(texts: pd.Series, b: pd.Series) -> pd.Series:
    """The largest similarity of any of a list of texts; 0 for none."""
    return pd.Series([max((bigram_cosine(x, y) for x in (xs if xs is not None else [])), default=0.0) for xs, y in zip(texts, b, strict=True)], dtype="float64")
