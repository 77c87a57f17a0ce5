"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import prepare, rows_of, text_bytes, tidy

FEATURES = 4096
PER_LANGUAGE = 400  # the bound of the training sample: so many documents of each language, about
MOST_LANGUAGES = 200  # the bound of the label set: the most frequent labels, so that a column of free text cannot fill the driver
UNKNOWN = "und"
PIECE = 1 << 20

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca es fr gl it la lmo oc pt rm ro sc scn wa",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tr tt ug uz",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "austronesian": "ceb id jv mg mi ms su tl",
    "sinitic": "wuu yue zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_BLANK = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0], "other")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """Square roots of hashed counts of byte bigrams and trigrams over letters only, of length one; the last is a bias."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split()) + b" "
    counts = np.zeros(FEATURES, np.float64)
    for at in range(0, len(data), PIECE):
        b = np.frombuffer(data[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        two = (b[:-1] << np.uint32(8)) | b[1:]
        three = (two[:-1] << np.uint32(8)) | b[2:]
        for gram, factor in ((two, 2654435769), (three, 2246822519)):
            counts += np.bincount((gram * np.uint32(factor)) >> np.uint32(20), minlength=FEATURES)
    x = np.sqrt(counts, dtype=np.float64)
    x /= np.sqrt(x @ x) or 1.0
    return np.append(x, 0.3)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 8.0, epochs: int = 40) -> np.ndarray:
    """Weights of an L2-regularised squared-hinge SVM by dual coordinate descent; y is +1 or -1."""
    w, alpha, diagonal = np.zeros(x.shape[1]), np.zeros(len(y)), 1 / (2 * c)
    norms = (x * x).sum(axis=1) + diagonal
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            step = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + diagonal * alpha[i]) / norms[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


@dataclass
class LanguageModel:
    """Pairs of classes with one weight vector each: between families, and between the languages of a family."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def _choose(self, names: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        wins = {a: (sum((m > 0) if x == a else (m <= 0) for (x, y), m in margins.items() if a in (x, y) and {x, y} <= set(names)), sum(m if x == a else -m for (x, y), m in margins.items() if a in (x, y) and {x, y} <= set(names))) for a in names}
        best = max(names, key=lambda a: (wins[a], a))
        least = min((m if x == best else -m for (x, y), m in margins.items() if best in (x, y) and {x, y} <= set(names)), default=4.0)
        return best, 1 / (1 + float(np.exp(-2 * least)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        margins = dict(zip(self.pairs, (self.weights @ features(text)).tolist(), strict=True)) if self.pairs else {}
        family, sure = self._choose([f"family {f}" for f in self.families], margins)
        lang, within = self._choose(self.families[family.removeprefix("family ")], margins)
        return lang, min(sure, within)


def train(langs: list[str], x: np.ndarray) -> LanguageModel:
    names = np.array(langs)
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    group = np.array([f"family {family_of(lang)}" for lang in langs])
    tasks = [(group, a, b) for a, b in itertools.combinations(sorted({f"family {f}" for f in families}), 2)]
    tasks += [(names, a, b) for inside in families.values() for a, b in itertools.combinations(inside, 2)]
    weights = []
    for of, a, b in tasks:
        rows = np.flatnonzero((of == a) | (of == b))
        weights.append(linear_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0)))
    return LanguageModel(families, [(a, b) for _, a, b in tasks], np.array(weights).reshape(len(tasks), FEATURES + 1))


@tidy
def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, langs, found = [], [], []
        for first, texts in rows_of(batch, 2):
            for i, t in enumerate(texts):
                text = t.decode("utf-8", "replace")
                if has_letter(text):
                    ids.append(first + i)
                    langs.append(batch.column(1)[first + i].as_py())
                    found.append(features(text).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["id", "lang", "x"])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is never learned from; a null id is not held out, and is not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES
) -> LanguageModel:
    """Learn from a bounded sample of the labelled rows that are not held out.

    The ``most_languages`` most frequent labels are learned (then the smaller ones). Of a language with n such rows, those whose id
    hashes into the first per_language / n of the range are taken, so the driver receives about ``per_language`` vectors of fixed
    size for each language, whatever the input.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    usable = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return LanguageModel({}, [], np.zeros((0, FEATURES + 1)))
    shares = spark.createDataFrame([(r.lang, int(min(1.0, per_language / r.n) * (1 << 30))) for r in counts], "lang string, share long")
    # a row a language, MOST_LANGUAGES at most
    picked = usable.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share")).select("id", "lang", text_bytes("text").alias("text"))
    rows = sorted(picked.mapInArrow(_sample, "id long, lang string, x binary").collect(), key=lambda r: (r.id, r.lang, r.x))
    if not rows:
        return LanguageModel({}, [], np.zeros((0, FEATURES + 1)))
    return train([r.lang for r in rows], np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64))


def _predict(shared) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(None if t is None else t.decode("utf-8", "replace")) for _, texts in rows_of(batch, 1) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["row", "lang_pred", "score"])

    return tidy(run)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of each row as struct ``row``, with ``lang_pred`` and ``score`` (the least sure decision, 0 to 1).

    Only the text is looked at, all of it. Null texts, and texts without a letter, are ``und`` with score 0, as is
    everything when nothing could be learned. No shuffle; memory is one batch. Columns may have any names.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    out = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(shared), out)


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language can be told, unchanged. Where nothing could be learned, those with a letter."""
    model = fit(docs, id_col, text_col, lang_col)
    if not model.families:
        return docs.where(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"))
    return identify(docs, model, text_col).where(F.col("lang_pred") != UNKNOWN).select("row.*")
