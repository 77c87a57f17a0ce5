"""License scans: TF-IDF cosine of lines, headers and whole files to templates, then inheritance from the nearest ancestor directory.

Built from DataFrame and SQL functions only.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import materialize
from textmill.llm.decontamination import words

COSINE = 0.6
NEAR = 0.02  # among templates within so much of the best cosine the least distance decides, so that words which one of them lacks count
TAG = r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9.+-]+(?:\)?[ \t]+(?:OR|AND|WITH)[ \t]+\(?[A-Za-z0-9.+-]+)*\)?)"
TAG_SUFFIX = r"^([A-Za-z0-9.-]+?)(-only|-or-later|\+)$"
FILE_SHARE = 0.5  # a file is a licence file if so many of its words stand in license lines, or by its name
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
BROADCAST_DIRECTORIES = 100_000
BROADCAST_TERMS = 500_000

# Short notices by SPDX id.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted (BSD 3-Clause License).",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


# The headers that licences ask for, and the first lines of their texts, by SPDX id.
_GNU = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see https://www.gnu.org/licenses/."
_CREATIVE = [("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike")]
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((f"{short}-{n if '.' in n else n + '.0'}", text) for short, name, versions in (("GPL", "", "23"), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", "3")) for n in versions for text in (_GNU.format(":", name, n), _GNU.format(":", name, n) + _WARRANTY.format(name))),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    *((f"CC-{k.upper()}-4.0", f"This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{k}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.")
      for k, name in _CREATIVE),
    *((f"CC-{k.upper()}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in _CREATIVE[1:]),
]
TEXTS = Path(__file__).parent / "licenses"  # full texts, by SPDX id


def all_templates() -> list[tuple[str, str]]:
    """(license, text): short notices, headers and full texts."""
    return [*TEMPLATES.items(), *HEADERS, *((p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt")))]


def template_terms(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(templates)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(words("text")).alias("term")).groupBy("template", "license", "term").agg(term_weight(F.count("*")).alias("tf"))


def pieces(text: str) -> Column:
    """(kind, text) of what is compared in a text: each line and, where they differ from it, the sentences in lines, the blocks between blank lines, the leading comment and the whole text."""
    whole = F.col(text)
    marks = r"[ \t]*(?:#|//|/\*|\*|--|;|%|<!--|'|\"\"\").*"
    lines = F.split(whole, "\n", -1)
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?;:])\s+", -1)))
    # a line of marks only is as good as a blank one
    blocks = F.filter(F.split(whole, r"\n(?:[^\p{L}\p{N}\n]*\n)+", -1), lambda x: F.contains(x, F.lit("\n")))
    leading = F.array(F.regexp_extract(whole, rf"^(?:(?:{marks})?\n)*(?:{marks})?", 0))
    kinds = (("line", lines), ("sentence", F.array_except(sentences, lines)), ("block", F.array_union(blocks, F.filter(leading, lambda x: F.contains(x, F.lit("\n"))))), ("file", F.filter(F.array(whole), lambda x: F.contains(x, F.lit("\n")))))

    def named(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))

    return F.flatten(F.array(*(named(*k) for k in kinds)))


def term_counts(files: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(term, n): how many of all files hold each of the terms; they are broadcast only after they were counted."""
    wanted = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    held = files.select(F.explode(F.array_distinct(words(text_col))).alias("term")).join(wanted, "term", "left_semi")
    return wanted.join(held.groupBy("term").agg(F.count("*").alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def term_weight(n: Column) -> Column:
    """What a term that occurs n times counts for: 1 + ln n, so that common words do not fill the vectors of long texts."""
    return F.log(n) + 1


def weight(n: Column, files: int) -> Column:
    """The squared idf of a term that n of the files hold."""
    return F.pow(F.log(F.lit(files + 1) / (n + 1)) + 1, 2)


def signal_terms(templates: dict[tuple[int, str], dict[str, float]], share: float, weights: dict[str, float]) -> list[str]:
    """Terms of which a text needs at least one: all others of any template together weigh less than ``share`` of its squared norm.

    ``weights`` has the squared idf of each term: the words of most files are left out first, so that as few files as can be hold a signal.
    """
    left, signal = {k: share * sum(t.values()) for k, t in templates.items()}, []
    heaviest: dict[str, float] = {}
    for t in templates.values():
        for term, w in t.items():
            heaviest[term] = max(w, heaviest.get(term, 0.0))
    for term in sorted(heaviest, key=lambda t: (weights[t], heaviest[t], t)):
        inside = [k for k, t in templates.items() if term in t]
        if all(left[k] - templates[k][term] > 1e-9 for k in inside):
            for k in inside:
                left[k] -= templates[k][term]
        else:
            signal.append(term)
    return signal


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def license_pieces(files: DataFrame, id_col: str, text_col: str, templates: list[tuple[str, str]], cosine: float) -> DataFrame:
    """(id, kind, license, cosine, words): the best license of each piece of a text that reaches ``cosine``.

    Pieces and templates are vectors of lower-case words, each with 1 + ln of how often it occurs there times its idf, with document
    frequencies over all files. A piece is at least as long as its part on a template's words, so a cosine of c with the template needs
    a cosine of c from that part alone, and words that carry c of the template's length. What is below that is left out before
    frequencies are counted for all words of the other pieces; none that could reach the threshold is lost.
    """
    spark = files.sparkSession
    files = files.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    n_files, least = files.count(), (cosine - 1e-6) ** 2  # cosines are rounded to six digits
    terms = template_terms(spark, templates)
    counts = term_counts(files, terms.select("term").distinct(), "text").select("term", weight(F.col("n"), n_files).alias("w"))
    weighed: dict[tuple[int, str], dict[str, float]] = {}
    rows = terms.join(counts, "term").collect()  # one row for each term of each template: a fixed table
    for r in rows:
        weighed.setdefault((r.template, r.license), {})[r.term] = r.tf**2 * r.w
    products = F.broadcast(spark.createDataFrame([(r.template, r.license, sum(weighed[r.template, r.license].values()), r.term, float(r.tf), r.w) for r in rows], "template int, license string, norm double, term string, tf_there double, w double"))
    signal = signal_terms(weighed, least, {r.term: r.w for r in rows})
    near = files.where(F.exists(words("text"), lambda t: t.isin(signal))).select("id", F.explode(pieces("text")).alias("piece"))
    found = near.select("id", "piece.kind", words("piece.text").alias("all")).where(F.exists("all", lambda t: t.isin(signal)))
    # lines count by their different words, as they are added up
    found = found.select("id", "kind", F.size(F.when(F.col("kind") == "line", F.array_distinct("all")).otherwise(F.col("all"))).alias("words"), "all", F.monotonically_increasing_id().alias("unit"))
    found = materialize(found, "license-candidates")

    def each(units: DataFrame) -> DataFrame:
        exploded = units.select("unit", "id", "kind", "words", F.explode("all").alias("term"))
        return exploded.groupBy("unit", "id", "kind", "words", "term").agg(term_weight(F.count("*")).alias("tf"))

    # dealt by unit once, so that neither the words of a piece nor its templates are shuffled
    on_template = each(found.repartition("unit")).join(products, "term").groupBy("unit", "template", "license", "norm").agg(F.sum(F.col("tf") * F.col("tf_there") * F.col("w")).alias("dot"), F.sum(F.col("tf") ** 2 * F.col("w")).alias("part"))
    dots = materialize(on_template.where(F.col("dot") ** 2 >= least * F.col("part") * F.col("norm") * (1 - 1e-9)).drop("part"), "license-products")
    live = materialize(each(found.join(dots.select("unit").distinct(), "unit", "left_semi").repartition("unit")), "license-terms")
    held = term_counts(files, live.select("term").distinct(), "text")
    totals = live.join(held, "term").groupBy("unit", "id", "kind", "words").agg(F.sum(F.col("tf") ** 2 * weight(F.col("n"), n_files)).alias("total"))
    scored = dots.join(totals, "unit").withColumn("cosine", F.round(F.col("dot") / F.sqrt(F.col("total") * F.col("norm")), 6)).where(F.col("cosine") >= cosine)
    rivals = F.collect_list(F.struct(F.round(F.col("norm") - 2 * F.col("dot"), 6).alias("distance"), "license", "cosine"))  # a template each at most
    best = scored.groupBy("unit", "id", "kind", "words").agg(F.max("cosine").alias("top"), rivals.alias("rivals"))
    best = best.select("id", "kind", "words", F.array_min(F.filter("rivals", lambda r: r["cosine"] >= F.round(F.col("top") - NEAR, 6))).alias("best"))
    return best.select("id", "kind", "best.license", "best.cosine", "words").unionByName(tagged(files))


def tagged(files: DataFrame) -> DataFrame:
    """The same columns for every SPDX tag of a text: exact, whatever else stands there. An identifier alone is given without
    ``-only``, ``-or-later`` or ``+``, an expression as it is."""
    held = files.where(F.contains("text", F.lit("SPDX-License-Identifier:"))).select("id", F.explode(F.regexp_extract_all("text", F.lit(TAG), F.lit(1))).alias("said"))
    return held.select("id", F.lit("tag").alias("kind"), F.regexp_replace("said", TAG_SUFFIX, "$1").alias("license"), F.lit(1.0).alias("cosine"), (F.size(F.array_distinct(words("said"))) + 3).alias("words"))


def scan(
    files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, cosine: float = COSINE
) -> DataFrame:
    """(id, path, license, cosine, found, directory) for each row: its own license, or that of the nearest ancestor directory.

    Every line, sentence and block of every whole text, its leading comment and the text itself are compared with notices,
    headers and full texts. A file's own license is that of its best piece (then an SPDX tag, which is exact, then the smaller SPDX id); where templates
    are within NEAR of a piece's best cosine, that at the least distance is the piece's, which tells licences apart that differ in a few words. A licence
    file, by its name or because FILE_SHARE of its words stand in license lines or in one longer piece, sets the license of its directory (the best
    cosine, then license, then path); files without one inherit it from the nearest directory above them. ``found`` is
    ``own``, ``inherited`` or null.

    Null and empty texts and null paths have no own license or directory; rows with null ids are returned without a
    license; rows that share an id are one file. Directories' licenses are broadcast only after they were counted.
    Columns may have any names. An empty table gives an empty result.
    """
    known = files.select(F.col(f"`{id_col}`").cast("long").alias("id"), path.alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    real = known.where(F.col("id").isNotNull())
    found = materialize(license_pieces(real.select("id", "text"), "id", "text", list(templates.items()) if templates else all_templates(), cosine), "license-pieces")
    lines, longer = (F.coalesce(f(F.when((F.col("kind") == "line") == is_line, F.col("words"))), F.lit(0)) for f, is_line in ((F.sum, True), (F.max, False)))
    first = F.min(F.struct((-F.col("cosine")).alias("less"), (F.col("kind") != "tag").alias("guess"), "license"))
    own = found.groupBy("id").agg(first.alias("best"), F.greatest(lines, longer).alias("in_license"))
    own = materialize(own.select("id", "best.license", (-F.col("best.less")).alias("cosine"), "in_license"), "own-licenses")
    holders = real.join(own, "id").withColumn("share", F.col("in_license") / F.greatest(F.size(words("text")), F.lit(1)))
    directories = materialize(
        holders.where((F.col("share") >= FILE_SHARE) | F.col("path").rlike(FILE_NAME)).where(F.col("path").isNotNull())
        .groupBy(parent(F.col("path")).alias("directory"))
        .agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license", "path")).alias("best"))
        .select("directory", "best.license", (-F.col("best.less")).alias("cosine")),
        "license-directories",
    )
    small = directories.count() <= BROADCAST_DIRECTORIES
    files_only = known.select("id", "path")
    mine = files_only.join(own.select("id", "license", "cosine"), "id", "left")
    bare = mine.where("license is null and id is not null").select("id", "path").distinct()
    parts = F.split("path", "/")
    above = bare.where(F.col("path").isNotNull()).select(
        "id", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("directory")))).alias("up")
    ).select("id", "path", "up.*")
    inherited = (
        above.join(F.broadcast(directories) if small else directories, "directory")
        .groupBy("id", "path").agg(F.max(F.struct("depth", "directory", "license", "cosine")).alias("near")).select("id", "path", "near.directory", F.col("near.license").alias("above"), F.col("near.cosine").alias("above_cosine"))
    )
    joined = mine.join(inherited, ["id", "path"], "left")
    return joined.select(
        "id", "path", F.coalesce("license", "above").alias("license"), F.coalesce("cosine", "above_cosine").alias("cosine"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("above").isNotNull(), "inherited").alias("found"), "directory",
    )
