"""License scans against a plain computation over all words."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from textmill.llm import license_scan


def bag(text: str) -> Counter:
    return Counter(re.findall(r"[^\W_]+", text.lower()))


def best(line: str, texts: list[str]) -> tuple[float, str]:
    """The (cosine, license) of a line by how often each word occurs there and in how many documents."""
    docs = [bag(t) for t in texts]
    w = lambda t: (math.log((len(docs) + 1) / (sum(t in d for d in docs) + 1)) + 1) ** 2
    size = lambda x: sum((1 + math.log(n)) ** 2 * w(t) for t, n in x.items())
    dot = lambda x, y: sum((1 + math.log(n)) * (1 + math.log(y[t])) * w(t) for t, n in x.items() if t in y)
    found = [(dot(bag(line), bag(t)) / math.sqrt(size(bag(line)) * size(bag(t))), k) for k, t in license_scan.all_templates()]
    return max(found, key=lambda x: (round(x[0], 6), x[1]))


def test_words_outside_the_templates_weigh_by_their_own_frequency(spark):
    common = "and of so it at we he no"
    line = f"{common} released under the MIT License"
    texts = [f"{common} filler{i}" for i in range(300)] + [line, "rare1 rare2 rare3 rare4 rare5 rare6 rare7 rare8 released under the MIT License"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: (r.cosine, r.license) for r in license_scan.scan(df, F.concat(F.lit("d/"), F.col("doc_id"))).where("found = 'own'").collect()}
    wanted = {i: best(t, texts) for i, t in enumerate(texts)}
    assert found == {i: (round(c, 6), k) for i, (c, k) in wanted.items() if round(c, 6) >= 0.6}
    assert found[300] == (round(best(line, texts)[0], 6), "MIT") and found[300][0] > 0.9


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

def f(): return 1
"""


def test_full_texts_headers_and_sentences(spark):
    inside = "Some words here that say nothing at all about it. Released under the MIT License. Further words follow then, and more."
    rows = [(1, "m/any", MIT), (2, "m/code", "x = 1"), (3, "g/a.py", GPL), (4, "g/b.py", "y = 2"), (5, "s/t", inside), (6, "s/u", "z")] + [(i, f"o/{i}", f"filler{i} of the and to") for i in range(7, 60)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r.id: (r.license, r.found) for r in license_scan.scan(df, F.col("path")).where("license is not null").collect()}
    assert found == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "inherited"), 5: ("MIT", "own")}


def test_near_licences_and_tags_are_told_apart(spark):
    text = {p.stem: p.read_text(encoding="utf-8") for p in license_scan.TEXTS.glob("*.txt")}
    header = license_scan._GNU.format(";", "{}", "{}").replace("This program", "This library")
    rows = [(k, v) for k, v in text.items()]
    rows += [("AGPL-3.0", "# Copyright 2020 A. Person\n# " + license_scan._GNU.format(":", "Affero ", "3").replace("\n", "\n# ") + "\n\nx = 1\n"), ("LGPL-2.1", "/* " + header.format("Lesser ", "2.1") + " */\nint x;\n")]
    rows += [("GPL-2.0", license_scan._GNU.format(";", "", "2") + "\n" + "code " * 20), ("GPL-3.0", license_scan._GNU.format(":", "", "3") + license_scan._WARRANTY.format("") + "\ncode = 1")]
    rows += [("BSD-2-Clause", text["BSD-2-Clause"].replace("<", "Jane ").replace(">", " Doe")), ("MIT", "// SPDX-License-Identifier: MIT\nint main() {}\n"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */\ncode"), ("Zlib", "# SPDX-License-Identifier: Zlib\ncode")]
    rows += [("MIT OR Apache-2.0", "# SPDX-License-Identifier: MIT OR Apache-2.0\n" + "code " * 30), ("EPL-2.0", "// This program and the accompanying materials are made available under the\n// terms of the Eclipse Public License 2.0 which is available at\n// https://www.eclipse.org/legal/epl-2.0/\nx")]
    rows += [("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("Unlicense", text["Unlicense"] + "\n\n(and more words)")]
    rows += [(None, " ".join(f"filler{i} of the and to {i}" for i in range(j, j + 20))) for j in range(200)]
    df = spark.createDataFrame([(i, f"{i}/file", t) for i, (_, t) in enumerate(rows)], "doc_id long, path string, text string")
    found = {r.id: r.license for r in license_scan.scan(df, F.col("path")).collect()}
    assert {i: found[i] for i in range(len(rows))} == {i: k for i, (k, _) in enumerate(rows)}


def test_words_of_most_files_are_no_signal():
    templates = {(0, "A"): {"the": 60.0, "x": 50.0, "y": 50.0, "z": 50.0}, (1, "B"): {"the": 2.0, "u": 50.0, "v": 50.0}}
    weights = {"the": 2.0, "u": 50.0, "v": 50.0, "x": 50.0, "y": 50.0, "z": 50.0}
    signal = license_scan.signal_terms(templates, 0.36, weights)
    assert "the" not in signal
    assert all(sum(w for t, w in words.items() if t not in signal) < 0.36 * sum(words.values()) for words in templates.values())
