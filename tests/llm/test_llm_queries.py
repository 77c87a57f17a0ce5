"""Queries of the corpus operators against SQL, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import compare
from textmill.llm import chat, language_id, packing, tokenization
from textmill.llm.queries import ORACLE_SQL, QUERIES
from textmill.llm.tokenization import PieceEncoder


def documents(sf_dir: str) -> pd.DataFrame:
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], sf_dir)


def slow_fingerprint(text: str) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints: dict[int, int]) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups_equal_brute_force(spark, sf_dir):
    found = QUERIES["op4_simhash_groups"](spark, sf_dir).toPandas().set_index("doc_id")
    docs = documents(sf_dir)
    prints = {int(d): slow_fingerprint(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert found.fingerprint.to_dict() == {d: f"{p:016x}" for d, p in prints.items()}
    assert found.component_id.to_dict() == slow_groups(prints)


def test_languages_of_held_out_documents(spark, sf_dir):
    found = QUERIES["op5_language_id"](spark, sf_dir.replace("0.001", "0.01")).toPandas().merge(documents(sf_dir.replace("0.001", "0.01"))[["doc_id", "lang"]])
    assert found.held_out.tolist() == [zlib.crc32(str(d).encode()) % 5 == 0 for d in found.doc_id]
    held = found[found.held_out]
    assert len(held) > 50 and (held.lang == held.lang_pred).mean() >= 0.97
    assert found.score.between(0, 1).all()


def test_languages_equal_a_plain_fit_and_prediction(spark, sf_dir):
    """In one process, from the rules alone: the same sample, the same machines; labels of held-out rows change nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in rows}
    counts = pd.Series([lang for d, t, lang in rows if not held[d] and lang is not None and t is not None]).value_counts()
    assert counts.max() <= language_id.PER_LANGUAGE  # all rows are learned from here
    learned = sorted((d, lang, t) for d, t, lang in rows if not held[d] and lang is not None and t is not None and language_id.has_letter(t))
    model = language_id.train([x[1] for x in learned], np.array([language_id.features(x[2]).astype(np.float32) for x in learned], np.float64))
    wanted = {d: model.predict(t) for d, t, _ in rows}
    found = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op5_language_id"](spark, sf_dir).collect()}
    assert {d: x[0] for d, x in found.items()} == {d: x[0] for d, x in wanted.items()}
    assert all(abs(found[d][1] - wanted[d][1]) < 1e-9 for d in found)
    for d, t, _ in rows[:40]:  # one-versus-one votes, the family first, said plainly
        if t and language_id.has_letter(t):
            x = language_id.features(t)
            beats = {(a, b): float(w @ x) > 0 for (a, b), w in zip(model.pairs, model.weights, strict=True)}
            votes = lambda names: {n: sum(beats[p] if p[0] == n else not beats[p] for p in beats if n in p and set(p) <= set(names)) for n in names}
            family = votes([f"family {f}" for f in model.families])
            inside = votes(model.families[language_id.family_of(found[d][0])])
            assert family[f"family {language_id.family_of(found[d][0])}"] == max(family.values()) and inside[found[d][0]] == max(inside.values())
    shuffled = docs.withColumn("lang", F.when(language_id.held_out(), "en").otherwise(F.col("lang")))
    again = language_id.identify(shuffled, language_id.fit(shuffled)).collect()
    assert {r.row.doc_id: r.lang_pred for r in again} == {d: x[0] for d, x in found.items()}


def ids_of(name: str, text: str, end: int) -> np.ndarray:
    if name not in ids_of.cache:
        ids_of.cache[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*ids_of.cache[name].encode(text or "", add_special_tokens=False).ids, end], "<u4")


ids_of.cache = {}


def test_token_store_round_trip(spark, sf_dir):
    found, start = QUERIES["op6_token_store"](spark, sf_dir).toPandas().sort_values("doc_id"), 0
    docs = documents(sf_dir)
    assert len(found) == len(docs)
    for row, text in zip(found.itertuples(), docs.text, strict=True):
        ids = ids_of("byte_bpe_50k.json", text, 0)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing_keeps_every_id_once(spark, sf_dir):
    found = QUERIES["op10_packing"](spark, sf_dir).toPandas()
    texts = dict(documents(sf_dir)[["doc_id", "text"]].itertuples(index=False))
    for doc, pieces in found.sort_values("start").groupby("doc_id"):
        ids = ids_of("word_bpe_49k.json", texts.pop(doc), 2)
        assert (pieces.start.to_numpy() == np.concatenate([[0], pieces.length.cumsum()[:-1]])).all() and pieces.length.sum() == len(ids)
        for p in pieces.itertuples():
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert not texts
    for _, inside in found.sort_values("offset").groupby("sequence_id"):
        assert (inside.offset.to_numpy() == np.concatenate([[0], inside.length.cumsum()[:-1]])).all() and inside.length.sum() <= 4096
    assert found.length.sum() / (4096 * found.sequence_id.nunique()) > 0.9


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piece_encoder_equals_the_library(name, sf_dir):
    odd = ["", " a  b ", "a\n \nb", "x\ty  z", "café Ünï ß", "a <|endoftext|> b", "foo\n bar\n\nbaz", "it's we'll '12 34!!", "a\x1cb", "é x ́y", "日本 語", " a   b", "A" * 300, "x\r\n y"]
    encoder = PieceEncoder(public_tokenizers.path(name))
    texts = [*odd, *documents(sf_dir).text[:60]]
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == [ids_of(name, t, 9)[:-1].tolist() for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_any_bytes_equal_the_library(name, monkeypatch):
    rng = random.Random(7)
    atoms = ["a", "B", "foo", "É", "ß", "×", "÷", "é", "J\u030c", "12", "7", "'s", "'LL", "'", ",", "...", "$$$", " ", " ", " ", "\n", "\n", "\t", "\x00", "\x1c", "\u00a0", "日本", "ſ", "İ", "\x7f", "\U0001f600", "ﬁ"]
    texts = ["".join(rng.choices(atoms, k=rng.randint(1, 12))) for _ in range(3000)] + [" ", "\n", "\t \n", " a", "a "]
    monkeypatch.setattr(tokenization, "MOST_CACHED", 500)  # pieces are forgotten all the time
    monkeypatch.setattr(tokenization, "_numbers", lambda pieces, f=tokenization._numbers: f(pieces) % np.uint64(1999))  # and many share a number
    encoder = PieceEncoder(public_tokenizers.path(name))
    for size in (1, 7, 1000):
        for at in range(0, len(texts), size):
            part = texts[at : at + size]
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in part])] == [ids_of(name, t, 9)[:-1].tolist() for t in part]
    assert len(encoder.cache.keys) <= 500 and encoder.encode([None, b"", b" \n" if encoder.drops_spaces else b""]) == [b"", b"", b""]


def test_words_with_marks_are_encoded_once():
    words, marks = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst"], [".", ",", "!!", "$$$", "&&&", ".\n12", "***", "###"]
    text = "x " + " ".join(w + m for w in words for m in marks)
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == ids_of("byte_bpe_50k.json", text, 9)[:-1].tolist()
    assert len(encoder.cache.keys) == 1 + len(words) + 9  # "x", seven marks, "\n", "12"; before, each word with each mark


_GROWTH = """
import random, sys
sys.path.insert(0, sys.argv[2])
from textmill.llm.tokenization import PieceEncoder
anon = lambda: next(int(x.split()[1]) >> 10 for x in open("/proc/self/status") if x.startswith("RssAnon"))
encoder, rng, most = PieceEncoder(sys.argv[1]), random.Random(5), 0
encoder.encode([b"some words"])
before = anon()
for _ in range(14):
    encoder.encode([" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(100)).encode() for _ in range(1000)])
    most = max(most, anon() - before)
print(most)
"""


def test_an_encoder_of_words_that_are_all_different_stays_small():
    """Packing in the pipeline: two workers share an executor with the JVM. The cache of bytes in dictionaries grew by 173 MB here."""
    if not os.path.exists("/proc/self/status"):
        pytest.skip("memory is read from /proc")
    root = str(Path(tokenization.__file__).parents[2])
    most = int(subprocess.run([sys.executable, "-c", _GROWTH, public_tokenizers.path("word_bpe_49k.json"), root], capture_output=True, check=True, text=True).stdout)
    assert most < 100


def test_differencing_is_balanced_and_whole():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 4096, 500).tolist()
    place = packing.windows(lengths)
    sums = np.bincount(place, lengths)
    assert len(place) == 500 and sums.max() <= 4096 and len(sums) <= -(-sum(lengths) // 4096) * 1.35
    assert packing.windows([]).size == 0 and packing.windows([4096, 1]).tolist() in ([0, 1], [1, 0])


def test_chat_marks_inside_texts_are_reversible(spark):
    texts = ["</turn>\n<turn user>\nx", "\\<", "<\\turn a>", "", "### Assistant: \\\\ <|im_end|>", "hi", "\\n", ">\n", "\\\n"]
    roles = ["user>", "us>\ner", "us\\", "us\\\n>\n\\n"]
    rows = [(1, i, "assistant" if i % 2 else roles[i // 2 % len(roles)], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.format_examples(df)
    last = examples.orderBy(examples.last_turn.desc()).select(chat.parse_turns(examples.formatted).alias("t")).first()["t"]
    assert [(x["role"], x["text"]) for x in last] == [(r[2], r[3]) for r in rows]
    said = [r[0] for r in examples.where("loss_length > 0").orderBy("last_turn").select(chat.loss_text(examples.formatted, examples.loss_start, examples.loss_length)).collect()]
    assert said == [t for i, t in enumerate(texts) if i % 2 and t]


def test_language_features_see_whole_texts():
    long = "x1 " * 700_000 + "größe"
    assert not np.allclose(language_id.features(long), language_id.features(long[:-5]))
    assert language_id.has_letter("ß") and not language_id.has_letter("12 !²")


def test_pipeline_rows_follow_from_its_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in p.STAGES[:-1]:
        before = kept.count()
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).toPandas(), docs.schema)
        assert kept.columns == docs.columns and 0 < kept.count() <= before
    left = {r.doc_id: r.text for r in kept.collect()}
    leaks = {r.doc_id for r in QUERIES["op3_benchmark_leaks"](spark, sf_dir).collect()}
    assert not leaks & set(left)
    assert len(set(slow_groups({d: slow_fingerprint(t) for d, t in left.items()}).values())) == len(left)
    pieces = p.run(spark, sf_dir).toPandas()
    assert set(pieces.doc_id) == set(left)
    for d, total in pieces.groupby("doc_id").length.sum().items():
        assert total == len(ids_of("word_bpe_49k.json", left[d], 2))
