"""A kept fingerprint index under repeated calls, failures and other writers."""

from __future__ import annotations

import pytest

from textmill.llm import substring_dedup as sd
from textmill.llm.common import scratch_path

PASSAGE = " ".join(f"shared{i}" for i in range(40))


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def unique(i: int, n: int = 60) -> str:
    return " ".join(f"d{i}w{j}" for j in range(n))


def kept(found) -> list[tuple]:
    return sorted((r.row.doc_id or -1, r.n_removed, r.kept) for r in found.collect())


ROWS = [(1, unique(1)), (2, unique(2)), (3, f"a {PASSAGE} b"), (4, f"{PASSAGE} c"), (5, unique(5)), (5, unique(5)), (None, unique(6)), (7, unique(7) + " " + "z " * 50), (8, None)]


def test_the_same_call_twice_gives_the_same(spark):
    df, path = texts(spark, ROWS), scratch_path(spark, "twice")
    once = kept(sd.dedup_substrings(df))
    first = kept(sd.dedup_substrings(df, index_path=path))
    again = kept(sd.dedup_substrings(df, index_path=path))
    assert once == first == again
    assert {d: n for d, n, _ in once if d in (1, 2, 5, -1)} == {1: 0, 2: 0, 5: 60, -1: 0}
    # known and new documents in one call; a document given more often than the index holds it is a copy of itself
    more = texts(spark, [ROWS[0], ROWS[0], ROWS[1], (9, f"{PASSAGE} q"), (10, unique(10))])
    got = kept(sd.dedup_substrings(more, index_path=path))
    assert [(d, n) for d, n, _ in got] == [(1, 60), (1, 60), (2, 0), (9, 40), (10, 0)]
    assert got == kept(sd.dedup_substrings(more, index_path=path))


def test_a_new_text_of_a_known_id_is_a_new_document(spark):
    path = scratch_path(spark, "new-text")
    kept(sd.dedup_substrings(texts(spark, [(1, unique(1))]), index_path=path))
    assert kept(sd.dedup_substrings(texts(spark, [(1, unique(1) + " more")]), index_path=path)) == [(1, 60, "more")]


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_a_call_that_fails_leaves_the_index_as_it_was(spark, monkeypatch, fails_at):
    path = scratch_path(spark, "fails")
    old = texts(spark, [(100 + i, unique(100 + i)) for i in range(3)] + [(99, f"{PASSAGE} old")])
    kept(sd.dedup_substrings(old, index_path=path))
    before = sd.FingerprintIndex(spark, path)
    df, calls, add = texts(spark, ROWS), [], sd.FingerprintIndex.add

    def failing(self, places, more=True):
        calls.append(1)
        if len(calls) == fails_at:
            raise OSError("lost")
        return add(self, places, more)

    monkeypatch.setattr(sd.FingerprintIndex, "add", failing)
    with pytest.raises(OSError, match="lost"):
        sd.dedup_substrings(df, index_path=path)
    monkeypatch.undo()
    after = sd.FingerprintIndex(spark, path)
    assert (after.version, after.runs, after.texts) == (before.version, before.runs, before.texts)
    got = kept(sd.dedup_substrings(df, index_path=path))
    assert [(d, n) for d, n, _ in got] == [(-1, 0), (1, 0), (2, 0), (3, 40), (4, 40), (5, 60), (5, 60), (7, 50), (8, 0)]
    assert got == kept(sd.dedup_substrings(df, index_path=path))


def test_two_writers_are_refused_and_settings_are_restored(spark):
    path = scratch_path(spark, "writers")
    df = texts(spark, ROWS)
    before = {k: spark.conf.get(k, None) for k in sd.SETTINGS}
    kept(sd.dedup_substrings(df, index_path=path))
    assert {k: spark.conf.get(k, None) for k in sd.SETTINGS} == before
    first, second = sd.FingerprintIndex(spark, path), sd.FingerprintIndex(spark, path)
    with first.writing():
        with pytest.raises(RuntimeError, match="another call is writing"):
            sd.dedup_substrings(df, index_path=path)
        first.commit()
    with pytest.raises(RuntimeError, match="changed since"), second.writing():
        pass
    assert {k: spark.conf.get(k, None) for k in sd.SETTINGS} == before
    assert len(kept(sd.dedup_substrings(df, index_path=path))) == len(ROWS)
