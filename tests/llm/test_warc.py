"""WARC archives: exact round trips, and what a damaged archive still gives."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
import pytest

from textmill.llm import warc
from textmill.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, `a.b` string, archive int, payload int"
LONG = "<p>" + "zufällig " * 300_000
HOSTILE = "<pre>WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n</pre>" + "x" * 200
COPY = "copied page " * 20


def rows() -> list[tuple]:
    return [(1, "http://a/1", "short"), (2, None, None), (3, "http://a/b c\r\nX: y", ""), (4, "u", LONG), (5, "u", HOSTILE), (9, "u", COPY), (7, "u", COPY), (None, "u", COPY), (8, "u", "short"), (7, "u", COPY), (6, "é", "x" * 99), (10, "v", "x" * 99), (11, "w", "y" * 100), (12, "w", "y" * 100)]


def test_round_trip_with_edges(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows()], SCHEMA)
    folder = scratch_path(spark, "warc")
    made = warc.write_archives(df, folder, archive_bytes=1000)
    assert made.agg({"records": "sum"}).first()[0] == len(rows()) and made.count() > 2
    found = warc.read_archives(made)
    assert warc.gaps(found).count() == 0
    full = warc.resolved(found).where("record_type <> 'warcinfo'").collect()
    want = sorted((str(i), (h or "").encode()) for i, _, h in rows() if i is not None)
    assert sorted((r.key, bytes(r.payload)) for r in full if r.key is not None) == want
    assert [bytes(r.payload) for r in full if r.key is None] == [COPY.encode()]
    kinds = sorted((r.key or "", r.record_type, r.refers_to, r.payload_bytes) for r in full if r.payload_bytes in (len(COPY), 99, 100))
    assert kinds == sorted([("", "revisit", "7", 240), ("7", "response", None, 240), ("7", "response", None, 240), ("9", "revisit", "7", 240), ("6", "response", None, 99), ("10", "response", None, 99), ("11", "response", None, 100), ("12", "revisit", "11", 100)])
    assert all(r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest() for r in full)
    assert {r.target_uri for r in full if r.key == "3"} == {"http://a/b%20c%0D%0AX:%20y"}


def test_empty_table_and_null_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.read_archives(warc.write_archives(empty, scratch_path(spark, "warc"))).count() == 0
    assert warc.read_archives(spark.createDataFrame([(None,)], "archive string")).count() == 0


def plain(key: str, text: str) -> bytes:
    payload = text.encode()
    return warc.record("response", key, f"http://x/{key}", "2020-01-01T00:00:00Z", payload, hashlib.sha256(payload).hexdigest())


def read(data: bytes) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(warc.salvaged(warc._File(pa.BufferReader(data))))
    gaps = [(r["at"], r["bytes"]) for r in found if "reason" in r]
    assert all(r["reason"] for r in found if "reason" in r)
    return [warc.key_of(r["record_id"]) for r in found if "reason" not in r], gaps


@pytest.mark.parametrize("packed", [True, False])
def test_every_kind_of_damage_costs_only_what_it_touches(packed):
    parts = [plain(str(i), f"body {i} " * (3 + 50 * i)) for i in range(6)]
    parts = [warc.member(p) for p in parts] if packed else parts
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    whole = b"".join(parts)
    assert read(whole) == (list("012345"), [])
    for hit in range(6):  # overwritten in the middle, at its start, at its end
        for at in (starts[hit] + 1, starts[hit] + len(parts[hit]) // 2, starts[hit + 1] - 3):
            damaged = whole[:at] + bytes([whole[at] ^ 0x5A]) + whole[at + 1 :]
            keys, gaps = read(damaged)
            assert keys == [str(i) for i in range(6) if i != hit], (hit, at)
            assert gaps == [(starts[hit], len(parts[hit]))]
    cut = whole[: starts[2] + 20] + whole[starts[3] :]  # bytes are missing
    assert read(cut) == (list("01345"), [(starts[2], 20)])
    junk = b"\x1f\x8b\x08junk WARC/1.1\r\nno record" * 3
    assert read(whole[: starts[2]] + junk + whole[starts[2] :]) == (list("012345"), [(starts[2], len(junk))])
    assert read(whole[:-10]) == (list("01234"), [(starts[5], len(parts[5]) - 10)])
    assert read(b"") == ([], []) and read(b"no archive at all")[1] == [(0, 17)]


def test_a_record_inside_a_broken_payload_is_not_taken_for_one():
    first, last = plain("1", HOSTILE), plain("2", "fine")
    at = first.index(b"<pre>")
    broken = first[:at] + b"<PRE>" + first[at + 5 :]
    for data in (broken + last, warc.member(broken) + warc.member(last)):
        keys, gaps = read(data)
        assert keys == ["2"] and len(gaps) == 1 and gaps[0][0] == 0


def test_foreign_archives():
    body = b"x=1"
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Long: a\r\n  b\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()) + b"\r\nContent-Length: 3\r\n\r\n"
    good = head + body + b"\r\n\r\n"
    bad = good.replace(b"x=1", b"x=2")
    found = list(warc.salvaged(warc._File(pa.BufferReader(gzip.compress(good + good) + bad + good))))
    assert [(r.get("record_type"), "reason" in r) for r in found] == [("resource", False), ("resource", False), (None, True), ("resource", False)]
    assert found[0]["payload"] == body and found[2]["bytes"] == len(bad)


def test_long_damage_is_searched_in_chunks():
    noise = hashlib.shake_256(b"n").digest(3_000_000)
    data = warc.member(plain("1", "a")) + noise + warc.member(plain("2", "b")) + noise + plain("3", "c")
    assert read(data)[0] == ["1", "2", "3"]
