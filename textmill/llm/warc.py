"""WARC archives: written as gzip members by tasks, and read back by a reader that salvages what damage has left.

Tasks write files under names that no other attempt uses; only those named in the manifest, the rows that successful
tasks gave, belong to the result. Lost executors and repeated tasks thus leave at most files that nothing reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialize, prepare, rows_of, tidy

ARCHIVE_BYTES = 256 << 20  # an archive is closed once it holds so many compressed bytes
LEAST_REVISIT = 100  # payloads of fewer bytes are always written whole
BROADCAST_COPIES = 200_000  # digests (of about 100 bytes) that may be broadcast
CHUNK = 1 << 18
LEVEL = 4  # of gzip

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
BLANK = b"\r\n\r\n"


# --- writing


def _field(name: str, value: str) -> bytes:
    return f"{name}: {value}\r\n".encode()


def _safe(uri: str) -> str:
    """A URI without the characters that would end a header line or its field."""
    return quote(uri, safe="!#$%&'()*+,/:;=?@[]~")


def record_id(key: str | None) -> str:
    return f"<urn:page:{quote(key, safe='')}>" if key is not None else "<urn:page>"


def key_of(uri: str | None) -> str | None:
    """The key of a record id that :func:`record_id` made, null for any other."""
    found = re.fullmatch(r"<urn:page:(.*)>", uri or "", re.DOTALL)
    return unquote(found[1]) if found else None


def record(kind: str, key: str | None, uri: str | None, date: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One response or revisit record; a revisit holds the HTTP header of what it stands for, without the payload."""
    block = b"HTTP/1.1 200 OK\r\n" + _field("Content-Type", "text/html; charset=utf-8") + _field("Content-Length", str(len(payload))) + b"\r\n"
    if kind == "response":
        block += payload
    head = VERSION + _field("WARC-Type", kind) + _field("WARC-Record-ID", record_id(key)) + _field("WARC-Date", date)
    if uri is not None:
        head += _field("WARC-Target-URI", _safe(uri))
    if kind == "revisit":
        head += _field("WARC-Profile", PROFILE) + _field("WARC-Refers-To", record_id(refers_to))
    head += _field("WARC-Payload-Digest", f"sha256:{digest}") + _field("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")
    head += _field("Content-Type", "application/http; msgtype=response") + _field("Content-Length", str(len(block)))
    return head + b"\r\n" + block + BLANK


def member(data: bytes) -> bytes:
    """``data`` as a gzip member without name or time, so that equal records give equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _info(date: str) -> bytes:
    body = b"software: textmill\r\nformat: WARC File Format 1.1\r\n"
    head = VERSION + _field("WARC-Type", "warcinfo") + _field("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>") + _field("WARC-Date", date)
    return head + _field("Content-Type", "application/warc-fields") + _field("Content-Length", str(len(body))) + b"\r\n" + body + BLANK


def _written(folder: str, date: str, archive_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, out, size, count = "", None, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

        for batch in batches:
            keys, uris, digests, firsts = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for first, payloads in rows_of(batch, 2):
                for i, payload in enumerate(payloads, first):
                    if out is None:
                        name, size, count = f"archive-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        size += out.write(member(_info(date)))
                    again = firsts[i] is not None and firsts[i] != keys[i]
                    size += out.write(member(record("revisit" if again else "response", keys[i], uris[i], date, payload or b"", digests[i], firsts[i])))
                    count += 1
                    if size >= archive_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    return tidy(run)


def write_archives(
    pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", body_col: str = "html", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """A record for each row in gzip archives below ``folder``, a URI -> the manifest (archive, bytes, records), itself written there.

    The payload is the body in UTF-8. Of rows with equal payloads of at least LEAST_REVISIT bytes that with the smallest id is a
    response and the others, rows with null ids too, are revisits that refer to it; where all ids are null, and for smaller payloads, all are responses. Rows that repeat
    the smallest id with its payload are each a response. A null body is an empty payload; null URLs leave out the
    target URI; characters that would break a header are percent-encoded. Other columns are not read; an empty table gives an empty manifest.

    Bodies are not shuffled while the digests of copied payloads can be broadcast, behind a count; beyond it they are joined by
    digest, where AQE splits a popular one.
    """
    spark = pages.sparkSession
    prepare(spark)
    payload = F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    copied = rows.where(F.length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copied = materialize(copied, "copied-payloads")
    known = F.broadcast(copied) if copied.count() <= BROADCAST_COPIES else copied
    ready = rows.join(known, "digest", "left").select(F.col("id").cast("string").alias("id"), "uri", "payload", "digest", F.col("first").cast("string").alias("first"))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    found = ready.mapInArrow(_written(folder.rstrip("/"), date, archive_bytes), "archive string, bytes long, records long")
    found.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(found.schema).parquet(f"{folder.rstrip('/')}/manifest")


# --- reading


class Damage(ValueError):
    """A check that a record did not pass. ``end`` is where it would end, if its framing can be trusted."""

    def __init__(self, why: str, end: int | None = None) -> None:
        super().__init__(why)
        self.end = end


class _File:
    """Random access to a file; memory holds one chunk and what is asked for."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()
        self.at, self.chunk = 0, b""

    def read(self, start: int, n: int) -> bytes:
        end = min(start + n, self.size)
        if not (self.at <= start and end <= self.at + len(self.chunk)):
            self.at, self.chunk = start, self.file.read_at(min(max(n, CHUNK), self.size - start), start) if start < self.size else b""
        return self.chunk[start - self.at : end - self.at]

    def candidate(self, start: int) -> int:
        """The next place where a member or a record may start, the file's size if there is none."""
        while start < self.size:
            part = self.read(start, CHUNK)
            if found := START.search(part):
                return start + found.start()
            if start + len(part) >= self.size:
                break
            start += len(part) - 9  # a mark may lie across two chunks
        return self.size


def _inflated(file: _File, start: int, peek: int = 0) -> tuple[bytes, int]:
    """What the gzip member at ``start`` holds, checked by its own CRC, and where it ends; with ``peek`` its first bytes."""
    unpack, at, parts = zlib.decompressobj(31), start, []
    while not unpack.eof:
        chunk = file.read(at, 256 if peek else CHUNK >> 2)
        if not chunk:
            raise Damage("truncated member")
        at += len(chunk)
        try:
            parts.append(unpack.decompress(chunk, peek))
        except zlib.error as e:
            raise Damage("broken member") from e
        if peek and (len(parts[0]) >= peek or len(parts) > 4):
            return b"".join(parts), at
    return b"".join(parts), at - len(unpack.unused_data)


HEADER_BYTES = 1 << 16


def _header(read: Callable[[int, int], bytes], at: int) -> tuple[dict[str, str], int]:
    """The named fields of the record at ``at`` and where its block begins."""
    width = HEADER_BYTES
    while True:
        head = read(at, width)
        end = head.find(BLANK)
        if end >= 0 or len(head) < width:
            break
        width *= 4
    if not re.match(rb"WARC/1\.[01]\r\n", head):
        raise Damage("no version line")
    if end < 0:
        raise Damage("truncated header")
    if re.search(rb"WARC/1\.[01]\r\n", head[10 : end + 2]):
        raise Damage("another record's version line inside the header")
    fields: dict[str, str] = {}
    last = None
    for line in head[:end].split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            fields[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            raise Damage("broken header")
        last = name.strip().lower()
        fields.setdefault(last, value.strip())
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise Damage("no content length")
    if not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Damage("no type or no record id")
    return fields, at + end + len(BLANK)


def _digest_matches(field: str, data: bytes) -> bool:
    """Whether a digest field of an algorithm and form known here fits; fields of other kinds are not judged."""
    kind, _, value = field.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha256", "sha1", "md5"):
        return True
    made = hashlib.new(kind, data)
    if len(value) == 2 * made.digest_size:
        return value.lower() == made.hexdigest()
    return value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def _parsed(read: Callable[[int, int], bytes], at: int, size: int) -> tuple[dict, int]:
    """The record at ``at``, all of whose checks pass, and where the next one begins."""
    fields, begin = _header(read, at)
    length = int(fields["content-length"])
    end = begin + length + len(BLANK)
    if end > size or read(begin + length, len(BLANK)) != BLANK:
        raise Damage("truncated record" if end > size else "record end not where its length says")
    block = read(begin, length)
    if "warc-block-digest" in fields and not _digest_matches(fields["warc-block-digest"], block):
        raise Damage("block digest differs", end)
    kind, http, payload, said = fields.get("warc-type", ""), None, block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        cut = block.find(BLANK)
        http, payload = (block[:cut], block[cut + len(BLANK) :]) if cut >= 0 else (block, b"")
        found = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", http)
        said = int(found[1]) if found else None
    given = fields.get("warc-payload-digest")
    whole = kind in ("response", "resource")
    if whole and given and not _digest_matches(given, payload):
        raise Damage("payload digest differs", end)
    digest = given.partition(":")[2].lower() if given and kind == "revisit" else hashlib.sha256(payload).hexdigest()
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "refers_to": fields.get("warc-refers-to"), "payload_bytes": said if kind == "revisit" else len(payload), "payload_digest": digest,
        "http_header": None if http is None else http.decode("utf-8", "replace"), "payload": None if kind == "revisit" else payload,
    }, end


def salvaged(file: _File) -> Iterator[dict]:
    """The records of a file in order, each with ``at`` and ``bytes``, and where checks failed the gaps, with ``reason``.

    A record counts if its member inflates under its CRC, its version line, header and length are whole, and its digests
    fit. After a failed check the gap lasts until the next place where a whole record starts, be it a member or a version line; a
    record whose framing is whole but whose digest differs is passed over as such, so that nothing inside its payload is
    taken for a record. A member may hold several records.
    """
    at, gap, reason = 0, None, ""
    while at < file.size:
        found, end, resume, why = [], at, None, ""
        try:
            if file.read(at, 2) == b"\x1f\x8b":
                if gap is not None and not _inflated(file, at, peek=8)[0].startswith(b"WARC/1."):
                    raise Damage("no record in this member")
                data, end = _inflated(file, at)
                inside = 0
                while inside < len(data):
                    try:
                        row, after = _parsed(lambda start, n, data=data: data[start : start + n], inside, len(data))
                    except Damage as e:
                        e.end = end  # the member's own frame holds
                        raise
                    found.append(row)
                    inside = after
            else:
                row, end = _parsed(file.read, at, file.size)
                found.append(row)
        except Damage as e:
            why, resume = str(e), e.end
        if why:
            if gap is None:
                gap, reason = at, why
            if found:  # records of a member before the one that fails
                yield from ({**row, "at": at, "bytes": resume - at} for row in found)
            at = resume if resume is not None else file.candidate(at + 1)
            if resume is not None:
                yield {"at": gap, "bytes": at - gap, "reason": reason}
                gap = None
            continue
        if gap is not None:
            yield {"at": gap, "bytes": at - gap, "reason": reason}
            gap = None
        yield from ({**row, "at": at, "bytes": end - at} for row in found)
        at = end
    if gap is not None:
        yield {"at": gap, "bytes": file.size - gap, "reason": reason}


RECORD = [
    ("archive", pa.string(), "string"), ("at", pa.int64(), "long"), ("bytes", pa.int64(), "long"), ("reason", pa.string(), "string"), ("record_type", pa.string(), "string"), ("record_id", pa.string(), "string"),
    ("key", pa.string(), "string"), ("refers_to", pa.string(), "string"), ("target_uri", pa.string(), "string"), ("date", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("http_header", pa.string(), "string"),
    ("payload", pa.binary(), "binary"),
]


def _read(payloads: bool) -> Callable:
    schema = pa.schema([(name, kind) for name, kind, _ in RECORD])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names in batches:
            for archive in names.column(0).to_pylist():
                rows, held = [], 0
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_file(path) as file:
                    for row in salvaged(_File(file)):
                        row |= {"archive": archive, "key": key_of(row.get("record_id")), "refers_to": key_of(row.get("refers_to")) or row.get("refers_to")}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row.get("payload") or b"") + 512
                        if held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return tidy(run)


def read_archives(archives: DataFrame, archive_col: str = "archive", payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """The records and gaps of the archives that a table names by URI: a record has a ``record_type``, a gap a ``reason``.

    Each archive is read by one task as a stream, since only reading from its start tells a record from the copy of one
    inside a payload; archives are dealt out to ``tasks`` (by default the session's shuffle partitions). ``key`` is the id that
    :func:`write_archives` was given. Null names are left out, a name given twice is read twice; empty files and tables give no rows. A record
    without a known digest field is not judged by it. Revisits give the length and digest of the payload they stand for.
    """
    spark = archives.sparkSession
    prepare(spark)
    names = archives.select(F.col(f"`{archive_col}`").alias("archive")).where(F.col("archive").isNotNull())
    dealt = names.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("archive"))
    return dealt.mapInArrow(_read(payloads), ", ".join(f"{name} {kind}" for name, _, kind in RECORD))


def records(found: DataFrame) -> DataFrame:
    return found.where(F.col("reason").isNull()).drop("reason")


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined ranges: (archive, at, bytes, reason)."""
    return found.where(F.col("reason").isNotNull()).select("archive", "at", "bytes", "reason")


def resolved(found: DataFrame) -> DataFrame:
    """Records with the payload of revisits taken from the response of their digest, for readers who need the bodies."""
    rows = records(found)
    bodies = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.first("payload").alias("_body"))
    wanted = rows.where("record_type = 'revisit'")
    body: Column = F.coalesce("payload", "_body")
    return rows.where("record_type <> 'revisit'").unionByName(wanted.join(bodies, "payload_digest", "left").withColumn("payload", body).select(rows.columns))
