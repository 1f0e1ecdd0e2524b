"""WARC archives with one Zstandard frame for each record and a dictionary in front.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record
is a frame of its own, so that it can be read alone. Archives are bounded: a task closes one when
its records reach a size and begins another. They are written through Spark's text sink, whose
commit protocol makes lost tasks harmless and which reaches any file system Spark does: an archive
is one "line", and the line end is an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, record_batches, small, written

# Fixed values of the Zstandard and WARC formats.
ZSTD_MAGIC = 0xFD2FB528
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

EMPTY_FRAME = struct.pack("<II", SKIPPABLE_FIRST, 0).decode("latin-1")  # ASCII only
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 1 << 20
DATE = "1970-01-01T00:00:00Z"  # the tables have no dates


class BadArchive(ValueError):
    """An archive or a record that breaks the format."""


def record_id(row: int | None, digest: str) -> str:
    return f"<urn:x-page:{'null:' + digest if row is None else row}>"


def build_record(row: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes], level: int = 3) -> bytes:
    """The dictionary is trained on the archive's own first records (a megabyte at most); where
    they are too few for that, their beginning is the dictionary."""
    sample, n = [], 0
    for r in records:
        if n >= SAMPLE_BYTES:
            break
        sample.append(r[: SAMPLE_BYTES - n])
        n += len(sample[-1])
    try:
        made = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, n // 20)), sample)
    except zstandard.ZstdError:
        made = zstandard.ZstdCompressionDict(b"".join(sample)[: DICTIONARY_BYTES // 4], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = made.as_bytes()
    press = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *(press.compress(r) for r in records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its headers alone."""
    try:
        kind = data[at + 4]
        single, checksum = kind >> 5 & 1, kind >> 2 & 1
        pos = at + 5 + (1 - single) + (0, 1, 2, 4)[kind & 3] + (single, 2, 4, 8)[kind >> 6]
        while True:
            block = int.from_bytes(data[pos : pos + 3], "little")
            if pos + 3 > len(data) or block >> 1 & 3 == 3:
                raise BadArchive(f"bad block at byte {pos}")
            pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
    except IndexError:
        raise BadArchive(f"frame at byte {at} is cut off") from None
    pos += 4 * checksum
    if pos > len(data):
        raise BadArchive(f"frame at byte {at} is cut off")
    return pos


def frames(data: memoryview) -> Iterator[tuple[int, int, zstandard.ZstdDecompressor]]:
    """(start, end, decompressor with the archive's dictionary) of each record's frame."""
    at, tool = 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise BadArchive(f"{len(data) - at} bytes behind the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            if (end := at + 8 + size) > len(data):
                raise BadArchive(f"skippable frame at byte {at} is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = bytes(data[8:end])
                if raw[:4] == struct.pack("<I", ZSTD_MAGIC):  # the dictionary may be compressed itself
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at = end
        elif magic == ZSTD_MAGIC:
            tool = tool or zstandard.ZstdDecompressor()
            yield at, (end := frame_end(data, at)), tool
            at = end
        else:
            raise BadArchive(f"unknown magic number {magic:#x} at byte {at}")


@dataclass
class Record:
    kind: str
    fields: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None


def _fields(lines: list[str]) -> dict[str, str]:
    out = {}
    for x in lines:
        name, colon, value = x.partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"bad header line {x[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(raw: bytes) -> Record:
    """Validates the version, the headers that every record must have, both lengths and, for
    responses, the payload's digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise BadArchive("no WARC header")
    fields = _fields(lines[1:])
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]:
        raise BadArchive(f"missing {', '.join(missing)}")
    if not fields["content-length"].isdigit():
        raise BadArchive("bad Content-Length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length is {n}, the block has {len(rest) - 4} bytes")
    record = Record(fields["warc-type"].lower(), fields)
    if record.kind in ("response", "revisit") and "http" in fields.get("content-type", ""):
        top, _, payload = rest[:n].partition(b"\r\n\r\n")
        lines = top.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("HTTP/"):
            raise BadArchive("no HTTP status line")
        record.http = _fields(lines[1:])
    else:
        payload = rest[:n]
    if record.kind != "revisit":
        record.payload = payload
        if "content-length" in record.http and record.http["content-length"] != str(len(payload)):
            raise BadArchive("the HTTP Content-Length is not the payload's")
        kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
        if kind == "sha256" and digest != hashlib.sha256(payload).hexdigest():
            raise BadArchive("the payload's digest is another")
    return record


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 100, archive_bytes: int = 16 << 20) -> None:
    """Writes a record for each row into archives below ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes that with the smallest id
    is a response and the others revisit it. Defined cases: a null payload is an empty one; a row
    with a null id has an id made of its digest and is never referred to; rows that repeat the
    smallest id are all responses; a null url is left out; an empty table leaves no archive;
    other columns are not read.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Only digests that occur twice are kept, so the payloads need not be shuffled where those are few.
    large = rows.where(F.octet_length("payload") >= min_revisit_bytes)
    twice = written(large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("same"), "first"), "twice")
    joined = rows.join(small(twice), F.col("digest") == F.col("same"), "left").select("id", "url", "payload", "digest", "first")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.binary())])
        records, n = [], 0
        for b in batches:
            for i, u, p, d, f in zip(column(b, "id").to_pylist(), column(b, "url").to_pylist(), column(b, "payload"), column(b, "digest").to_pylist(), column(b, "first").to_pylist()):
                records.append(build_record(i, u, p.as_py(), d, f, f is not None and i != f))
                n += len(records[-1])
                if n >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([build_archive(records)], pa.binary())], schema=schema)
                    records, n = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([build_archive(records)], pa.binary())], schema=schema)

    packed = joined.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string"))
    packed.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True, strict: bool = True, glob: str | None = None) -> DataFrame:
    """Returns a row for each record of the archives below ``path``, whatever they are called (but for
    names that begin with _ or ., which Spark's commit protocol uses; ``glob`` picks some): archive, offset, type,
    record_id, target_uri, date, refers_to, payload_digest (hex), payload_bytes, payload, error.

    A revisit has no payload; its digest and length are those its headers give. With ``strict``
    a record or archive that breaks the format fails the read; otherwise it gives a row with its
    error, and the archive is read on behind a bad record (not behind a bad frame). An archive is held
    whole by its task; one of over two gigabytes is refused by Spark.
    """
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), *((x, pa.string()) for x in ("type", "record_id", "target_uri", "date", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def of(name: str, content: bytes) -> Iterator[tuple]:
        data, at = memoryview(content), 0
        try:
            for at, end, tool in frames(data):
                try:
                    r = parse_record(tool.decompressobj().decompress(data[at:end]))
                    f = r.fields
                    if r.kind == "revisit":
                        digest, size = f.get("warc-payload-digest", "").rpartition(":")[2], r.http.get("content-length")
                    else:
                        digest, size = hashlib.sha256(r.payload).hexdigest(), len(r.payload)
                    yield name, at, r.kind, f["warc-record-id"], f.get("warc-target-uri"), f["warc-date"], f.get("warc-refers-to"), digest, None if size is None else int(size), r.payload if with_payload else None, None
                except (BadArchive, zstandard.ZstdError) as e:
                    if strict:
                        raise BadArchive(f"{name}, byte {at}: {e}") from e
                    yield name, at, *[None] * 8, str(e)
        except BadArchive as e:
            if strict:
                raise
            yield name, at, *[None] * 8, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(column(b, "path").to_pylist(), column(b, "content")):
                yield from record_batches(of(name, content.as_py()), schema, 64 if with_payload else 4096)

    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    source = source.option("pathGlobFilter", glob) if glob else source
    return source.load(path).select("path", "content").mapInArrow(run, "archive string, offset long, type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string")


def page_of(name):
    """The id within a record id; null if it has none."""
    return F.expr(f"try_cast(regexp_extract({name}, '^<urn:x-page:(-?[0-9]+)>$', 1) as bigint)")
