"""WARC archives, one Zstandard frame a record, with the dictionary in a leading skippable frame.

Writing: every task trains a dictionary on its first records, writes archives of bounded size to the shared folder
and returns their names; only names of finished tasks reach the manifest, so a repeated task leaves no double
records.  Reading: a task streams an archive frame by frame and checks headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubwatch.llm.storage import open_store, shared_folder, write_whole
from pubwatch.session import materialize

#: Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC, RAW_DICTIONARY_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 2 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class Malformed(ValueError):
    """A record or archive that breaks the format."""


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def record_bytes(page_id: object, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: object, date: str = DATE) -> bytes:
    """One record; ``payload`` is None for a revisit, whose HTTP header still has the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = {
        "WARC-Type": "revisit" if payload is None else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        # A header value is one line; the URL is kept whole, with line ends and other control bytes escaped.
        "WARC-Target-URI": "".join(c if c.isprintable() and c not in "% " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or ""),
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": base32_sha1(block),
        "Page-Id": "" if page_id is None else str(page_id),
    }
    if payload is None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "Refers-To-Page-Id": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, object]:
    """Headers and block of one record; raises ``Malformed`` on a broken header, length or digest."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Malformed("no WARC version or header end")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Malformed("header line without colon")
        fields[name.strip().lower()] = value.strip()
    for name in MANDATORY:
        if name.lower() not in fields:
            raise Malformed(f"{name} is missing")
    if not fields["content-length"].isdigit():
        raise Malformed("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Malformed(f"block of {len(rest) - 4} bytes, Content-Length {size}")
    block = rest[:size]
    if fields.get("warc-block-digest", base32_sha1(block)) != base32_sha1(block):
        raise Malformed("block digest differs")
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = next((v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), b"").strip()
    if not mark or not length.isdigit():
        raise Malformed("no HTTP header or length")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != int(length) or fields.get("warc-payload-digest") != base32_sha1(payload)):
        raise Malformed("payload length or digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise Malformed("revisit with a payload or without reference")
    if kind not in ("response", "revisit"):
        raise Malformed(f"record type {kind}")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return {"fields": fields, "kind": kind, "bytes": int(length), "digest": base64.b32decode(digest).hex(), "payload": payload if kind == "response" else None}


class Archive:
    """An archive in memory: the dictionary frame, then one frame a record."""

    def __init__(self, dictionary: bytes | None, level: int = 3):
        self.out = io.BytesIO()
        if dictionary:
            packed = zstandard.compress(dictionary)
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.frames = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        self.records = 0

    def add(self, record: bytes) -> None:
        self.out.write(self.frames.compress(record))
        self.records += 1


def train(samples: list[bytes]) -> bytes | None:
    """A dictionary from sample records; None where they are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def read_dictionary(stream) -> tuple[bytes | None, bytes]:
    """(dictionary, bytes read that belong to the first record)."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        return None, head
    size = struct.unpack("<I", head[4:])[0]
    data = stream.read(size)
    if len(data) != size:
        raise Malformed("dictionary frame cut short")
    if struct.unpack("<I", data[:4])[0] == FRAME_MAGIC:
        data = zstandard.decompress(data)
    if struct.unpack("<I", data[:4])[0] != RAW_DICTIONARY_MAGIC:
        raise Malformed("leading frame holds no dictionary")
    return data, b""


def read_frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one a frame, holding one record and one chunk in memory."""
    dictionary, rest = read_dictionary(stream)
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        one, parts = frames.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(rest))
            except zstandard.ZstdError as error:
                raise Malformed(f"frame: {error}") from error
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(chunk)
            if not rest:
                raise Malformed("frame cut short")
        yield b"".join(parts)


def with_references(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, refers_to``: whose payload repeats which page's.

    Digests are grouped before any page is moved.  Payloads below ``least`` bytes get a key of their own, so they
    don't meet in one partition; a large group of equal payloads is split by adaptive execution.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    keepers = materialize(
        rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("payload_digest").alias("key"), "keeper"),
        "equal-payloads",
    )
    key = F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("key", key).join(keepers, "key", "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _write(folder: str, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, payload, size, digest, refers in zip(*(batch.column(k) for k in range(6)), strict=True):
                    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                    body = None if refers.is_valid else payload.as_py()
                    yield record_bytes(page.as_py(), url.as_py(), body, sha1, size.as_py(), refers.as_py(), date)

        stream, samples, total = records(), [], 0
        for record in stream:
            samples.append(record)
            total += len(record)
            if len(samples) >= SAMPLE_RECORDS or total >= SAMPLE_BYTES:
                break
        dictionary, archive = train(samples), None
        for source in (samples, stream):
            for record in source:
                archive = archive or Archive(dictionary)
                archive.add(record)
                if archive.out.tell() >= archive_bytes:
                    yield _close(folder, archive)
                    archive = None
        if archive:
            yield _close(folder, archive)

    return run


def _close(folder: str, archive: Archive) -> pa.RecordBatch:
    name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
    write_whole(name, archive.out.getbuffer())
    return pa.record_batch([pa.array([name]), pa.array([archive.records], pa.int64()), pa.array([archive.out.tell()], pa.int64())], ["archive", "records", "bytes"])


def write_archives(pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives; returns the manifest ``archive, records, bytes``.

    A null html has an empty payload; extra columns are not archived; an empty table gives no archive.  Of records
    with equal payloads of at least ``least`` bytes the largest ``page_id`` is the response and the others revisit
    it (rows that repeat this id are responses too; rows with null ids revisit).
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return materialize(with_references(pages, least).mapInArrow(_write(folder, archive_bytes, date), "archive string, records long, bytes long"), "warc-manifest")


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``manifest``; a malformed record is a row with ``error`` and nulls.

    After a broken frame the rest of its archive can't be found and is that one error row.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = open_store(name)
                with store.open_input_stream(path, compression=None) as stream:
                    yield from _rows(stream)

    def _rows(stream) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        frames = read_frames(stream)
        while True:
            try:
                record = next(frames, None)
                if record is None:
                    break
                x = parse_record(record)
                f = x["fields"]
                number = lambda k: int(f[k]) if f.get(k) else None
                rows.append((number("page-id"), _unescape(f.get("warc-target-uri", "")), x["bytes"], x["digest"], x["kind"], number("refers-to-page-id"), x["payload"] if payloads else None, None))
                held += len(record)
            except Malformed as error:
                rows.append((None,) * 7 + (str(error),))
            if held >= 8 << 20 or len(rows) >= 2000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    _batch = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    return manifest.select("archive").repartition(F.col("archive")).mapInArrow(run, SCHEMA)


def _unescape(uri: str) -> str:
    from urllib.parse import unquote

    return unquote(uri)
