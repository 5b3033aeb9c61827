"""Operator 9: WARC archives whose records share a Zstandard dictionary.

Each task writes its pages to archives of bounded size. An archive's dictionary is built from its own
records and stands in a leading skippable frame; every record is then a frame of its own. Pages with a
payload met under a smaller page_id become revisit records without the payload. Archives lie in the shared
folder under names fixed by task and number, and appear by a rename, so a task that runs again replaces them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, join_unique, table

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE, TRAINED = 0x184D2A5D, 0xEC30A437
PAGE = "urn:page:"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in url or "" if c not in "\r\n") or "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{PAGE}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{PAGE}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A skippable frame with the dictionary, and a frame for each record."""
    try:
        words = zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8)
    except zstandard.ZstdError:  # too few records to train on: their text itself serves
        words = zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=LEVEL)
    made = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True)
    content = words.as_bytes()
    return b"".join([struct.pack("<II", SKIPPABLE, len(content)), content, *map(made.compress, records)])


def records_of(data: bytes):
    """The records of an archive, one after another."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    content = data[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == struct.pack("<I", TRAINED) else zstandard.DICT_TYPE_RAWCONTENT
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        frame = opened.decompressobj()
        step, parts = 1 << 16, []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + step]
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; the payload's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    name = lambda x: int(x[1:-1].removeprefix(PAGE)) if x[1:-1] != PAGE else None
    page, kind = name(fields["WARC-Record-ID"]), fields["WARC-Type"]
    if kind == "response":
        if (len(payload), base32_sha1(hashlib.sha1(payload).digest())) != (size, digest):
            raise ValueError(f"the payload of page {page} is not what was written")
        return page, size, digest, kind, None
    return page, size, digest, kind, name(fields["WARC-Refers-To"])


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def write_archives(pages: DataFrame, work: Workspace, folder: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, n_records) for the archives that the tasks write; running it writes them."""
    mine = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    mine = mine.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    mine = mine.withColumn("same", F.concat_ws(":", "sha1", F.col("size").cast("string")))
    first = mine.where(F.col("size") >= revisit_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).withColumn("met", F.lit(True))
    marked = join_unique(mine, work.keep(first, "first"), "same", "n", "page_id", "left")
    revisit = F.col("met").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = marked.select("page_id", "url", "payload", F.unhex("sha1").alias("digest"), F.when(revisit, F.col("first")).alias("first"), revisit.alias("revisit"))

    def run(batches):
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        system, where = _place(folder)
        system.create_dir(where, recursive=True)

        def close():
            name = f"pages-{task:06d}-{n:05d}.warc.zst"
            part = f"{where}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(part, compression=None) as to:
                to.write(archive(held))
            system.move(part, f"{where}/{name}")
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], ["archive", "n_records"])

        for batch in batches:
            for page, url, payload, digest, refers, again in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(record(page, url, payload, base32_sha1(digest), refers, again))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    n, held, size = n + 1, [], 0
        if held:
            yield close()

    bounded_batches(pages.sparkSession)
    return rows.mapInArrow(run, "archive string, n_records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives named in column archive."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, where = _place(uri)
                with system.open_input_stream(where, compression=None) as of:
                    rows = [parse(x) for x in records_of(of.read())]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.select("archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null or empty url becomes about:blank, and CR and LF, which a header line cannot
    hold, are left out of a url (they are in none of the returned columns). Among equal payloads the smallest page_id is
    the response, and so is each repeated row of it; a null page_id is one only if all of them are null. Other
    columns are ignored; an empty table gives no rows.
    """
    work = Workspace(pages.sparkSession, "warc")
    archives = work.keep(write_archives(pages, work, f"{work.root}/archives", revisit_bytes, archive_bytes), "archives")
    return read_archives(archives.repartition(max(1, min(10_000, archives.count())), "archive"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP9_ORACLE = """
WITH mine AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM mine),
coded AS (
  SELECT *, array_to_string(list_transform(range(4), lambda g: array_to_string(list_transform(range(8), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, 10 * g + 1, 10))::BIGINT >> (35 - 5 * k)) & 31) + 1)::INTEGER, 1)), '')), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first
  FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM coded
"""
