"""Zstandard web archives: a dictionary in the leading skippable frame, one frame per record.

A file is `.warc.zst`: first a skippable frame (magic 0x184D2A5D) that holds the
compression dictionary, then one Zstandard frame for each WARC/1.1 record. The
reader loads the dictionary from that frame, decodes frame after frame and
checks version line, required headers, lengths, the end of the record and the
payload digest. Pages with equal payloads are stored once; the others refer to it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, work_path
from .common import SharedFolder, join_groups, spread_files, table, utf8

#: Payloads of fewer bytes are always stored in full.
REVISIT_BYTES = 1000
#: An archive file is closed once it has this many bytes.
FILE_BYTES = 256 << 20
#: The dictionary is trained on about so many pages, of each at most so many characters.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 16_384, 64 << 10
READ_BYTES = 1 << 20

# Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

_WRITTEN = "folder string, name string, n long, bytes long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


class BadRecord(ValueError):
    """An archive that breaks the format."""


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    target = "".join((url or "about:blank").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    found = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord(f"header without a colon: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def _length(headers: dict[str, str]) -> int:
    text = headers.get("content-length", "")
    if not (text.isascii() and text.isdigit()):
        raise BadRecord(f"content length {text[:40]!r}")
    return int(text)


def parse_record(raw: bytes) -> dict:
    """One record as page, type, reference, address, payload and the payload's length and digest."""
    version, _, rest = raw.partition(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord(f"version line {version[:40]!r}")
    head, gap, rest = rest.partition(b"\r\n\r\n")
    if not gap:
        raise BadRecord("the headers do not end")
    headers = _headers(head)
    if missing := [h for h in REQUIRED if h not in headers]:
        raise BadRecord(f"without {', '.join(missing)}")
    n = _length(headers)
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadRecord(f"{len(rest)} bytes after the headers, {n + 4} expected")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    if not gap:
        raise BadRecord("the block has no whole HTTP head")
    size = _length(_headers(http.partition(b"\r\n")[2]))
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size:
            raise BadRecord(f"payload of {len(payload)} bytes, {size} expected")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise BadRecord("the payload does not match its digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in headers:
        raise BadRecord(f"not a response, nor a revisit without payload: {kind[:40]!r}")
    return {
        "page_id": _page_of(headers["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_of(headers["warc-refers-to"]) if kind == "revisit" else None,
        "url": headers.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame in front of a file; the dictionary in it is itself compressed."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(packed)) + packed


def _take(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise BadRecord("the file ends within its dictionary frame")
    return bytes(data)


def read_frames(f) -> Iterator[bytes]:
    """The decoded frames of an open archive; memory holds one record at a time."""
    head = bytes(f.read(4))
    if not head:
        return
    decoder = zstandard.ZstdDecompressor()
    if head == struct.pack("<I", SKIPPABLE_DICTIONARY):
        raw = _take(f, struct.unpack("<I", _take(f, 4))[0])
        if raw[:4] == ZSTD_MAGIC:
            raw = decoder.decompress(raw)
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        head = b""
    rest = head or bytes(f.read(READ_BYTES))
    while rest:
        frame, parts = decoder.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise BadRecord(f"a frame cannot be decoded: {e}") from e
            if frame.eof:
                break
            rest = bytes(f.read(READ_BYTES))
            if not rest:
                raise BadRecord("the file ends within a frame")
        rest = frame.unused_data or bytes(f.read(READ_BYTES))
        yield b"".join(parts)


def train_dictionary(pages: DataFrame, html: str, total: int) -> bytes:
    """A dictionary from a bounded sample, even over the table by a hash of the page; empty if there are no pages."""
    part = F.pmod(F.xxhash64(html), F.lit(1 << 30)) / (1 << 30)
    sample = pages.filter(part <= min(1.0, SAMPLE_PAGES / max(total, 1)))
    rows = sample.select(F.substring(html, 1, SAMPLE_CHARS).alias("x")).distinct().orderBy("x").limit(2 * SAMPLE_PAGES)
    samples = [r.x.encode() for r in rows.collect() if r.x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples: their text itself serves
        return b"".join(samples)[:DICTIONARY_BYTES]


def _write_task(uri: str, dictionary: bytes, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, part = SharedFolder(uri), TaskContext.get().partitionId()
        encoder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (0, 1)), utf8(b.column(2)), *(b.column(k).to_pylist() for k in (3, 4))))
        row, k = next(rows, None), 0
        while row is not None:
            name, n, size = f"part-{part:06d}-{k:04d}.warc.zst", 0, 0
            with folder.create(name) as out:
                if dictionary:
                    out.write(dictionary_frame(dictionary))
                while row is not None and size < file_bytes:
                    page_id, url, html, refers_to, revisit = row
                    frame = encoder.compress(build_record(page_id, url, html or b"", refers_to, revisit))
                    out.write(frame)
                    n, size, row = n + 1, size + len(frame), next(rows, None)
            yield pa.RecordBatch.from_pydict({"folder": [uri], "name": [name], "n": [n], "bytes": [size]})
            k += 1

    return run


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per page to archives in the shared folder; one row per file.

    Of pages with equal payloads of at least REVISIT_BYTES bytes the one with the
    largest id holds the payload, the others revisit it. Null html is an empty
    payload. Repeated rows with that largest id all hold the payload; pages
    without an id are never referred to. No pages give no files.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = rows.withColumn("payload_sha256", F.sha2(F.col("html").cast("binary"), 256))
    sizes = rows.agg(F.count("*").alias("n")).first()
    large = keyed.filter(F.octet_length("html") >= REVISIT_BYTES)
    groups = large.groupBy("payload_sha256").agg(F.max("page_id").alias("top_id"), F.count("*").alias("copies"))
    groups = materialize(groups.filter("copies > 1 AND top_id IS NOT NULL"), "page-groups")
    joined = join_groups(keyed, groups, "payload_sha256", "copies", sizes.n)
    revisit = F.col("top_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top_id"))
    plan = joined.select("page_id", "url", "html", F.when(revisit, F.col("top_id")).alias("refers_to"), revisit.alias("revisit"))
    task = _write_task(work_path(spark, "warc"), train_dictionary(rows, "html", sizes.n), FILE_BYTES)
    return materialize(plan.mapInArrow(task, _WRITTEN), "warc-files")


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for file in batch.to_pylist():
            held, size, seen = [], 0, 0
            with SharedFolder(file["folder"]).open(file["name"]) as f:
                for raw in read_frames(f):
                    try:
                        held.append(parse_record(raw))
                    except BadRecord as e:
                        raise BadRecord(f"{file['name']}, record {seen}: {e}") from e
                    seen, size = seen + 1, size + len(raw)
                    if len(held) >= 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
            if seen != file["n"]:
                raise BadRecord(f"{file['name']}: {seen} records, {file['n']} were written")
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_archives(files: DataFrame) -> DataFrame:
    """All records of the listed files; a file that breaks the format fails the read with its name."""
    return spread_files(files).select("folder", "name", "n").mapInArrow(_read_task, _RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     g AS (SELECT html, max(page_id) AS top_id FROM p WHERE strlen(html) >= {REVISIT_BYTES} GROUP BY html HAVING count(*) > 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id <> top_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> top_id THEN top_id END AS refers_to
FROM p LEFT JOIN g USING (html)
"""

QUERIES = {"op10_warc": op10_warc}
SQL = {"op10_warc": OP10_SQL}
