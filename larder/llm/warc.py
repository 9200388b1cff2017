"""WARC archives of web pages: written in segments, read back by reassembly.

A record's block is an HTTP response whose body is in chunked transfer framing. Blocks beyond
``segment_bytes`` are split: the first segment keeps the record's type, the others are ``continuation``
records that name their origin, and the last one states the total length. A reader meets the segments
in any order and in any file.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import stage, stage_path

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
#: With segments of bounded size this bounds a file, which a reader takes as one row.
RECORDS_PER_FILE = 1024
#: Ends each record, and is what the text writer puts after each row.
RECORD_END = "\r\n\r\n"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing (RFC 9112)."""
    out = [b"%x\r\n%b\r\n" % (len(piece), piece) for at in range(0, len(payload), size) if (piece := payload[at : at + size])]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += size + 2


def _head(fields: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    lines = [f"{name}: {value}\r\n".encode() for name, value in fields if value is not None]
    return VERSION + b"".join(lines) + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _uri(url: str | None) -> str | None:
    """A header value is one line: control characters are percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page, each without its end mark. A page that refers to another is a revisit."""
    identity = record_id(page_id, digest)
    fields: list[tuple[str, str | int | None]] = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", identity),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        yield _head(fields + more, status + b"\r\n")
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    if len(pieces) == 1:
        yield _head(fields, block)
        return
    yield _head([*fields, ("WARC-Segment-Number", 1)], pieces[0])
    for number, piece in enumerate(pieces[1:], 2):
        yield _head(
            [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{identity}#{number}')}>"),
                ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", identity),
                ("WARC-Segment-Number", number),
                ("WARC-Segment-Total-Length", len(block) if number == len(pieces) else None),
            ],
            piece,
        )


def write_archives(
    pages: DataFrame,
    path: str,
    payload: str = "html",
    url: str = "url",
    id_column: str = "page_id",
    least_revisit: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write the pages as WARC files under ``path``.

    Of pages with equal payloads of at least ``least_revisit`` bytes the one with the smallest id is a
    response and the others revisit it. A null payload is empty, a null url leaves the header out, and a
    page without an id is the response only where all of its group lack one. A row that repeats id and
    payload of the response is a response too. Other columns are not read.
    """
    picked = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    key = picked.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least_revisit)
    first = stage(key.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "warc-first")
    marked = picked.withColumn("sha", F.when(F.octet_length("payload") >= least_revisit, F.sha1("payload"))).join(first, "sha", "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                body = row["payload"]
                records = list(records_of(row["page_id"], row["url"], body, payload_digest(body), row["refers_to"], segment_bytes))
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    records = marked.select("page_id", "url", "payload", refers_to.alias("refers_to")).mapInArrow(write, "record binary")
    # The cast keeps the bytes as they are; the writer puts the end mark after each.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of a file."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION, at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at + len(VERSION) : end].decode().split("\r\n"))
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != RECORD_END.encode():
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield fields, data[start:stop]
        at = stop + 4


def _page(identity: str | None) -> int | None:
    number = identity.split(":")[2] if identity else ""
    return int(number) if number else None


_RECORD = pa.schema(
    [
        ("origin", pa.string()),
        ("type", pa.string()),
        ("segment", pa.int32()),
        ("total", pa.int64()),
        ("block", pa.binary()),
        ("url", pa.string()),
        ("digest", pa.string()),
        ("length", pa.int64()),
        ("refers_to", pa.string()),
    ]
)
_RECORD_SQL = "origin string, type string, segment int, total bigint, block binary, url string, digest string, length bigint, refers_to string"
_PAGE = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)
_PAGE_SQL = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``; whole records and segments alike."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for fields, block in parse_archive(data.as_py()):
                    get = fields.get
                    rows.append(
                        {
                            "origin": get("WARC-Segment-Origin-ID") or fields["WARC-Record-ID"],
                            "type": fields["WARC-Type"],
                            "segment": int(get("WARC-Segment-Number", 0)),
                            "total": int(total) if (total := get("WARC-Segment-Total-Length")) else None,
                            "block": block,
                            "url": get("WARC-Target-URI"),
                            "digest": get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                            "length": int(get("WARC-Payload-Length", 0)),
                            "refers_to": get("WARC-Refers-To"),
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, _RECORD_SQL)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages from records whose ``segments`` are all there, in order; lengths and digests are verified."""
    for batch in batches:
        pages = []
        for row in batch.to_pylist():
            block = b"".join(row["segments"])
            if row["total"] is not None and row["total"] != len(block):
                raise ValueError(f"{row['origin']}: {len(block)} of {row['total']} bytes")
            payload = None
            if row["type"] == "response":
                head, _, body = block.partition(b"\r\n\r\n")
                payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if payload_digest(payload) != row["digest"] or len(payload) != row["length"]:
                    raise ValueError(f"{row['origin']}: the payload is not what its record says")
            page = {
                "page_id": _page(row["origin"]),
                "url": row["url"],
                "payload": payload,
                "payload_bytes": row["length"],
                "payload_digest": row["digest"],
                "record_type": row["type"],
                "refers_to": _page(row["refers_to"]),
            }
            pages += [page] * row["copies"]
        yield pa.RecordBatch.from_pylist(pages, schema=_PAGE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page_id, url, payload (null for a revisit), payload_bytes, payload_digest,
    record_type, refers_to.

    Segments are grouped by the record they continue and ordered by number. The job fails if a number is
    missing, if the length is not the stated total, if chunk framing is broken or if a digest differs.
    Records with the same id are copies with the same bytes: put together once and returned as often as
    they occur. Archives without records give no rows.
    """
    records = read_records(spark, path)
    common = ["origin", "type", "url", "digest", "length", "refers_to", "total"]
    whole = records.filter("segment = 0").select(*common, F.array("block").alias("segments"), F.lit(1).cast("long").alias("copies"))
    parts = records.filter("segment > 0").groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("url", "digest", "length", "refers_to")],
        F.max("total").alias("total"),
        F.sum((F.col("segment") == 1).cast("long")).alias("copies"),
    )
    gapless = (F.element_at("parts", -1)["segment"] == F.size("parts")) & F.col("total").isNotNull() & (F.col("copies") > 0)
    ordered = F.when(gapless, F.transform("parts", lambda p: p["block"])).otherwise(F.raise_error(F.concat(F.lit("missing segments of "), F.col("origin"))))
    parts = parts.select(*common, ordered.alias("segments"), "copies")
    return whole.unionByName(parts).mapInArrow(_decode, _PAGE_SQL)


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives where every executor can write."""
    return stage_path(spark, "warc")
