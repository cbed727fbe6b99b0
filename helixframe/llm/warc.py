"""WARC archives with revisit resolution.

Headers (page_id, size and digest, built in SQL) are shuffled by digest, without
payloads, to find the response of each payload that several pages share. Pages
then look their digest up: in a broadcast table of the shared digests where that
is small (its rows are counted first), otherwise in the resolved headers, which
join the pages by page_id. So no payload is shuffled by its digest, and a payload
that many pages hold is no hot key.

Archives are written by the tasks that hold the pages, a gzip member per WARC/1.1
record with fresh headers, in files of about ``FILE_BYTES``. A list of files, which
Spark writes, names those of tasks that succeeded; files that a lost or repeated
task left are not read. They are read back record by record, by length.

A null payload is an empty one. Among equal payloads of at least ``min_bytes``
the smallest page_id is the response and the others revisit it; rows that repeat
that page_id are responses too. Smaller payloads are always responses. A null
page_id is never a target that others refer to while another id has the payload;
such rows are revisits. Line ends in a URL are dropped. An empty table gives no
rows; a page of any length is one record, which a task must hold; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import parsing
from .common import bounded, settle, shared_path

#: Parts over which the headers of one digest are dealt.
SALTS = 64
#: Bytes after which a file is full, and of a table that is looked up by broadcast.
FILE_BYTES, LOOKUP_BYTES = 32 << 20, 64 << 20
#: What a row of a shared digest takes in memory, at most; and such rows in a file.
_LOOKUP_ROW, _LOOKUP_FILE = 200, 200_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string's UTF-8 in bare upper-case base32, from 20-bit groups of its hex form."""
    hexed, out = F.sha1(payload), []
    for i in range(8):
        group = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(group, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def resolve(pages: DataFrame, min_bytes: int = 0, lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select("page_id", "url", html.alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": base32_sha1(F.col("html"))})
    headers = full.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest")
    shared = (
        headers.groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_id is not null")
        .select(F.col("payload_digest").alias("d"), "first_id")
    )
    shared = settle(shared, "shared", 1 + headers.count() // _LOOKUP_FILE)
    if shared.count() * _LOOKUP_ROW <= lookup_bytes:
        found = full.join(F.broadcast(shared), F.col("payload_digest") == F.col("d"), "left")
    else:
        salted = headers.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        copies = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = salted.withColumnRenamed("payload_digest", "d").join(copies, ["d", "salt"]).select(F.col("page_id").alias("id"), "d", "first_id").distinct()
        found = full.join(known, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("d")), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= min_bytes)
    return found.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, html: str | None, size: int, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record: fresh WARC and HTTP headers, and the payload of a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (html or "").encode() if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", re.sub("[\r\n]", "", url or "")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    deflater = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflater.compress(data) + deflater.flush()


_FIELDS = ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compressed: bool = True, file_bytes: int = FILE_BYTES) -> None:
    """Write each resolved page as one record below ``path``; a revisit's payload doesn't reach the writer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, name = parsing.filesystem(f"{path}/archives")
        where.create_dir(name)
        out, made, done = None, "", []
        count = size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _FIELDS)):
                if out is None:
                    made, count, size = f"{uuid.uuid4().hex}.warc{'.gz' if compressed else ''}", 0, 0
                    out = where.open_output_stream(f"{name}/{made}", compression=None)
                data = record(*row, date)
                data = _member(data) if compressed else data
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    out = done.append((made, count, size))
        if out is not None:
            out.close()
            done.append((made, count, size))
        columns = list(zip(*done)) if done else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    needed = resolved.withColumn("html", F.when(F.col("record_type") == "response", F.col("html"))).select(*_FIELDS)
    needed.mapInArrow(bounded(run), "file string, records bigint, bytes bigint").write.mode("overwrite").parquet(f"{path}/files")


def parse_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict, bytes, bytes]]:
    """The records of an archive: header fields, the HTTP header, and the payload after it."""
    feed, data, at = iter(chunks), bytearray(), 0

    def more() -> bool:
        # The end of a gzip member gives an empty chunk, after which there may be nothing.
        if (chunk := next(filter(None, feed), None)) is None:
            return False
        data.extend(chunk)
        return True

    while data or more():
        while (head_end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError(f"truncated WARC record at byte {at}")
        lines = data[:head_end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        begin = head_end + 4
        end = begin + int(fields["Content-Length"])
        while len(data) < end + 4:
            if not more():
                raise ValueError(f"truncated WARC record at byte {at}")
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"truncated WARC record at byte {at}")
        http, _, payload = bytes(data[begin:end]).partition(b"\r\n\r\n")
        yield fields, http, payload
        del data[: end + 4]
        at += end + 4


_OUT = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
_NAMES = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
_ID = re.compile(r"<urn:page:(-?\d+)>")


def _record(fields: dict, http: bytes, payload: bytes) -> tuple:
    number = lambda k: int(m[1]) if (m := _ID.fullmatch(fields.get(k, ""))) else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    said = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != said or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload and headers of {fields['WARC-Record-ID']} differ")
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, number("WARC-Refers-To"), said, digest, payload if kind == "response" else None


#: Records and payload bytes of the batches that a reader gives.
_ROWS, _BYTES = 256, 4 << 20


def read_file(path: str) -> Iterator[tuple]:
    """The rows of an archive file, plain or of gzip members, read as they come."""
    where, name = parsing.filesystem(path)
    with where.open_input_stream(name, compression=None) as stream:
        chunks = iter(lambda: stream.read(1 << 20), b"")
        first = next(chunks, b"")
        whole = (c for part in ([first], chunks) for c in part)
        yield from (_record(*r) for r in parse_records(parsing.gunzip(whole) if first.startswith(b"\x1f\x8b") else whole))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives listed below ``path``; a response whose payload contradicts its headers fails the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], list(_NAMES))
        for b in batches:
            for file in b.column(0).to_pylist():
                rows, size = [], 0
                for row in read_file(f"{path}/archives/{file}"):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) == _ROWS or size >= _BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.parquet(f"{path}/files").select("file")
    return files.repartition(max(1, files.count()), "file").mapInArrow(run, _OUT)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Resolve, write archives below the shared folder, and read them back."""
    spark = pages.sparkSession
    write_archives(resolve(pages, min_bytes), path := shared_path(spark, "warc"))
    return read_archives(spark, path)
