"""FASTQ parsing, BGZF blocks and gzip members; all but ``write_parts`` is free of Spark."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs

BLOCK_LIMIT = 1 << 16
BGZF_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
ERRORS = ("InvalidFormat", "IncompleteRecord", "MismatchedSequenceQuality", "StreamError", "DecompressionBomb")


class FormatError(ValueError):
    """Names one of ``ERRORS`` first."""


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and its name there."""
    path = "s3" + path[3:] if path.startswith(("s3a://", "s3n://")) else path
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_parts(rows, path: str, encode: Callable[[Iterable[pa.RecordBatch]], Iterable[bytes]], suffix: str) -> None:
    """A file for each partition of a DataFrame, written as ``encode`` gives it and moved into place when it is whole, so a task that runs again does no harm."""

    def run(batches):
        from pyspark import TaskContext

        where, name = filesystem(path)
        where.create_dir(name)
        made, target = f"{name.rstrip('/')}/_{uuid.uuid4().hex}", f"{name.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.{suffix}"
        with where.open_output_stream(made) as out:
            for piece in encode(batches):
                out.write(piece)
        where.move(made, target)
        yield pa.RecordBatch.from_arrays([pa.array([target])], ["path"])

    rows.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


@dataclass
class Limit:
    """The last byte at which a record of a range may start, which may become known only while reading."""

    bytes: int = 0
    known: bool = False


def sniff(head: bytes) -> str:
    """none, gzip or bgzf from a file's first bytes."""
    if head[:2] != b"\x1f\x8b":
        return "none"
    return "bgzf" if len(head) >= 18 and head[3] & 4 and _block_size(head) is not None else "gzip"


def _block_size(head: bytes) -> int | None:
    """The whole size of a BGZF block from its header, by its BC subfield."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, 12 + extra
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def bgzf_blocks(stream, begin: int = 0, end: int | None = None, max_ratio: int = 0) -> Iterator[tuple[int, bytes]]:
    """Offset and data of the blocks from the first that starts at or after ``begin``; ``end`` stops before a later one.

    A block over 64 KiB, or over ``max_ratio`` (0: no limit) times its compressed size, is refused.
    """
    at = begin if begin == 0 else _next_block(stream, begin)
    while at is not None and (end is None or at < end):
        stream.seek(at)
        head = stream.read(18)
        if not head:
            return
        if len(head) == 18 and 12 + struct.unpack_from("<H", head, 10)[0] > 18:
            head += stream.read(struct.unpack_from("<H", head, 10)[0] - 6)
        size = _block_size(head)
        if size is None:
            raise FormatError(f"StreamError: no BGZF block at byte {at}")
        body = head + stream.read(size - len(head))
        if len(body) < size:
            raise FormatError(f"StreamError: truncated BGZF block at byte {at}")
        isize = struct.unpack_from("<I", body, size - 4)[0]
        payload = body[12 + struct.unpack_from("<H", head, 10)[0] : size - 8]
        if isize > BLOCK_LIMIT or max_ratio and isize > max_ratio * max(1, len(payload)):
            raise FormatError(f"DecompressionBomb: {isize} bytes from {len(payload)} at byte {at}")
        inflater = zlib.decompressobj(-15)
        data = inflater.decompress(payload, BLOCK_LIMIT + 1)
        if len(data) != isize or zlib.crc32(data) != struct.unpack_from("<I", body, size - 8)[0]:
            raise FormatError(f"StreamError: damaged BGZF block at byte {at}")
        yield at, data
        at += size


def _next_block(stream, begin: int) -> int | None:
    """The first block start at or after a byte: a header whose size leads to another header or the end."""
    stream.seek(begin)
    window = stream.read(3 * BLOCK_LIMIT)
    found = -1
    while (found := window.find(b"\x1f\x8b\x08\x04", found + 1)) >= 0:
        size = _block_size(window[found : found + 64])
        if size and (window[found + size : found + size + 4] in (b"\x1f\x8b\x08\x04", b"") or found + size >= len(window)):
            return begin + found
    return None


def bgzf_stream(pieces: Iterable[bytes], block: int = 0xFF00, level: int = 6) -> Iterator[bytes]:
    """Data as BGZF blocks, each given as soon as it is full, and the end-of-file block."""

    def packed(part: bytes) -> bytes:
        deflater = zlib.compressobj(level, zlib.DEFLATED, -15)
        payload = deflater.compress(part) + deflater.flush()
        return struct.pack("<4BI2BH2BHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, 66, 67, 2, len(payload) + 25) + payload + struct.pack("<II", zlib.crc32(part), len(part))

    rest = b""
    for piece in pieces:
        data = rest + piece
        whole = len(data) // block * block
        for i in range(0, whole, block):
            yield packed(data[i : i + block])
        rest = data[whole:]
    if rest:
        yield packed(rest)
    yield BGZF_EOF


def bgzf_compress(data: bytes, block: int = 0xFF00, level: int = 6) -> bytes:
    """Data as BGZF blocks and the end-of-file block."""
    return b"".join(bgzf_stream([data], block, level))


def gunzip(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The data of all members of a gzip stream, incrementally, wherever chunks end."""
    inflater, fed, ahead = zlib.decompressobj(31), False, b""
    for chunk in chunks:
        chunk, ahead = ahead + chunk, b""
        while chunk:
            fed = True
            yield inflater.decompress(chunk)
            chunk = inflater.unused_data
            if inflater.eof:
                inflater, fed = zlib.decompressobj(31), False
                if chunk == b"\x1f":
                    # The next member's first two bytes may stand in two chunks.
                    chunk, ahead = b"", chunk
                elif not chunk.startswith(b"\x1f\x8b"):
                    chunk = b""
    if fed or ahead:
        raise FormatError("StreamError: truncated gzip stream")


def lines(chunks: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each line, without line ends; a last line needs none."""
    rest: list[bytes] = []
    at = 0
    for chunk in chunks:
        parts = chunk.split(b"\n")
        if len(parts) > 1:
            # What a long line began is joined once, when its end is met.
            parts[0] = b"".join([*rest, parts[0]])
            rest = []
        last = parts.pop()
        if last:
            rest.append(last)
        for part in parts:
            yield at, part[:-1] if part.endswith(b"\r") else part
            at += len(part) + 1
    if tail := b"".join(rest):
        yield at, tail[:-1] if tail.endswith(b"\r") else tail


Record = tuple[str, str, str, str | None]
COLUMNS = ("id", "seq", "qual", "_error")


def _after(may: int, mark: bool) -> int:
    """The lines of a record that a reader may be at, as bits, after a line that starts with @ or not."""
    return (may & 1) << mark | (may << 1 & 0b1100) | may >> 3


_AFTER = [[_after(m, False), _after(m, True)] for m in range(16)]


def _merge(may: int, marks: np.ndarray, line: int) -> tuple[int, int]:
    """Go on from a line until a reader can be at one place only; the places left, and the next line."""
    while may & (may - 1) and line < len(marks):
        may, line = _AFTER[may][int(marks[line])], line + 1
    return may, line


def _heads(marks: np.ndarray, line: int) -> tuple[np.ndarray, int]:
    """The first lines of whole records from a line on where one may start, and the line after them."""
    found, size, at = [np.empty(0, np.int64)], 1, np.flatnonzero(marks)
    while (i := np.searchsorted(at, line)) < len(at):
        line = int(at[i])
        whole = marks[line : line + 4 * min(size, (len(marks) - line) // 4) : 4]
        if not len(whole):
            return np.concatenate(found), line
        run = len(whole) if whole.all() else int(whole.argmin())
        found.append(np.arange(line, line + 4 * run, 4))
        line += 4 * run
        # Longer looks ahead only where no junk stands between records.
        size = 2 * size if run == len(whole) else 1
    return np.concatenate(found), len(marks)


def _strings(data: bytes, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of data, in order; what isn't UTF-8 is replaced."""
    offsets, plain = np.stack([begins, ends], 1).ravel().astype(np.int32), data.isascii()
    # Every second element is what lies between two slices.
    every = pa.Array.from_buffers(pa.string() if plain else pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    found = every.take(pa.array(np.arange(0, len(offsets), 2)))
    return found if plain else pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())


def _batch(data: bytes, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, heads: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    made = []
    for c in columns:
        if c == "_error":
            unequal = ends[heads + 1] - begins[heads + 1] != ends[heads + 3] - begins[heads + 3]
            kind = np.where(raw[begins[heads + 2]] != 43, 0, np.where(unequal, 1, 2))
            made.append(pa.array(["InvalidFormat", "MismatchedSequenceQuality", None], pa.string()).take(pa.array(kind)))
        else:
            line = heads + {"id": 0, "seq": 1, "qual": 3}[c]
            made.append(_strings(data, begins[line] + (c == "id"), ends[line]))
    return pa.RecordBatch.from_arrays(made, columns)


def batches(chunks: Iterable[bytes], limit: Limit | None = None, resync: bool = False, incomplete: bool = False, columns: Iterable[str] = COLUMNS, least: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The records of a stream, or of a range of it: all ranges together give what the whole stream gives, broken records included.

    Read from the top, a line that starts with @ begins a record of four lines;
    others are skipped where a record may start. A reader that begins elsewhere
    (``resync``) may be at any of four places; it skips the line it begins in,
    part of the range before, and follows the four until they have become one.
    There its records start. A range ends where the next one, cut at ``limit``,
    finds its start in the same way. Where every quality begins with @ the places
    may stay apart up to the end; then the range before goes on to there.

    A cut last record is dropped, or given with its error if ``incomplete``.
    """
    columns, feed, tail, follows, base = list(columns), iter(chunks), b"", True, 0
    skip, may = (1, 0b1111) if resync else (0, 1)
    stop, stop_may, passed = None, 0b1111, None
    while follows:
        held, size = [tail], 0
        # What is left of a long line or record is joined when as much again has come.
        while size < max(1, len(tail), 0 if limit is not None and limit.known else least):
            if (chunk := next(feed, None)) is None:
                follows = False
                break
            held.append(chunk)
            size += len(chunk)
        data = b"".join(held)
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10)
        if not follows and data and raw[-1] != 10:
            ends = np.append(ends, len(data))
        begins = np.minimum(np.concatenate([[0], ends + 1]), len(data))
        marks = raw[begins[:-1]] == 64
        line, skip = min(skip, len(marks)), max(0, skip - len(marks))
        may, line = _merge(may, marks, line)
        while may > 1 and not may & (may - 1) and line < len(marks):
            # The rest of a record of the range before.
            may, line = _AFTER[may][0], line + 1
        if stop is None and limit is not None and limit.known:
            passed = limit.bytes if passed is None else passed
            at = int(np.searchsorted(base + begins[:-1], passed, "right"))
            stop_may, after = _merge(stop_may, marks, at)
            if after > at:
                passed = base + int(begins[after - 1])
            if not stop_may & (stop_may - 1):
                stop = base + int(begins[after])
        heads, line = _heads(marks, line) if may == 1 else (np.empty(0, np.int64), len(marks))
        if stop is not None:
            heads = heads[base + begins[heads] < stop]
        ends -= (ends > begins[:-1]) & (raw[ends - 1] == 13)
        if len(heads):
            yield _batch(data, raw, begins, ends, heads, columns)
        begin = int(begins[line])
        if stop is not None and base + begin >= stop:
            return
        if not follows and incomplete and line < len(marks):
            id_, seq = ([data[b:e].decode("utf-8", "replace") for b, e in zip(begins[line:-1], ends[line:])] + [""])[:2]
            row = dict(zip(COLUMNS, (id_[1:], seq, "", "IncompleteRecord")))
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], pa.string()) for c in columns], columns)
        base, tail = base + begin, data[begin:]


def records(numbered: Iterable[tuple[int, bytes]], resync: bool = False, incomplete: bool = False) -> Iterator[Record]:
    """Records (id, seq, qual, error) of lines."""
    for b in batches((line + b"\n" for _, line in numbered), None, resync, incomplete):
        yield from zip(*(c.to_pylist() for c in b.columns))
