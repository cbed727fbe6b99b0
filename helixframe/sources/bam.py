"""Alignment records: the ``bam`` data source, split by BGZF blocks, a writer, and a simulated source.

A range owns the records that start in its blocks. BAM has no marks between
records, so a range that does not begin a file looks for the first byte from
which ``_CHAIN`` records in a row (or all up to the end) have plausible fixed
fields. Files that are not block-compressed are one range. Records are decoded as
they are read; a range holds a few blocks at a time.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ALIGNMENT
from . import parsing
from .fastq import _chunks, _open, expand

_TYPES = {"int": pa.int32(), "string": pa.string()}
_FIELDS = {f.name: _TYPES[f.dataType.simpleString()] for f in ALIGNMENT}
_ROWS, _CHAIN = 4096, 5

# The letters of BAM's 4-bit bases and CIGAR operators.
_BASES, _OPERATORS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_FROM_HEX = str.maketrans("0123456789abcdef", _BASES)
_TO_HEX = str.maketrans(_BASES, "0123456789abcdef")
_QUALITY = bytes(min(q + 33, 255) for q in range(256))
_FIXED = struct.Struct("<iiiBBHHHiiii")


class Stream:
    """Uncompressed data with the number of bytes that came from blocks of one's own."""

    def __init__(self, parts: Iterable[tuple[bool, bytes]]):
        self.parts, self.data, self.at, self.own, self.base = iter(parts), bytearray(), 0, 0, 0

    def more(self) -> bool:
        """Take in another part; False at the end."""
        for mine, data in self.parts:
            if self.at > 1 << 20:
                del self.data[: self.at]
                self.base, self.at = self.base + self.at, 0
            self.data += data
            self.own += len(data) if mine else 0
            return True
        return False

    def have(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True


def skip_header(stream: Stream) -> int:
    """Move past the header; the number of references."""

    def take(n: int) -> bytes:
        if n < 0 or not stream.have(n):
            raise parsing.FormatError("InvalidFormat: truncated BAM header")
        stream.at += n
        return bytes(stream.data[stream.at - n : stream.at])

    if take(4) != b"BAM\x01":
        raise parsing.FormatError("InvalidFormat: no BAM header")
    take(struct.unpack("<i", take(4))[0])
    references = struct.unpack("<i", take(4))[0]
    for _ in range(references):
        take(struct.unpack("<i", take(4))[0])
        take(4)
    return references


def _plausible(data: bytearray, at: int, references: int) -> int:
    """The size of the record that may start at ``at``, 0 if it can't be one, -1 if it goes on beyond the data."""
    if at + _FIXED.size > len(data):
        return -1
    size, ref, pos, name, _, _, cigar, _, bases, next_ref, next_pos, _ = _FIXED.unpack_from(data, at)
    least = 32 + name + 4 * cigar + (bases + 1) // 2 + bases
    if not (name >= 1 and bases >= 0 and -1 <= ref < references and -1 <= next_ref < references and pos >= -1 and next_pos >= -1 and size >= least):
        return 0
    end = at + 36 + name
    if end > len(data):
        return -1
    printable = all(33 <= c <= 126 for c in data[at + 36 : end - 1])
    return 4 + size if data[end - 1] == 0 and printable else 0


def find_record(stream: Stream, references: int) -> bool:
    """Move to the first byte from which records follow each other; False if none starts in the stream's own part."""
    while True:
        while stream.base + stream.at >= stream.own:
            # Data beyond one's own has been met, or there is no more.
            if stream.base + len(stream.data) > stream.own or not stream.more():
                return False
        found, ahead = True, 0
        for i in range(_CHAIN):
            while (size := _plausible(stream.data, stream.at + ahead, references)) < 0 and stream.more():
                pass
            if size <= 0:
                found = size < 0 and i > 0 and stream.at + ahead == len(stream.data)
                break
            ahead += size
        if found:
            return True
        stream.at += 1


def records(stream: Stream) -> Iterator[tuple]:
    """The records that start in the stream's own part."""
    while stream.have(1) and stream.base + stream.at < stream.own:
        if not stream.have(4) or not stream.have(4 + (size := struct.unpack_from("<i", stream.data, stream.at)[0])) or size < 32:
            raise parsing.FormatError("IncompleteRecord: truncated BAM record")
        data = bytes(stream.data[stream.at : stream.at + 4 + size])
        stream.at += 4 + size
        _, ref, pos, name, mapq, _, n_cigar, flag, n_seq, _, _, tlen = _FIXED.unpack_from(data)
        p = 36 + name
        cigar = "".join(f"{v >> 4}{_OPERATORS[v & 15]}" for v in struct.unpack_from(f"<{n_cigar}I", data, p))
        p += 4 * n_cigar
        q = p + (n_seq + 1) // 2
        quals = data[q : q + n_seq]
        qual = "" if quals[:1] == b"\xff" else quals.translate(_QUALITY).decode("latin-1")
        yield flag, ref, pos, mapq, cigar, data[p:q].hex().translate(_FROM_HEX)[:n_seq], qual, tlen


def bam_records(data: bytes) -> Iterator[tuple]:
    """The records of a BAM file's uncompressed data."""
    stream = Stream([(True, data)])
    skip_header(stream)
    yield from records(stream)


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int | None
    compression: str
    references: int


def _parts(part: Range, file) -> Iterator[tuple[bool, bytes]]:
    """The data of a range's own blocks, then of the blocks after them."""
    if part.compression == "bgzf":
        for at, data in parsing.bgzf_blocks(file, part.begin):
            yield part.end is None or at < part.end, data
    else:
        chunks = _chunks(file, 0)
        for data in parsing.gunzip(chunks) if part.compression == "gzip" else chunks:
            yield True, data


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.paths = [p for x in options["path"].split(",") for p in expand(x.strip())]
        self.split, self.columns = int(options.get("splitbytes", 64 << 20)), columns

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            with _open(path) as file:
                kind, size = parsing.sniff(file.read(64)), file.size()
                whole = Range(path, 0, None, kind, 0)
                references = skip_header(Stream(_parts(whole, file)))
            begins = range(0, size, self.split) if kind == "bgzf" else [0]
            out += [Range(path, b, b + self.split if kind == "bgzf" and b + self.split < size else None, kind, references) for b in begins]
        return out or [Range("", 0, 0, "empty", 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.compression == "empty":
            return
        with _open(partition.path) as file:
            stream = Stream(_parts(partition, file))
            if partition.begin == 0:
                skip_header(stream)
            elif not (stream.more() and stream.own and find_record(stream, partition.references)):
                return
            found = records(stream)
            while rows := list(itertools.islice(found, _ROWS)):
                columns = dict(zip(_FIELDS, zip(*rows)))
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], _FIELDS[c]) for c in self.columns], self.columns)


class BamDataSource(DataSource):
    """Options: ``columns`` (a comma-separated choice) and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        chosen = [c.strip() for c in self.options.get("columns", ",".join(_FIELDS)).split(",")]
        if unknown := set(chosen) - set(_FIELDS):
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        return type(ALIGNMENT)([f for c in chosen for f in ALIGNMENT if f.name == c])

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options), schema.names)


def read_bam(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Alignment records of BAM files."""
    spark.dataSource.register(BamDataSource)
    return spark.read.format("bam").options(**options).load(path)


def encode_record(flag: int, ref: int, pos: int, mapq: int, cigar: str, seq: str, qual: str, tlen: int) -> bytes:
    """One record, its read without a name."""
    ops, number = [], ""
    for c in cigar:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | _OPERATORS.index(c))
            number = ""
    packed = bytes.fromhex((seq + "=" * (len(seq) % 2)).translate(_TO_HEX))
    quals = bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(seq)
    body = b"*\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + quals
    return _FIXED.pack(32 + len(body), ref, pos, 2, mapq, 0, len(ops), flag, len(seq), -1, -1, tlen) + body


def encode_header(references: int) -> bytes:
    """A header of so many references, named by their number."""
    names = [b"%d\0" % i for i in range(references)]
    return b"BAM\x01" + struct.pack("<ii", 0, references) + b"".join(struct.pack("<i", len(n)) + n + struct.pack("<i", 1 << 29) for n in names)


def write_bam(rows: DataFrame, path: str, references: int) -> None:
    """A folder of block-compressed BAM files, one a partition; columns that are missing are empty."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
        found = (b"".join(encode_record(*r) for r in zip(*(b.column(c).to_pylist() for c in _FIELDS))) for b in batches)
        return parsing.bgzf_stream(itertools.chain([encode_header(references)], found))

    parsing.write_parts(rows.select(*(F.col(c) if c in rows.columns else F.lit("").alias(c) for c in _FIELDS)), path, encode, "bam")


def simulate_alignments(spark: SparkSession, records: int = 50_000, seed: int = 42) -> DataFrame:
    """Records made from hashes of their number, the same for any partitioning."""
    h = lambda i, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(n)).cast("int")
    matched = (h(5, 60) + 40).cast("string")
    return spark.range(records).select(
        h(1, 4096).alias("flag"), h(2, 24).alias("reference_id"), h(3, 1_000_000).alias("position"), h(4, 61).alias("mapping_quality"),
        F.concat(matched, F.lit("M")).alias("cigar"), F.repeat(F.lit("A"), matched.cast("int")).alias("sequence"), F.repeat(F.lit("I"), matched.cast("int")).alias("quality"),
        (h(6, 1200) - 100).alias("template_length"),
    )
