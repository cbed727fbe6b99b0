"""The ``fastq`` data source: plain, gzip and BGZF files, split by bytes or blocks.

    register(spark)
    spark.read.format("fastq").load("/data/*.fastq.gz")

Options: ``compression`` (auto, none, gzip, bgzf), ``mode`` (LENIENT as parsed,
PERMISSIVE with an ``_error`` column, DROPMALFORMED, FAILFAST), ``columns`` (a
comma-separated choice of id, seq, qual), ``splitBytes`` and ``maxRatio``.
A range owns the records that start after its first byte and up to its end, so
each record has one owner. Plain gzip can't be split: a file is one partition.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from . import parsing

_CHUNK = 1 << 20
_COLUMNS = ("id", "seq", "qual")
MODES = ("LENIENT", "PERMISSIVE", "DROPMALFORMED", "FAILFAST")


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int | None
    compression: str


def _open(path: str):
    where, name = parsing.filesystem(path)
    return where.open_input_file(name)


def expand(path: str) -> list[str]:
    """The files of a path: a file, a folder's visible files, or a local pattern."""
    if "://" not in path and not path.startswith("file:"):
        found = glob.glob(path) if any(c in path for c in "*?[") else [path]
        files = [os.path.join(p, x) for p in found if os.path.isdir(p) for x in os.listdir(p)] + [p for p in found if not os.path.isdir(p)]
        return sorted(f for f in files if not os.path.basename(f).startswith((".", "_")))
    where, name = pafs.FileSystem.from_uri(path)
    info = where.get_file_info(name)
    if info.type != pafs.FileType.Directory:
        return [path]
    root = path.rstrip("/")
    return sorted(f"{root}/{x.base_name}" for x in where.get_file_info(pafs.FileSelector(name)) if x.is_file and not x.base_name.startswith((".", "_")))


def _chunks(stream, begin: int) -> Iterator[bytes]:
    stream.seek(begin)
    while data := stream.read(_CHUNK):
        yield data


def range_batches(part: Range, incomplete: bool = False, max_ratio: int = 0, columns: Iterable[str] = parsing.COLUMNS) -> Iterator[pa.RecordBatch]:
    """The records that a range owns."""
    with _open(part.path) as stream:
        if part.compression == "gzip":
            yield from parsing.batches(parsing.gunzip(_chunks(stream, 0)), incomplete=incomplete, columns=columns)
        elif part.compression == "none":
            limit = None if part.end is None else parsing.Limit(part.end - part.begin, True)
            yield from parsing.batches(_chunks(stream, part.begin), limit, part.begin > 0, incomplete, columns)
        else:
            # The limit is the bytes of the blocks that start within the range, known once a later block is met; the last record may go on there.
            own = parsing.Limit()

            def data():
                for at, d in parsing.bgzf_blocks(stream, part.begin, None, max_ratio):
                    if part.end is None or at < part.end:
                        own.bytes += len(d)
                    else:
                        own.known = True
                        if own.bytes == 0:
                            return
                    yield d

            yield from parsing.batches(data(), own if part.end is not None else None, part.begin > 0, incomplete, columns)


def range_records(part: Range, incomplete: bool = False, max_ratio: int = 0) -> Iterator[parsing.Record]:
    """The same as tuples."""
    for b in range_batches(part, incomplete, max_ratio):
        yield from zip(*(c.to_pylist() for c in b.columns))


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.paths = [p for x in options["path"].split(",") for p in expand(x.strip())]
        self.compression, self.mode, self.columns = options.get("compression", "auto").lower(), options.get("mode", "LENIENT").upper(), columns
        self.split, self.max_ratio = int(options.get("splitbytes", 64 << 20)), int(options.get("maxratio", 0))
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            with _open(path) as stream:
                kind = parsing.sniff(stream.read(64)) if self.compression == "auto" else self.compression
                size = stream.size()
            if kind == "gzip" or size <= self.split:
                out.append(Range(path, 0, None, kind))
                continue
            begins = range(0, size, self.split)
            out += [Range(path, b, b + self.split if b + self.split < size else None, kind) for b in begins]
        return out or [Range("", 0, 0, "empty")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.compression == "empty":
            return
        checked = self.mode != "LENIENT"
        for b in range_batches(partition, checked, self.max_ratio, parsing.COLUMNS if checked else self.columns):
            if checked and b["_error"].null_count < b.num_rows:
                if self.mode == "FAILFAST":
                    r = b.filter(b["_error"].is_valid()).slice(0, 1).to_pylist()[0]
                    raise parsing.FormatError(f"{r['_error']}: record {r['id']!r} in {partition.path}")
                if self.mode == "DROPMALFORMED":
                    b = b.filter(b["_error"].is_null())
            if b.num_rows:
                yield b.select(self.columns)


class FastqDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def _columns(self) -> list[str]:
        chosen = [c.strip() for c in self.options.get("columns", ",".join(_COLUMNS)).split(",")]
        if unknown := set(chosen) - set(_COLUMNS):
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        return chosen + ["_error"] * (self.options.get("mode", "").upper() == "PERMISSIVE")

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self._columns()])

    def reader(self, schema: StructType) -> FastqReader:
        return FastqReader(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqDataSource)


def read_fastq(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("fastq").options(**options).load(path)


def parse_files(files: DataFrame) -> DataFrame:
    """Reads of whole files given as a ``content`` column, as Spark's binaryFile source gives them from any store, batch or streaming."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw = content.as_py() or b""
                kind = parsing.sniff(raw[:64])
                data = parsing.gunzip([raw]) if kind != "none" else [raw]
                yield from parsing.batches(data, columns=_COLUMNS)

    return files.select("content").mapInArrow(run, "id string, seq string, qual string")


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of FASTQ part files: plain, gzip or bgzf."""
    text = reads.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))
    if compression == "bgzf":
        parsing.write_parts(text, path, lambda batches: parsing.bgzf_stream("".join(x + "\n" for x in b.column(0).to_pylist()).encode() for b in batches), "fastq.gz")
    else:
        text.write.mode("overwrite").option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)
