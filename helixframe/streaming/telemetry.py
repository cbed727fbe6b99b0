"""Live views over a folder of reads: one complete-mode aggregate in a memory table, progress lines and cancellation."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import kernels
from ..operators import transforms
from ..plans.config import PipelineConfig
from ..schema import READ
from ..sources.fastq import parse_files

IDLE, RUNNING, DONE, ERROR = range(4)
_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_reads(spark: SparkSession, path: str, kind: str = "fastq", files_per_trigger: int = 16) -> DataFrame:
    """A stream of reads from FASTQ files (plain or gzip) or from Parquet files of id, seq, qual."""
    source = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if kind == "parquet":
        return source.schema(READ).parquet(path)
    return parse_files(source.schema(_BINARY).format("binaryFile").load(path))


POSITIONS, QUALITIES, LENGTHS = 150, 41, 999


def live_counts(reads: DataFrame) -> DataFrame:
    """One aggregate that holds every view, from one scan of the reads."""
    return kernels.report_counts(reads, LENGTHS, POSITIONS, QUALITIES)


def _one(what: str, x: int = 0):
    return F.coalesce(F.sum(F.when((F.col("what") == what) & (F.col("x") == x), F.col("n"))), F.lit(0))


def scalar_view(counts: DataFrame) -> DataFrame:
    a, c, g, t, n = (_one("base", i) for i in range(5))
    return counts.agg(_one("reads").alias("read_count"), _one("bases").alias("total"), (g + c).alias("gc"), (a + t).alias("at"), n.alias("n"), _one("bad").alias("violations"))


def _cells(what: str, **names: str):
    return lambda counts: counts.filter(F.col("what") == what).select(*(F.col(k).alias(v) for k, v in names.items()))


VIEWS = {
    "scalars": scalar_view,
    "gc": _cells("gc", x="bin", n="reads"),
    "lengths": _cells("length", x="bin", n="reads"),
    "heatmap": _cells("quality", x="pos", y="phred", n="reads"),
}


class Progress(StreamingQueryListener):
    """Adds up the input of every batch of one query, as ``recentProgress`` keeps only the last ones."""

    def __init__(self):
        self.id, self.totals = None, []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.id:
            self.totals.append((self.totals[-1] if self.totals else 0) + int(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


class Session:
    """A live analysis: set parameters, start, look at views, cancel, reset. One stream feeds all views."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "fastq", name: str = "live"):
        self.spark, self.path, self.kind, self.name = spark, path, kind, name
        self.query: StreamingQuery | None = None
        self.config = PipelineConfig()
        self._cancelled = False
        self._progress = Progress()

    def set_params(self, **params) -> Session:
        """Trimming, adapter and quality filter of the next start, as fields of a configuration."""
        if self.status() == RUNNING:
            raise RuntimeError("parameters can't change while the session runs")
        self.config = replace(self.config, **params)
        return self

    def _reads(self) -> DataFrame:
        c, reads = self.config, stream_reads(self.spark, self.path, self.kind)
        if c.trim_front or c.trim_tail or c.adapter_sequence:
            reads = transforms.trimmed(reads, c.adapter_sequence, c.trim_front, c.trim_tail)
        return transforms.quality_filter(reads, c.min_quality) if c.min_quality > 0 else reads

    def start(self, once: bool = False) -> Session:
        if self.status() == RUNNING:
            raise RuntimeError("the session runs already")
        self._cancelled, self._progress = False, Progress()
        self.spark.streams.addListener(self._progress)
        writer = live_counts(self._reads()).writeStream.outputMode("complete").format("memory").queryName(self.name)
        self.query = (writer.trigger(availableNow=True) if once else writer).start()
        self._progress.id = str(self.query.id)
        return self

    def wait(self) -> Session:
        """Until all input so far is taken in."""
        if self.query:
            self.query.processAllAvailable() if self.query.isActive else self.query.awaitTermination()
        return self

    def table(self, view: str) -> DataFrame:
        return VIEWS[view](self.spark.table(self.name))

    def progress_lines(self) -> Iterator[str]:
        """NDJSON lines of the reads (files, for FASTQ) taken in so far, one per finished batch."""
        for total in list(self._progress.totals):
            yield json.dumps({"rows_processed": total})

    def status(self) -> int:
        if self._cancelled or self.query is None:
            return IDLE
        if self.query.exception():
            return ERROR
        return RUNNING if self.query.isActive else DONE

    def cancel(self) -> None:
        self._cancelled = True
        if self.query is not None:
            self.query.stop()
            self.spark.streams.removeListener(self._progress)

    def reset(self) -> Session:
        """Cancel, and forget what was counted."""
        self.cancel()
        self.query, self._progress = None, Progress()
        if self.spark.catalog.tableExists(self.name):
            self.spark.catalog.dropTempView(self.name)
        return self


def windowed_events(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and tumbling window, with late rows bounded by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def folder_of(path: str) -> str:
    """The folder that a stream over one file must watch."""
    p = Path(path)
    return str(p if p.is_dir() else p.parent)
