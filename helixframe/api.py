"""Python API: ``qc``, ``bamstats`` and ``pipeline`` return report dictionaries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from .plans.config import PipelineConfig
from .plans.report import alignment_report, read_report
from .sources.bam import read_bam
from .sources.fastq import read_fastq

_COMPRESSION = {"auto": "auto", "none": "none", "gzip": "gzip", "bgzf": "bgzf", "native": "auto", "libdeflate": "auto", "chunked": "auto", "compat": "gzip"}


def session(threads: int | None = None, max_memory: int | None = None) -> SparkSession:
    """The active session, or a local one of so many threads and megabytes of heap."""
    active = SparkSession.getActiveSession()
    if active:
        return active
    builder = SparkSession.builder.master(f"local[{threads or '*'}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if max_memory:
        builder = builder.config("spark.driver.memory", f"{max_memory}m")
    return builder.config("spark.sql.shuffle.partitions", str(threads or 8)).getOrCreate()


def _reads(path: str, config: PipelineConfig) -> DataFrame:
    return read_fastq(session(config.threads if config.threads > 0 else None), path, compression=_COMPRESSION[config.gzip_mode])


def qc(path: str, approx: bool = False, threads: int = 8, gzip_mode: str = "auto") -> dict[str, Any]:
    """The default report of FASTQ files."""
    config = PipelineConfig(mode="fast" if approx else "exact", threads=threads, gzip_mode=gzip_mode)
    return read_report(_reads(path, config), config)


def bamstats(source: str | DataFrame, reference_length: int = 0, threads: int = 8) -> dict[str, Any]:
    """The alignment report of BAM files, or of a DataFrame of alignment records."""
    records = read_bam(session(threads), source) if isinstance(source, str) else source
    return alignment_report(records, reference_length)


def pipeline(config: PipelineConfig | dict[str, Any] | str, path: str) -> dict[str, Any]:
    """Run a configuration: an object, a dictionary, or the path of a JSON file."""
    if isinstance(config, str):
        with open(config, encoding="utf-8") as f:
            config = PipelineConfig.from_json(f.read())
    elif isinstance(config, dict):
        config = PipelineConfig.from_dict(config)
    return read_report(_reads(path, config), config)


def timed(report, *args: Any, **kwargs: Any) -> tuple[dict[str, Any], dict[str, float]]:
    """A report, with elapsed seconds and reads a second."""
    began = time.perf_counter()
    found = report(*args, **kwargs)
    seconds = time.perf_counter() - began
    return found, {"elapsed_s": seconds, "reads_per_s": found["read_count"] / seconds if seconds else 0.0}


class Run:
    """A report in the making, which can be cancelled: its Spark jobs end and ``result`` raises."""

    def __init__(self, report: Callable[..., dict[str, Any]], *args: Any, **kwargs: Any):
        self._tag, self._spark, self._found, self._error = f"run-{uuid.uuid4().hex}", session(), None, None
        self.cancelled = False

        def work() -> None:
            context = self._spark.sparkContext
            context.addJobTag(self._tag)
            try:
                self._found = report(*args, **kwargs)
            except Exception as e:  # raised again to whoever asks for the result
                self._error = e
            finally:
                context.removeJobTag(self._tag)

        self._thread = InheritableThread(target=work, session=self._spark)
        self._thread.start()

    def cancel(self) -> None:
        """End the jobs that run, and those still to be started, until the report gives up."""
        self.cancelled = True
        while self._thread.is_alive():
            self._spark.sparkContext.cancelJobsWithTag(self._tag)
            self._thread.join(0.2)

    def result(self, timeout: float | None = None) -> dict[str, Any]:
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError("the report is not done")
        if self._error is not None:
            raise self._error
        return self._found
