"""Small helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, shared_path


def settle(rows: DataFrame, kind: str, files: int) -> DataFrame:
    """Write rows to the shared folder as so many files, and read them back: lineage ends here.

    Small intermediate results would otherwise be as many tiny files as the
    session has shuffle partitions. ``files`` is to follow the input. The rows
    are made by all tasks there are and dealt out to the files afterwards.
    """
    rows.repartition(max(1, files)).write.mode("overwrite").parquet(path := shared_path(rows.sparkSession, kind))
    return rows.sparkSession.read.parquet(path)


def quoted(column: str) -> str:
    """A column's name as ``F.col`` takes it, whatever signs it holds."""
    return "`" + column.replace("`", "``") + "`"


_held: dict[str, tuple[object, object]] = {}


def release(keeps: str = "") -> None:
    """Give what a Python worker has freed back to the system, models other than ``keeps`` included, as workers outlive their tasks."""
    for kind in [k for k in _held if k != keeps]:
        del _held[kind]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def release_heaps(spark: SparkSession) -> None:
    """Collect the executors' heaps, so that their JVMs give what is unused back to the system.

    A JVM keeps what its heap once grew to, several times what is alive, so the peaks of all stages of a
    session would stay. A task per core reaches the executors that are there; one that is missed, or whose
    JVM takes no such request, just stays as large as it is.
    """
    tasks = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


#: Rows and bytes of the batches that operators work on at a time.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Slices between two releases of freed memory.
RELEASE_AFTER = 8


def pieces(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Spark's batches, of so many rows and (but for a longer single row) bytes at most."""
    for batch in batches:
        todo = [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)][::-1]
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and b.nbytes > size:
                half = b.num_rows // 2
                todo += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def bounded(run, rows: int = BATCH_ROWS, size: int = BATCH_BYTES, keeps: str = ""):
    """A function of batches that gets slices of them; no session setting is needed.

    Memory that is free, and models but for ``keeps``, is given back after so many slices and at the end.
    """

    def slices(batches):
        for i, b in enumerate(pieces(batches, rows, size), 1):
            yield b
            if i % RELEASE_AFTER == 0:
                release(keeps)

    def wrapped(batches):
        yield from run(slices(batches))
        release(keeps)

    return wrapped


def only_one(kind: str, key: object, build):
    """What ``build`` makes of ``key``, kept by a Python worker until it needs another such object.

    Workers outlive the stages of a pipeline, so the models of all would add up.
    """
    if kind not in _held or _held[kind][0] != key:
        release()
        _held[kind] = key, build(key)
    return _held[kind][1]


@contextmanager
def smaller_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> Iterator[None]:
    """Fewer rows and bytes in the Arrow batches of what runs within; the session's settings are put back at the end."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, most in wanted.items():
        # A size given in a unit other than bytes is left as it is.
        now = before[name].removesuffix("b")
        if now.removeprefix("-").isdigit():
            spark.conf.set(name, str(min(most, int(now)) if int(now) > 0 else most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the non-null text, whatever else the table carries."""
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def partitions_of(spark: SparkSession, floor: int = 1) -> int:
    """The session's shuffle partitions, which the cluster sizes to its input."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: str, total: int, how: str = "inner", parts: int = 64) -> DataFrame:
    """Join on ``keys``, unique on the right, with the left rows of hot keys dealt over ``parts`` tasks.

    ``total`` is the number of the left's rows. A key is hot with over a 200th
    of them, so there are fewer than 200 and broadcasting them is bounded.
    """
    hot = F.broadcast(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max(1_000, total // 200)).select(*keys, F.lit(True).alias("__hot")))
    deal = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(0).cast("int")
    dealt = left.join(hot, keys, "left").withColumn("__part", deal).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    spread_right = right.join(hot, keys, "left").withColumn("__part", F.explode(copies)).drop("__hot")
    return dealt.join(spread_right, [*keys, "__part"], how).drop("__part")


__all__ = ["bounded", "discard", "id_and_text", "join_hot", "only_one", "partitions_of", "pieces", "quoted", "release", "release_heaps", "settle", "shared_path", "smaller_batches", "text_of"]
