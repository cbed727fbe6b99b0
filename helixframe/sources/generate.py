"""Reads made from the MD5 sums of their number: repeatable for any partitioning, and in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRUSEQ = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
LONGEST = 160


def _digits(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}."), F.col("id").cast("string")))


def _letters(length: Column, seed: int) -> Column:
    """Bases from the hex digits of as many sums as the longest read takes."""
    sums = F.concat(*[_digits(f"{seed}.{i}") for i in range(LONGEST // 32)])
    return F.translate(F.substring(sums, F.lit(1), length), "0123456789abcdef", "ACGTACGTACGTACGT")


def _lot(seed: int, n: int) -> Column:
    return F.pmod(F.conv(F.substring(_digits(str(seed)), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def constant_quality(spark: SparkSession, reads: int = 100_000, length: int = 16) -> DataFrame:
    """Reads of one length, up to ``LONGEST``, with quality I throughout."""
    return spark.range(reads).select(F.concat(F.lit("read_"), "id").alias("id"), _letters(F.lit(length), 1).alias("seq"), F.repeat(F.lit("I"), F.lit(length)).alias("qual"))


def mixed(spark: SparkSession, reads: int = 100_000) -> DataFrame:
    """75 to 150 bases with 1 % homopolymers, 2 % adapter ends, 1 % N-rich reads, 5 % duplicates and decaying quality."""
    plain = spark.range(reads).select("id", _lot(7, 100).alias("u"), (_lot(8, 76) + 75).alias("n")).withColumn("read", F.col("id"))
    same = plain.withColumn("id", F.when(F.col("u") >= 95, F.lit(0)).otherwise(F.col("id"))).withColumn("n", F.when(F.col("u") >= 95, 100).otherwise(F.col("n")))
    bases = _letters(F.col("n"), 9)
    seq = (
        F.when(F.col("u") == 0, F.repeat(F.lit("A"), F.col("n")))
        .when(F.col("u") == 1, F.translate(bases, "CT", "NN"))
        .when(F.col("u") < 4, F.concat(F.substring(bases, F.lit(1), F.col("n") - len(TRUSEQ)), F.lit(TRUSEQ)))
        .otherwise(bases)
    )
    steps = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.char(F.lit(73) - F.floor(i / 5).cast("int")))
    return same.select(F.concat(F.lit("read_"), "read").alias("id"), seq.alias("seq"), F.array_join(steps, "").alias("qual"))
