"""Row-level transforms: trimming, adapter removal and quality filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels


def trim(reads: DataFrame, front: int = 0, tail: int = 0) -> DataFrame:
    """Drop ``front`` bases from the start and ``tail`` from the end, of sequence and quality alike."""
    if front < 0 or tail < 0:
        raise ValueError("front and tail can't be negative")
    cut = lambda c: F.substring(F.col(c), F.lit(front + 1), F.greatest(F.length(c) - front - tail, F.lit(0)))
    return reads.withColumns({c: cut(c) for c in ("seq", "qual")})


def remove_adapter(reads: DataFrame, adapter: str | None) -> DataFrame:
    """Drop the whole adapter where a sequence ends with it, and as much of the quality."""
    if not adapter:
        return reads
    ends, keep = F.endswith("seq", F.lit(adapter)), F.length("seq") - len(adapter)
    return reads.withColumns({c: F.when(ends, F.substring(F.col(c), F.lit(1), keep)).otherwise(F.col(c)) for c in ("seq", "qual")})


def trimmed(reads: DataFrame, adapter: str | None = None, front: int = 0, tail: int = 0) -> DataFrame:
    """Front and tail first, then the adapter."""
    return remove_adapter(trim(reads, front, tail), adapter)


def quality_filter(reads: DataFrame, min_quality: float = 20.0) -> DataFrame:
    """Reads with a mean Phred value of at least ``min_quality``; an empty quality passes."""
    return kernels.passing(reads, min_quality)


def filter_stats(reads: DataFrame, min_quality: float = 20.0) -> DataFrame:
    seen = F.count(F.lit(1))
    passed = F.count_if((F.col("size") == 0) | (F.col("phreds") / F.nullif(F.col("size"), F.lit(0)) >= min_quality))
    return kernels.quality_sums(reads).agg(seen.alias("reads_seen"), passed.alias("reads_passed"), (seen - passed).alias("reads_filtered"))


def filter_yield(reads: DataFrame, min_quality: float = 20.0) -> DataFrame:
    """Percent of reads that pass; 0 without reads."""
    stats = filter_stats(reads, min_quality)
    share = F.coalesce(F.round(F.col("reads_passed") * 100.0 / F.nullif(F.col("reads_seen"), F.lit(0)), 4), F.lit(0.0))
    return stats.select("reads_seen", "reads_passed", share.alias("yield_percent"))


def trim_stats(reads: DataFrame, adapter: str | None = None, front: int = 0, tail: int = 0) -> DataFrame:
    """Reads seen, reads that trimming shortened, and bases that it removed."""
    before = reads.withColumn("__before", F.length("seq"))
    after = trimmed(before, adapter, front, tail)
    gone = (F.col("__before") - F.length("seq")).cast("bigint")
    return after.agg(F.count(F.lit(1)).alias("reads_seen"), F.count_if(gone > 0).alias("reads_trimmed"), F.coalesce(F.sum(gone), F.lit(0)).alias("bases_trimmed"))
