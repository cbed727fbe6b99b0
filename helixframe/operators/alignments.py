"""Aggregations over alignment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import cigar_stats

INSERT_BIN = 500


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _ratio(a: Column, b: Column, digits: int) -> Column:
    return F.coalesce(F.round(a / F.nullif(b, F.lit(0)), digits), F.lit(0.0)).cast("double")


def alignment_stats(records: DataFrame) -> DataFrame:
    """A record is mapped when its mapping quality is above 0, whatever its flag."""
    q = F.col("mapping_quality")
    mapped = F.count_if(q > 0)
    return records.agg(F.count(F.lit(1)).alias("total_records"), mapped.alias("mapped_reads"), (F.count(F.lit(1)) - mapped).alias("unmapped_reads"), _ratio(_sum(F.when(q > 0, q)), mapped, 2).alias("mean_mapq"))


def mapq_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy(F.col("mapping_quality").alias("mapq")).agg(F.count(F.lit(1)).alias("records"))


def cigars(records: DataFrame) -> DataFrame:
    """Distinct CIGAR strings with their records, parsed once each."""
    counted = records.groupBy("cigar").agg(F.count(F.lit(1)).alias("records"))
    return counted.select("cigar", "records", *(c.alias(n) for n, c in cigar_stats().items()))


def cigar_totals(records: DataFrame) -> DataFrame:
    return cigars(records).agg(*(_sum(F.col(c) * F.col("records")).alias(c) for c in ("aligned", "insertions", "deletions", "soft_clips")))


def coverage(records: DataFrame, reference_length: int) -> DataFrame:
    """Aligned bases over the reference's length; 0 for a length of 0."""
    aligned = cigar_totals(records).select(F.col("aligned").alias("aligned_bases"), F.lit(reference_length).cast("bigint").alias("reference_length"))
    return aligned.select("*", _ratio(F.col("aligned_bases"), F.col("reference_length"), 6).alias("coverage_estimate"))


def error_rate(records: DataFrame) -> DataFrame:
    """Insertions and deletions stand for mismatches."""
    totals = cigar_totals(records).select(F.col("aligned").alias("aligned_bases"), (F.col("insertions") + F.col("deletions")).alias("mismatches"))
    return totals.select("*", _ratio(F.col("mismatches"), F.col("aligned_bases"), 6).alias("error_rate"))


def soft_clipping(records: DataFrame) -> DataFrame:
    clipped = F.col("soft_clips") > 0
    return cigars(records).agg(_sum(F.when(clipped, F.col("records"))).alias("soft_clipped_reads"), _sum(F.col("soft_clips") * F.col("records")).alias("soft_clipped_bases"))


def insert_size(records: DataFrame) -> DataFrame:
    """Records with a positive template length are the pairs."""
    t = F.col("template_length").cast("bigint")
    return records.filter("template_length > 0").agg(F.count(F.lit(1)).alias("pairs_analyzed"), F.coalesce(F.min(t), F.lit(0)).alias("min_insert"), F.coalesce(F.max(t), F.lit(0)).alias("max_insert"), _ratio(_sum(t), F.count(F.lit(1)), 2).alias("mean_insert"))


def insert_size_hist(records: DataFrame, width: int = INSERT_BIN) -> DataFrame:
    return records.filter("template_length > 0").groupBy(F.expr(f"cast(template_length div {int(width)} as int)").alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))
