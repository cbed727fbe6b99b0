"""Signature tables for taxonomic screening: taxon and k-mer, from Parquet or separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_signatures(spark: SparkSession, path: str, kind: str = "csv", separator: str = "\t") -> DataFrame:
    """taxon and upper-case kmer; text files have a header with these two names."""
    rows = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).option("sep", separator).csv(path)
    return rows.select("taxon", F.upper("kmer").alias("kmer")).filter("taxon is not null and kmer is not null")
