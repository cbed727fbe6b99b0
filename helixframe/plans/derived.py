"""Reads and alignments derived from relational tables, as the same SQL in both dialects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_READS = """select cast(l_orderkey as {S}) || '.' || cast(l_linenumber as {S}) as id,
  substr(translate(md5(cast(l_partkey as {S})) || md5(cast(l_suppkey as {S})), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, 20 + cast(l_quantity as int) % 45) as seq,
  substr(translate(md5(cast(l_orderkey as {S})) || md5(cast(l_linenumber as {S})), '0123456789abcdef', '!&+05:?DEFGHIJIJ'), 1, 20 + cast(l_quantity as int) % 45) as qual
from {T}"""

_ALIGNMENTS = """select cast(l_orderkey % 4096 as int) as flag, cast(l_suppkey % 23 as int) as reference_id,
  cast((l_partkey*7919 + l_linenumber*104729) % 1000000 as int) as position,
  cast((l_partkey + l_linenumber) % 61 as int) as mapping_quality,
  (case when l_partkey % 5 > 0 then cast(l_partkey % 5 as {S}) || 'S' else '' end)
    || cast(90 + cast(l_quantity as int) as {S}) || 'M'
    || (case when l_linenumber % 3 > 0 then cast(l_linenumber % 3 as {S}) || 'I' else '' end)
    || (case when l_suppkey % 2 > 0 then '1D' else '' end) || '10M' as cigar,
  cast((l_orderkey * 7 + l_linenumber) % 1200 - 100 as int) as template_length
from {T}"""

_DOCUMENT_READS = """select cast(doc_id as {S}) as id,
  regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N'{G}) as seq
from {T}"""


#: Spark cuts the digests before it translates them, which gives the same letters for fewer lookups.
_CUT_FIRST = re.compile(r"substr\(translate\((.+?), ('\w+'), ('[^']+')\), 1, (20 \+ .+? % 45)\)")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt out to all of them by a key; any other is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def _spark(spark: SparkSession, sf_dir: str, sql: str, table: str, key: str) -> DataFrame:
    sql = _CUT_FIRST.sub(r"translate(substr(\1, 1, \4), \2, \3)", sql)
    return spark.sql(sql.format(S="string", G="", T="{table}"), table=spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, _READS, "lineitem", "l_orderkey")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, _ALIGNMENTS, "lineitem", "l_orderkey")


def document_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, _DOCUMENT_READS, "documents", "doc_id")


def _duck(sql: str, table: str) -> str:
    return sql.format(S="varchar", G=", 'g'", T=table)


READS_SQL, ALIGNMENTS_SQL, DOCUMENT_READS_SQL = _duck(_READS, "lineitem"), _duck(_ALIGNMENTS, "lineitem"), _duck(_DOCUMENT_READS, "documents")
