"""Schemas of the two record types."""

from pyspark.sql import types as T

READ = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "seq", "qual")])

ALIGNMENT = T.StructType(
    [
        T.StructField("flag", T.IntegerType()),
        T.StructField("reference_id", T.IntegerType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("mapping_quality", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
        T.StructField("sequence", T.StringType()),
        T.StructField("quality", T.StringType()),
        T.StructField("template_length", T.IntegerType()),
    ]
)
