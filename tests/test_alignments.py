"""Golden values of the alignment stages."""

from helixframe.operators import alignments as A
from helixframe.plans.report import alignment_report, to_ndjson, to_text
from helixframe.schema import ALIGNMENT
from helixframe.sources.bam import simulate_alignments


def make(spark, *rows):
    return spark.createDataFrame([(0, 0, 0, q, c, "", "", t) for q, c, t in rows], ALIGNMENT)


def test_goldens(spark):
    assert A.alignment_stats(make(spark, (60, "10M", 0))).first().asDict() == {"total_records": 1, "mapped_reads": 1, "unmapped_reads": 0, "mean_mapq": 60.0}
    assert [(x.mapq, x.records) for x in A.mapq_distribution(make(spark, (60, "10M", 0))).collect()] == [(60, 1)]
    assert A.coverage(make(spark, (60, "10M", 0)), 100).first().coverage_estimate == 0.1
    assert A.error_rate(make(spark, (60, "9M1I", 0))).first()[:2] == (9, 1)
    assert A.soft_clipping(make(spark, (60, "8M2S", 0))).first()[:] == (1, 2)
    assert A.cigar_totals(make(spark, (60, "8M1I2S3=", 0))).first().aligned == 11
    got = A.insert_size(make(spark, (60, "1M", 500), (60, "1M", -5), (60, "1M", 100))).first()
    assert got[:] == (2, 100, 500, 300.0)


def test_empty_and_malformed(spark):
    none = make(spark).filter("false")
    assert A.alignment_stats(none).first().mean_mapq == 0.0
    assert A.coverage(none, 0).first().coverage_estimate == 0.0
    assert A.insert_size(none).first().pairs_analyzed == 0
    assert A.cigar_totals(make(spark, (1, "*", 0), (1, "M", 0))).first().aligned == 0


def test_report(spark):
    found = alignment_report(simulate_alignments(spark, 1000), 10_000)
    assert found["read_count"] == 1000 and sum(found["stages"]["mapq_distribution"]["histogram"]) == 1000
    assert to_ndjson(found).count("\n") == 7 and "[coverage]" in to_text(found)
