"""Aggregations over reads. Each takes a DataFrame of id, seq, qual and returns a flat one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.sequence import entropy, gc_bin, kmer_id, kmer_of, kmers, normalized

LENGTH_CAP, QUALITY_POSITIONS, QUALITY_CAP = 999, 512, 93
BASE_POSITIONS, BASE_QUALITY_CAP, DECAY_POSITIONS, N50_CAP = 1000, 40, 10_000, 29_999


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _ratio(a: Column, b: Column, digits: int) -> Column:
    """Rounded, 0 where the denominator is 0."""
    return F.coalesce(F.round(a / F.nullif(b, F.lit(0)), digits), F.lit(0.0)).cast("double")


def fused(reads: DataFrame) -> DataFrame:
    """All scalar figures of the default report, in one pass."""
    total = _sum(F.col("len"))
    return kernels.base_sums(reads).agg(
        F.count(F.lit(1)).alias("total_reads"), total.alias("total_bases"),
        F.coalesce(F.min("len"), F.lit(0)).alias("min_length"), F.coalesce(F.max("len"), F.lit(0)).alias("max_length"),
        _ratio(total, F.count(F.lit(1)), 2).alias("mean_length"), _sum(F.col("bad")).alias("integrity_violations"),
        *(_sum(F.col(b)).alias(f"{b}_count") for b in "acgtn"), _ratio(_sum(F.col("n")), total, 4).alias("n_ratio"),
    )


def basic_stats(reads: DataFrame) -> DataFrame:
    return fused(reads).select("total_reads", "total_bases", "min_length", "max_length", "mean_length", "integrity_violations")


def n_statistics(reads: DataFrame) -> DataFrame:
    return fused(reads).select("n_count", "n_ratio")


def nucleotide_composition(reads: DataFrame) -> DataFrame:
    return fused(reads).select(*(F.col(f"{b}_count").alias(b) for b in "acgtn"), F.col("total_bases").alias("total"))


def integrity(reads: DataFrame) -> DataFrame:
    """Bases outside the alphabet; the identity A+C+G+T+N = total holds by construction, so its violations are 0."""
    return kernels.base_sums(reads).agg(_sum(F.col("bad")).alias("invalid_bases"), _sum(F.col("len") - F.col("a") - F.col("c") - F.col("g") - F.col("t") - F.col("n")).alias("identity_violations"))


def gc_distribution(reads: DataFrame) -> DataFrame:
    """bin (percent 0 to 100) and reads; empty reads are left out, N counts in the denominator."""
    return kernels.base_sums(reads).filter("len > 0").groupBy(gc_bin(F.col("g") + F.col("c"), F.col("len")).alias("bin")).agg(F.count(F.lit(1)).alias("reads"))


def length_distribution(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.least(F.length("seq"), F.lit(LENGTH_CAP)).alias("bin")).agg(F.count(F.lit(1)).alias("reads"))


def _phred_matrix(reads: DataFrame, positions: int, cap: int) -> DataFrame:
    counted = kernels.position_counts(reads, "qual", kernels.capped(cap), positions)
    return counted.select("pos", F.col("kind").alias("phred"), F.col("n").alias("reads"))


def quality_dist(reads: DataFrame) -> DataFrame:
    return _phred_matrix(reads, QUALITY_POSITIONS, QUALITY_CAP)


def per_base_quality(reads: DataFrame) -> DataFrame:
    return _phred_matrix(reads, BASE_POSITIONS, BASE_QUALITY_CAP)


def heatmap_intensity(reads: DataFrame) -> DataFrame:
    """log10(1 + count) over its largest value, per cell of the quality matrix."""
    top = W.partitionBy()  # over the matrix, which has positions x values cells at most
    scaled = F.log10(1.0 + F.col("reads")) / F.log10(1.0 + F.max("reads").over(top))
    return quality_dist(reads).select("pos", "phred", F.round(scaled, 6).alias("intensity"))


def quality_decay(reads: DataFrame) -> DataFrame:
    counted = kernels.position_counts(reads, "qual", kernels.phreds(), DECAY_POSITIONS)
    return counted.groupBy("pos").agg(_ratio(F.sum(F.col("kind") * F.col("n")), F.sum("n"), 4).alias("mean_phred"))


def per_base_composition(reads: DataFrame) -> DataFrame:
    counted = kernels.position_counts(reads, "seq", kernels.base_codes(), BASE_POSITIONS)
    return counted.select("pos", F.substring(F.lit("ACGTN"), F.col("kind") + 1, F.lit(1)).alias("base"), F.col("n").alias("reads"))


def qc_summary(reads: DataFrame) -> DataFrame:
    phreds, bases = _sum(F.col("phreds")), _sum(F.col("bases"))
    return kernels.quality_sums(reads).agg(F.count(F.lit(1)).alias("total_reads"), bases.alias("total_bases"), _ratio(phreds, bases, 4).alias("mean_quality"))


def gc_content(reads: DataFrame) -> DataFrame:
    return kernels.base_sums(reads).agg(_ratio(_sum(F.col("g") + F.col("c")), _sum(F.col("len")), 4).alias("ratio"))


def length_summary(reads: DataFrame) -> DataFrame:
    n = F.length("seq").cast("bigint")
    return reads.agg(_ratio(_sum(n), F.count(F.lit(1)), 2).alias("mean_length"), F.coalesce(F.min(n), F.lit(0)).alias("min_length"), F.coalesce(F.max(n), F.lit(0)).alias("max_length"))


_EDGES = (100, 500, 1000, 5000, 10_000)


def length_bins(reads: DataFrame) -> DataFrame:
    n = F.length("seq")
    label = F.lit(f">={_EDGES[-1]}")
    for edge in reversed(_EDGES):
        label = F.when(n < edge, f"<{edge}").otherwise(label)
    return reads.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("reads"))


def _length_walk(reads: DataFrame) -> DataFrame:
    """Distinct capped lengths with their bases, running from the longest; at most ``N50_CAP`` + 1 rows in the window."""
    lengths = reads.groupBy(F.least(F.length("seq"), F.lit(N50_CAP)).cast("bigint").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    down = W.orderBy(F.desc("len"))
    return lengths.select("len", F.sum(F.col("len") * F.col("n")).over(down).alias("cum"), F.sum("n").over(down).alias("reads"), F.sum(F.col("len") * F.col("n")).over(W.partitionBy()).alias("total"))


def n50(reads: DataFrame) -> DataFrame:
    return _length_walk(reads).agg(F.coalesce(F.max(F.when((F.col("cum") >= F.expr("total div 2")) & (F.col("total") > 0), F.col("len"))), F.lit(0)).alias("n50"))


def nx_statistics(reads: DataFrame) -> DataFrame:
    """N10 to N90 with the number of reads that reach it."""
    targets = F.explode(F.array(*[F.lit(10 * i) for i in range(1, 10)])).alias("x")
    walk = _length_walk(reads).select("*", targets).filter((F.col("cum") >= F.expr("total * x div 100")) & (F.col("total") > 0))
    return walk.groupBy("x").agg(F.max("len").alias("nx"), F.min("reads").alias("lx"))


def entropy_stats(reads: DataFrame, low: float = 1.5) -> DataFrame:
    h = kernels.base_sums(reads).filter("len > 0").select(entropy({b: F.col(b) for b in "acgt"}, F.col("len")).alias("h"))
    return h.agg(F.coalesce(F.round(F.avg("h"), 4), F.lit(0.0)).alias("mean_entropy"), F.coalesce(F.round(F.sum("h"), 2), F.lit(0.0)).alias("total_entropy_sum"), F.count_if(F.col("h") < low).alias("low_complexity_reads"))


def sequence_counts(reads: DataFrame) -> DataFrame:
    """Each distinct normalized sequence with its reads; partial counts run before the shuffle, which absorbs hot sequences."""
    return reads.groupBy(normalized("seq").alias("sequence")).agg(F.count(F.lit(1)).alias("reads"))


def duplication(reads: DataFrame) -> DataFrame:
    total, distinct = _sum(F.col("reads")), F.count(F.lit(1))
    return sequence_counts(reads).agg(total.alias("total_reads"), (total - distinct).alias("duplicate_reads"), _ratio(total - distinct, total, 4).alias("duplication_ratio"))


def duplication_warning(reads: DataFrame, warn_above: float = 0.2) -> DataFrame:
    return duplication(reads).select(F.round(F.col("duplication_ratio") * 100, 4).alias("duplication_percent"), (F.col("duplication_ratio") > warn_above).alias("warn"))


def overrepresented(reads: DataFrame) -> DataFrame:
    """Distinct sequences and the most frequent one, the first in order among equals."""
    first = F.min_by("sequence", F.struct(-F.col("reads"), "sequence"))
    return sequence_counts(reads).agg(F.count(F.lit(1)).alias("unique_sequences"), F.coalesce(first, F.lit("None")).alias("most_frequent"), F.coalesce(F.max("reads"), F.lit(0)).alias("most_frequent_count"))


def overrepresented_top(reads: DataFrame, top: int = 20) -> DataFrame:
    return sequence_counts(reads).orderBy(F.desc("reads"), "sequence").limit(top)


def _named(counts: DataFrame, k: int) -> DataFrame:
    return counts.select(kmer_of(F.col("code"), k).alias("kmer"), F.col("code").alias("kmer_index"), F.col("n").alias("occurrences"))


def kmer_counts(reads: DataFrame, k: int = 5) -> DataFrame:
    """k-mers without N, with their base-4 number and count; beyond 31 bases there is no number."""
    if k <= kernels.MAX_K:
        return _named(kernels.code_counts(reads, k), k)
    exploded = reads.select(F.explode(kmers(normalized("seq"), k)).alias("kmer")).filter(~F.contains("kmer", F.lit("N")))
    return exploded.groupBy("kmer").agg(F.count(F.lit(1)).alias("occurrences"))


def kmer_total(reads: DataFrame, k: int = 5) -> DataFrame:
    return kmer_counts(reads, k).agg(_sum(F.col("occurrences")).alias("total_kmers"), F.count(F.lit(1)).alias("distinct_kmers"))


def kmer_spectrum_top3(reads: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(W.orderBy(F.desc("occurrences"), "kmer"))
    return kmer_counts(reads, k).orderBy(F.desc("occurrences"), "kmer").limit(3).select(F.lit(k).alias("k"), rank.alias("rank"), "occurrences")


def adapter_kmers(reads: DataFrame, k: int = 8, suffix: int = 20) -> DataFrame:
    """Counts of the k-mers in the last ``suffix`` bases of reads at least that long."""
    return _named(kernels.code_counts(reads, k, suffix), k)


def adapter_detect(reads: DataFrame, k: int = 8, suffix: int = 20) -> DataFrame:
    """The most frequent suffix k-mer, and whether it exceeds a tenth of all."""
    totals = adapter_kmers(reads, k, suffix).agg(_sum(F.col("occurrences")).alias("total_suffix_kmers"), F.coalesce(F.max("occurrences"), F.lit(0)).alias("top_count"), F.min_by("kmer", F.struct(-F.col("occurrences"), "kmer")).alias("top_kmer"))
    return totals.select("total_suffix_kmers", F.coalesce("top_kmer", F.lit("None")).alias("top_kmer"), "top_count", (F.col("top_count") > F.expr("total_suffix_kmers div 10")).alias("detected"))


def taxonomic_screening(reads: DataFrame, signatures: DataFrame, k: int = 16) -> DataFrame:
    """Each read votes for the taxon most of its k-mers are signatures of (the first in order among equals); others are Unknown.

    Rows that repeat an id are called together, by the distinct k-mers of all of them.
    ``signatures`` (taxon, kmer of ``k`` letters, up to 31; those with letters
    beyond A, C, G, T match nothing) is broadcast only when its size in the
    catalog is below Spark's broadcast threshold; otherwise the join shuffles.
    """
    known = signatures.filter(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")).select("taxon", kmer_id(F.col("kmer")).alias("code")).distinct()
    numbered = kernels.read_codes(reads, k).select("id", F.explode("codes").alias("code"))
    votes = numbered.join(known, "code").select("id", "taxon", "code").distinct().groupBy("id", "taxon").agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy("id").agg(F.min_by("taxon", F.struct(-F.col("v"), "taxon")).alias("taxon"))
    called = best.groupBy("taxon").agg(F.count(F.lit(1)).alias("reads"))
    # Both sides of this join are one row.
    total = reads.agg(F.count(F.lit(1)).alias("total"))
    unknown = total.join(called.agg(_sum(F.col("reads")).alias("known")), how="cross").select(F.lit("Unknown").alias("taxon"), (F.col("total") - F.col("known")).alias("reads"))
    return called.union(unknown)


def taxon_composition(counts: DataFrame) -> DataFrame:
    """Shares of the taxa with reads, in percent."""
    total = F.sum("reads").over(W.partitionBy())
    return counts.filter("reads > 0").select("taxon", F.round(F.col("reads") * 100.0 / total, 4).alias("percent"))


def quality_bands(reads: DataFrame) -> DataFrame:
    """Shares of bases below 20, below 30 and from 30 on."""
    cells = kernels.value_counts(reads, "qual", kernels.phreds()).select(F.col("kind").alias("q"), "n")
    band = F.when(F.col("q") < 20, "<20").when(F.col("q") < 30, "<30").otherwise(">=30")
    return cells.groupBy(band.alias("band")).agg(_sum(F.col("n")).alias("bases"))


def telemetry(reads: DataFrame) -> DataFrame:
    """What a live view shows: reads, GC, AT and N bases, their total, and the memory estimate."""
    f = fused(reads)
    gc, at = F.col("g_count") + F.col("c_count"), F.col("a_count") + F.col("t_count")
    return f.select(F.col("total_reads").alias("read_count"), gc.alias("gc"), at.alias("at"), F.col("n_count").alias("n"), (gc + at + F.col("n_count")).alias("total"), (F.col("total_reads") * 128).alias("memory_estimate"))
