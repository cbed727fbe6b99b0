"""Approximate counterparts and sketches."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.sequence import normalized, signature

#: A Mersenne prime, the modulus of the sketches' hashes.
PRIME = (1 << 31) - 1


def duplication_approx(reads: DataFrame, rsd: float = 0.01) -> DataFrame:
    """Duplicates from an approximate distinct count of signatures; may err to either side."""
    total, distinct = F.count(F.lit(1)), F.approx_count_distinct(signature("seq"), rsd)
    duplicates = F.greatest(total - distinct, F.lit(0))
    return reads.agg(total.alias("total_reads"), duplicates.alias("duplicate_reads"), F.coalesce(F.round(duplicates / F.nullif(total, F.lit(0)), 4), F.lit(0.0)).alias("duplication_ratio"))


def overrepresented_sampled(reads: DataFrame, one_in: int = 4, top: int = 20) -> DataFrame:
    """Counts over a sample of reads by the MD5 of their id, scaled up."""
    lot = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint")
    kept = reads.filter(F.pmod(lot, F.lit(one_in)) == 0)
    counted = kept.groupBy(normalized("seq").alias("sequence")).agg((F.count(F.lit(1)) * one_in).alias("reads"))
    return counted.orderBy(F.desc("reads"), "sequence").limit(top)


def permutations(size: int) -> list[tuple[int, int]]:
    """Scale and shift of each of a sketch's hashes: powers of a generator of the prime's field."""
    return [(pow(7, 2 * i + 1001, PRIME), pow(7, 2 * i + 2002, PRIME)) for i in range(size)]


def minhash(reads: DataFrame, k: int = 11, size: int = 16, key: str = "id") -> DataFrame:
    """id (what ``key`` holds) and the ``size`` minima of hashes of the base-4 k-mers; reads without a valid k-mer are left out."""
    scale, shift = zip(*permutations(size))
    return kernels.sketch_rows(reads, key, k, list(scale), list(shift), PRIME)


def sketch_similarity(a: str = "a", b: str = "b"):
    """The share of equal minima of two sketch columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def minhash_similarity(reads: DataFrame, k: int = 11, size: int = 16, bands: int = 4, hot: int = 10_000) -> DataFrame:
    """id, other and similarity of every pair of different sequences that share a band, and of every copy with its original.

    Reads of equal normalised sequence are a class, and its smallest id stands
    for it. Each pair of classes with a band of equal minima in common gives one
    row, the greater id first; every other read of a class gives a row with its
    class's id and similarity 1. Reads without a valid k-mer are left out. Ids
    may repeat: sequences are told apart by their hash, too. Classes of ``hot``
    or more reads are joined by broadcast.
    """
    rows = size // bands
    named = reads.select("id", normalized("seq").alias("seq")).filter(F.col("seq").rlike(f"[ACGT]{{{k}}}"))
    heads = named.groupBy("seq").agg(F.min("id").alias("other"), F.count(F.lit(1)).alias("n"))
    sketches = minhash(heads.select(F.struct("other", F.xxhash64("seq").alias("h")).alias("id"), "seq"), k, size)
    # Minima are columns, and bands meet by a hash: lambdas and arrays of keys, which aren't compiled, cost more than all else.
    minima = [f"m{i}" for i in range(size)]
    held = sketches.select("id", *[F.col("sketch")[i].cast("int").alias(m) for i, m in enumerate(minima)])
    hashes = F.array(*[F.xxhash64(F.lit(i), *minima[i * rows : (i + 1) * rows]) for i in range(bands)])
    keyed = held.select("*", F.posexplode(hashes).alias("band", "key"))
    same = [F.col(f"a.{m}") == F.col(f"b.{m}") for m in minima]
    shared = [reduce(and_, same[i * rows : (i + 1) * rows]) for i in range(bands)]
    # A pair meets in each band it shares; it is taken from the first of them.
    first = reduce(or_, [reduce(and_, [~s for s in shared[:i]], (F.col("a.band") == i) & shared[i]) for i in range(bands)])
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.id") > F.col("b.id"))
    alike = F.round(sum((s.cast("int") for s in same), F.lit(0)) / size, 4)
    pairs = keyed.alias("a").join(keyed.alias("b"), meet & first).select(F.col("a.id.other").alias("id"), F.col("b.id.other").alias("other"), alike.alias("similarity"))
    many, few = heads.filter(F.col("n") >= hot).select("seq", "other"), heads.filter(F.col("n").between(2, hot - 1)).select("seq", "other")
    copies = named.join(F.broadcast(many), "seq").union(named.join(F.broadcast(many), "seq", "left_anti").join(few, "seq").select("seq", "id", "other"))
    return pairs.union(copies.filter("not id <=> other").select("id", "other", F.lit(1.0).alias("similarity")))


def bloom_parameters(items: int, false_positive: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter for so many items."""
    import math

    bits = max(64, math.ceil(-items * math.log(false_positive) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, items) * math.log(2)))


def bloom_build(values: DataFrame, column: str, items: int, false_positive: float = 0.01) -> DataFrame:
    """word and bits rows of a Bloom filter: a distributed bit array, merged by bitwise or."""
    bits, hashes = bloom_parameters(items, false_positive)
    spots = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), column), F.lit(bits)) for i in range(hashes)]))
    at = values.select(spots.alias("bit"))
    return at.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 64) as int))")).alias("bits"))


def bloom_contains(values: DataFrame, column: str, filter_rows: DataFrame, items: int, false_positive: float = 0.01) -> DataFrame:
    """The distinct values with whether the filter may contain them."""
    bits, hashes = bloom_parameters(items, false_positive)
    spots = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), column), F.lit(bits)) for i in range(hashes)]))
    asked = values.select(column).distinct().select(column, spots.alias("bit")).select(column, "bit", F.expr("bit div 64").alias("word"))
    hit = F.expr("coalesce(bits & shiftleft(1L, cast(pmod(bit, 64) as int)), 0L) != 0")
    return asked.join(filter_rows, "word", "left").groupBy(column).agg(F.every(hit).alias("maybe"))
