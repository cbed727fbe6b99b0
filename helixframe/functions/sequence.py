"""Column expressions over sequences, qualities and CIGAR strings; all are built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def normalized(seq: Column | str = "seq") -> Column:
    """Upper case, everything but A, C, G, T as N."""
    return F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "N")


def count_of(text: Column, letter: str) -> Column:
    """How often a letter occurs; two length lookups and no array."""
    return (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))).cast("bigint")


def base_counts(seq: Column | str = "seq") -> dict[str, Column]:
    """The counts of a, c, g, t and n (everything else) of one sequence."""
    upper = F.upper(_c(seq))
    counts = {b.lower(): count_of(upper, b) for b in BASES}
    return counts | {"n": F.length(upper).cast("bigint") - sum(counts.values(), F.lit(0))}


def invalid_bases(seq: Column | str = "seq") -> Column:
    """Bases that are neither A, C, G, T nor N, in either case."""
    return F.length(F.regexp_replace(_c(seq), "[ACGTNacgtn]", "")).cast("bigint")


def gc_bin(gc: Column, length: Column) -> Column:
    """Percent of G and C, truncated, in 32-bit floating point; null for an empty sequence."""
    share = (gc.cast("double") / F.nullif(length, F.lit(0))).cast("float")
    return F.least(F.floor((share * F.lit(100).cast("float")).cast("float")).cast("int"), F.lit(100))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of ``k`` letters, none for a shorter sequence."""
    every = F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(F.length(seq) >= k, every).otherwise(F.array().cast("array<string>"))


def kmer_id(kmer: Column) -> Column:
    """The base-4 number of a k-mer of up to 31 letters, first base most significant."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def kmer_of(code: Column, k: int) -> Column:
    """The k-mer of a base-4 number."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def two_bit(seq: Column | str = "seq") -> tuple[Column, Column]:
    """Digits 0 to 3 for A, C, G, T (0 for others) and a mask of 1 for valid letters."""
    n = normalized(seq)
    return F.translate(n, "ACGTN", "01230"), F.translate(n, "ACGTN", "11110")


def entropy(counts: dict[str, Column], length: Column) -> Column:
    """Bits of A, C, G, T with N in the denominator; null for an empty sequence."""
    total = F.lit(0.0)
    for b in BASES.lower():
        p = counts[b] / F.nullif(length, F.lit(0))
        total = total - F.when(counts[b] > 0, p * F.log2(p)).otherwise(0.0)
    return F.when(length > 0, total)


def cigar_sum(cigar: Column | str, operators: str) -> Column:
    """The summed lengths of the CIGAR operators named."""
    found = F.regexp_extract_all(_c(cigar), F.lit(rf"(\d+)[{operators}]"), 1)
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def cigar_stats(cigar: Column | str = "cigar") -> dict[str, Column]:
    """aligned (M, =, X), insertions, deletions and soft-clipped bases."""
    return {"aligned": cigar_sum(cigar, "M=X"), "insertions": cigar_sum(cigar, "I"), "deletions": cigar_sum(cigar, "D"), "soft_clips": cigar_sum(cigar, "S")}


def signature(seq: Column | str = "seq") -> Column:
    """A 64-bit signature of the normalized bases."""
    return F.xxhash64(normalized(seq))
