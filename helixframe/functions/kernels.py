"""NumPy kernels over Arrow batches of reads: position and value counts, Phred sums and k-mer codes.

Built-ins can only reach a string's characters through an array of one-letter
strings and a lambda, neither of which is compiled. These kernels work on the
bytes of a whole batch at once. Each task adds up what it counts and sends only
the cells of its matrix, whatever the number of reads. They also keep Catalyst
from copying a read's derivation into every expression over its characters.

A null string is an empty one. Characters beyond U+00FF count as U+00FF.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest k whose counts fit a dense table, and whose code fits 64 bits.
DENSE_K, MAX_K = 10, 31


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte per character of a string array, and the n + 1 offsets."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    found = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    if found.max() < 0x80:
        return found, at - at[0]
    rows = [bytes(min(ord(c), 255) for c in t) for t in texts.to_pylist()]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


@lru_cache(maxsize=1)
def base_codes() -> np.ndarray:
    """0 to 3 for A, C, G, T in either case, 4 for everything else."""
    table = np.full(256, 4, np.uint8)
    for i, b in enumerate("ACGT"):
        table[[ord(b), ord(b.lower())]] = i
    return table


@lru_cache(maxsize=1)
def phreds() -> np.ndarray:
    """The Phred+33 value of a character, at least 0."""
    return np.maximum(np.arange(256) - 33, 0)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])


def places(at: np.ndarray) -> np.ndarray:
    """Each character's position in its own row."""
    return np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))


class Cells:
    """A position x value matrix that grows with the positions seen, up to ``limit``."""

    def __init__(self, classes: np.ndarray, limit: int):
        self.classes, self.limit, self.width = classes.astype(np.int64), limit, int(classes.max()) + 1
        self.counts = np.zeros(0, np.int64)

    def add(self, data: np.ndarray, at: np.ndarray) -> None:
        where, kind = places(at), self.classes[data]
        if len(where) and int(np.diff(at).max()) > self.limit:
            near = where < self.limit
            where, kind = where[near], kind[near]
        got = np.bincount(where * self.width + kind)
        if len(got) > len(self.counts):
            got[: len(self.counts)] += self.counts
            self.counts = got
        else:
            self.counts[: len(got)] += got

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, values and counts of the cells in use."""
        used = np.flatnonzero(self.counts)
        return used // self.width, used % self.width, self.counts[used]


def capped(cap: int) -> np.ndarray:
    return np.minimum(phreds(), cap)


def position_counts(reads: DataFrame, column: str, classes: np.ndarray, limit: int) -> DataFrame:
    """pos (from 0), kind (what ``classes`` gives a byte) and n of the first ``limit`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(classes, limit)
        for b in batches:
            cells.add(*flat(b.column(0)))
        pos, kind, n = cells.rows()
        yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int32()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], ["pos", "kind", "n"])

    partial = reads.select(column).mapInArrow(run, "pos int, kind int, n bigint")
    return partial.groupBy("pos", "kind").agg(F.sum("n").alias("n"))


def value_counts(reads: DataFrame, column: str, classes: np.ndarray) -> DataFrame:
    """kind and n of all characters, whatever their position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            total += np.bincount(flat(b.column(0))[0], minlength=256)
        n = np.bincount(classes, total).astype(np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], ["kind", "n"])

    return reads.select(column).mapInArrow(run, "kind int, n bigint").groupBy("kind").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=1)
def valid_bases() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in "ACGTNacgtn"]] = True
    return table


def base_sums(reads: DataFrame) -> DataFrame:
    """len, a, c, g, t, n (all others) and bad (neither of them nor the letter N) of each read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = flat(b.column(0))
            kind = base_codes()[data]
            counts = [sums(kind == i, at) for i in range(4)]
            size = np.diff(at)
            columns = [size, *counts, size - sum(counts), sums(~valid_bases()[data], at)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["len", *"acgtn", "bad"])

    return reads.select("seq").mapInArrow(run, ", ".join(f"{c} bigint" for c in ("len", *"acgtn", "bad")))


def quality_sums(reads: DataFrame) -> DataFrame:
    """bases (of the sequence), size (of the quality) and phreds (its sum) of each read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = flat(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(sums(phreds()[data], at))], ["bases", "size", "phreds"])

    return reads.select(F.length("seq").cast("bigint").alias("bases"), "qual").mapInArrow(run, "bases bigint, size bigint, phreds bigint")


def passing(reads: DataFrame, min_quality: float) -> DataFrame:
    """The rows whose mean Phred value reaches ``min_quality``, unchanged; an empty quality passes."""
    at_column = reads.columns.index("qual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = flat(b.column(at_column))
            size = np.diff(at)
            mean = sums(phreds()[data], at) / np.maximum(size, 1)
            yield b.filter(pa.array((size == 0) | (mean >= min_quality)))

    return reads.mapInArrow(run, reads.schema)


def codes_of(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The base-4 codes of all k-mers of A, C, G, T, first base most significant, and the row of each."""
    bases, n = base_codes()[data], len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.zeros(n, np.int64)
    for j in range(k):
        code <<= 2
        code |= bases[j : j + n] & 3
    odd = np.concatenate([[0], np.cumsum(bases > 3)])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    good = (odd[k:] == odd[:n]) & (np.arange(n) + k <= at[row + 1])
    return code[good], row[good]


def tails(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``size`` characters of the rows that have as many."""
    ends = at[1:][np.diff(at) >= size]
    return data[(ends[:, None] - size + np.arange(size)[None, :]).ravel()], np.arange(len(ends) + 1) * size


def code_counts(reads: DataFrame, k: int, tail: int = 0) -> DataFrame:
    """code and n of the k-mers of A, C, G, T, for k up to ``MAX_K``; with ``tail`` those in the last so many bases of reads as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**k if k <= DENSE_K else 0, np.int64)
        rows = lambda code, n: pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])
        for b in batches:
            found = flat(b.column(0))
            code, _ = codes_of(*(tails(*found, tail) if tail else found), k)
            if k <= DENSE_K:
                total += np.bincount(code, minlength=len(total))
            else:
                yield rows(*np.unique(code, return_counts=True))
        used = np.flatnonzero(total)
        yield rows(used, total[used])

    return reads.select("seq").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Values, in row order, as a list per row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values, pa.int64()))


def distinct_codes(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of each row, ascending, and their rows."""
    code, row = codes_of(data, at, k)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], row[new]


def read_codes(reads: DataFrame, k: int) -> DataFrame:
    """id and codes, the distinct k-mers of each read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, row = distinct_codes(*flat(b.column(1)), k)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(code, row, b.num_rows)], ["id", "codes"])

    kind = reads.schema["id"].dataType.simpleString()
    return reads.select("id", "seq").mapInArrow(run, f"id {kind}, codes array<bigint>")


def sketch_rows(rows: DataFrame, key: str, k: int, scale: list[int], shift: list[int], prime: int) -> DataFrame:
    """The key and the minima of (scale * code + shift) mod prime over each row's k-mers; rows without a k-mer are left out."""
    a, c = np.array(scale, np.int64), np.array(shift, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, row = codes_of(*flat(b.column(1)), k)
            have, begin = np.unique(row, return_index=True)
            code = code % prime
            least = [np.minimum.reduceat((x * code + y) % prime, begin) if len(have) else np.empty(0, np.int64) for x, y in zip(a, c)]
            cells = np.stack(least, 1).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1) * len(a), pa.int32()), pa.array(cells, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(have)), lists], ["id", "sketch"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "seq").mapInArrow(run, f"id {kind}, sketch array<bigint>")


#: Rows of ``report_counts``: what they count, two coordinates and a number.
REPORT = "what string, x int, y int, n bigint"


def _report_batch(rows: list[tuple[str, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["what", "x", "y", "n"])


def _summed(partial: DataFrame) -> DataFrame:
    n = F.when(F.col("what") == "shortest", F.min("n")).when(F.col("what") == "longest", F.max("n")).otherwise(F.sum("n"))
    return partial.groupBy("what", "x", "y").agg(n.alias("n"))


def report_counts(reads: DataFrame, length_cap: int, positions: int, quality_cap: int) -> DataFrame:
    """Everything the default report holds, from one pass over the reads.

    ``what`` is reads, bases, bad, base (x: 0 to 4 for A, C, G, T, others), gc
    (x: percent), length (x: capped), quality (x: position, y: Phred value), and
    shortest and longest, whose n are lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = {"reads": 0, "bases": 0, "bad": 0}
        base, gc, lengths = np.zeros(5, np.int64), np.zeros(101, np.int64), np.zeros(length_cap + 1, np.int64)
        ends: list[int] = []
        cells = Cells(capped(quality_cap), positions)
        for b in batches:
            data, at = flat(b.column(0))
            size = np.diff(at)
            kind = base_codes()[data]
            plain["reads"] += b.num_rows
            plain["bases"] += len(data)
            plain["bad"] += int((~valid_bases()[data]).sum())
            base += np.bincount(kind, minlength=5)
            share = (sums((kind == 1) | (kind == 2), at)[size > 0] / size[size > 0]).astype(np.float32)
            gc += np.bincount(np.minimum(np.floor(share * np.float32(100)).astype(np.int64), 100), minlength=101)
            lengths += np.bincount(np.minimum(size, length_cap), minlength=length_cap + 1)
            ends += [int(size.min()), int(size.max())] if len(size) else []
            cells.add(*flat(b.column(1)))
        rows = [(w, 0, 0, n) for w, n in plain.items()]
        rows += [(w, i, 0, int(v[i])) for w, v in (("base", base), ("gc", gc), ("length", lengths)) for i in np.flatnonzero(v)]
        rows += [("shortest", 0, 0, min(ends)), ("longest", 0, 0, max(ends))] if ends else []
        rows += [("quality", *r) for r in zip(*(x.tolist() for x in cells.rows()))]
        yield _report_batch(rows)

    return _summed(reads.select("seq", "qual").mapInArrow(run, REPORT))


_OPERATION = re.compile(r"(\d+)([MIDNSHP=X])")
CIGAR_SUMS = ("aligned", "insertions", "deletions", "soft_clips")
_SUM_OF = {"M": 0, "=": 0, "X": 0, "I": 1, "D": 2, "S": 3}


@lru_cache(maxsize=1 << 16)
def cigar_sums(cigar: str) -> tuple[int, int, int, int]:
    """Aligned, inserted, deleted and soft-clipped bases."""
    out = [0, 0, 0, 0]
    for n, c in _OPERATION.findall(cigar):
        if c in _SUM_OF:
            out[_SUM_OF[c]] += int(n)
    return tuple(out)


def alignment_counts(records: DataFrame, insert_bin: int) -> DataFrame:
    """Everything the alignment report holds, from one pass, as rows of ``REPORT``.

    ``what`` is records, mapq (x: the quality, -1 for null), one of
    ``CIGAR_SUMS``, clipped (records with soft clips), pairs (x: the bin of a
    positive template length), inserts (their sum), and shortest and longest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mapq, inserts = 0, {}, {}
        sums_, clipped, total, ends = np.zeros(4, np.int64), 0, 0, []
        for b in batches:
            count += b.num_rows
            for k, n in zip(*(x.tolist() for x in np.unique(b.column(0).fill_null(-1).to_numpy(), return_counts=True))):
                mapq[k] = mapq.get(k, 0) + n
            for c in b.column(1).drop_null().value_counts():
                found, n = np.array(cigar_sums(c["values"].as_py())), c["counts"].as_py()
                sums_ += found * n
                clipped += n if found[3] else 0
            sizes = b.column(2).drop_null().to_numpy().astype(np.int64)
            sizes = sizes[sizes > 0]
            if len(sizes):
                total += int(sizes.sum())
                ends += [int(sizes.min()), int(sizes.max())]
                for k, n in zip(*(x.tolist() for x in np.unique(sizes // insert_bin, return_counts=True))):
                    inserts[k] = inserts.get(k, 0) + n
        rows = [("records", 0, 0, count), ("clipped", 0, 0, clipped), ("inserts", 0, 0, total)]
        rows += [(w, 0, 0, int(n)) for w, n in zip(CIGAR_SUMS, sums_)]
        rows += [("mapq", k, 0, n) for k, n in mapq.items()] + [("pairs", k, 0, n) for k, n in inserts.items()]
        rows += [("shortest", 0, 0, min(ends)), ("longest", 0, 0, max(ends))] if ends else []
        yield _report_batch(rows)

    return _summed(records.select("mapping_quality", "cigar", "template_length").mapInArrow(run, REPORT))
