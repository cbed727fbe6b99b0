"""Lexical retrieval packing into sequences of a fixed length.

Documents are tokenized once and written to the shared folder, with the number of
documents that hold each token id; that table has as many rows as the tokenizer
has ids, so the driver and every task may hold it. A document's signature is a few
weighted samples of its terms (of the smallest of -log(u) / idf, with u a hash of
the term and the sample's number), which two documents share as they share their
rare terms. Rows are sorted by signature over the whole corpus in ranges, so
lexical neighbours stand side by side however large the corpus is, and ties of a
hot signature are split by id. Each range is cut into shards of about
``SHARD_TOKENS`` as it streams by.

A shard holds a BM25 inverted index over the documents' last pieces (whole windows
of longer documents are sequences of their own), with document frequencies and
mean size of the whole corpus: each seed's query returns the unused neighbours by
score, which fill the window one after the other. The one that no longer fits is
cut, and its rest is the seed of the next window; without a neighbour that shares
a term, the next unused document in order follows. The last, unfilled window of a
shard goes over to the next; what is left of a range at its end is cut into
powers of two, which need no padding.

A null text is empty, and like every document ends with the separator id. Repeated
rows are packed each on its own; a null id is a document of its own; an empty table
gives no rows; very long texts are packed whole. Other columns, whatever their
names, are ignored. Sequence ids are unique: the range's number over 2**32, plus a
count. Which documents meet depends on the ranges, and so on how rows are stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_hash
from .common import bounded, id_and_text, partitions_of, pieces, release, shared_path
from .word_tokens import tokens

LENGTH = 2048
SEPARATOR = 1
#: Tokens of a shard, and bytes of the ids in a range.
SHARD_TOKENS, RANGE_BYTES = 650_000, 64 << 20
#: Terms in a signature.
SAMPLES = 3
K1, B = 1.2, 0.75


def idf_of(df: np.ndarray, documents: int) -> np.ndarray:
    """BM25's weight of each term; 0 for terms that one document or half of all hold."""
    idf = np.log((max(1, documents) - df + 0.5) / (df + 0.5))
    return np.where((idf > 0) & (df > 1), idf, 0.0)


def sample_costs(idf: np.ndarray) -> np.ndarray:
    """For each sample and term a 64-bit value whose order is that of -log(u) / idf, the term in its lower half; the largest for terms without weight."""
    terms = np.arange(len(idf), dtype=np.uint64)
    rows = []
    for r in range(SAMPLES):
        u = (byte_hash.mix(terms * np.uint64(SAMPLES) + np.uint64(r + 1)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        with np.errstate(divide="ignore"):
            cost = (-np.log(np.maximum(u, 2.0**-60)) / idf).astype(np.float32)
        # Positive floats sort as their bits do.
        rows.append(np.where(idf > 0, cost.view(np.uint32).astype(np.uint64) << np.uint64(32) | terms, np.uint64(0xFFFFFFFFFFFFFFFF)))
    return np.stack(rows)


class Index:
    """BM25 over the token ids of a shard's pieces. Terms without weight, and those that half of the pieces hold, have no postings.

    Without corpus statistics the pieces are the corpus.
    """

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None):
        sizes = np.array([len(p) for p in pieces], np.int64)
        owner = np.repeat(np.arange(len(pieces), dtype=np.uint64), sizes)
        flat = np.concatenate(pieces).astype(np.uint64) if pieces else np.empty(0, np.uint64)
        pairs, tf = np.unique(flat << np.uint64(32) | owner, return_counts=True)
        term, doc = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        terms, begin, df = np.unique(term, return_index=True, return_counts=True)
        weight = idf_of(df, len(pieces)) if idf is None else np.where(idf_of(df, len(pieces)) > 0, idf[terms], 0.0)
        used = weight > 0
        keep = np.repeat(used, df)
        norm = K1 * (1 - B + B * sizes / max(1.0, mean or (sizes.mean() if len(sizes) else 1.0)))
        self.doc, tf = doc[keep], tf[keep]
        self.weight = np.repeat(weight[used], df[used]) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.begin = np.concatenate([[0], np.cumsum(df[used])])
        # Each piece's terms, as places among the terms that are kept.
        row = np.repeat(np.arange(used.sum()), df[used])
        order = np.argsort(self.doc, kind="stable")
        self.terms, self.terms_at = row[order], np.searchsorted(self.doc[order], np.arange(len(pieces) + 1))
        self.count = len(pieces)

    def scores(self, seed: int) -> np.ndarray:
        rows = self.terms[self.terms_at[seed] : self.terms_at[seed + 1]]
        size = self.begin[rows + 1] - self.begin[rows]
        if not len(rows):
            return np.zeros(self.count)
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.begin[rows] - (ends - size), size)
        return np.bincount(self.doc[at], self.weight[at], self.count)


def arrange(sizes: list[int], index: Index | None, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, begin, end), each but the last ``length`` long in all.

    ``sizes`` are below ``length``; pieces are seeds in their order.
    """
    n, used, seed = len(sizes), np.zeros(len(sizes), bool), 0
    out: list[list[tuple[int, int, int]]] = []
    rest: tuple[int, int] | None = None
    while True:
        if rest is None:
            while seed < n and used[seed]:
                seed += 1
            if seed == n:
                break
            used[seed] = True
            rest = (seed, 0)
        head, begin = rest
        window, room, rest = [(head, begin, sizes[head])], length - (sizes[head] - begin), None
        if room > 0:
            for i in _neighbours(index, head, used, seed):
                used[i] = True
                take = min(room, sizes[i])
                window.append((i, 0, take))
                room -= take
                if take < sizes[i]:
                    rest = (i, take)
                if room == 0:
                    break
        out.append(window)
    return out


def _neighbours(index: Index | None, head: int, used: np.ndarray, seed: int):
    """Unused pieces: those that share terms by descending score, then the others in order."""
    if index is not None:
        scores = index.scores(head)
        scores[used] = 0
        found = np.flatnonzero(scores)
        top = 64
        if len(found) > top:
            best = found[np.argpartition(-scores[found], top)[:top]]
            best = best[scores[best] > scores[best].min()]
        else:
            best = found
        yield from best[np.lexsort((best, -scores[best]))].tolist()
        scores[best] = 0
        found = np.flatnonzero((scores > 0) & ~used)
        yield from found[np.lexsort((found, -scores[found]))].tolist()
    for i in range(seed, len(used)):
        if not used[i]:
            yield i


def powers_of_two(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into ones whose lengths are powers of two, longest first."""
    out, left, parts = [], sum(e - b for _, b, e in sequence), list(sequence)
    while left:
        want, cut = 1 << (left.bit_length() - 1), []
        left -= want
        while want:
            i, b, e = parts.pop(0)
            take = min(want, e - b)
            cut.append((i, b, b + take))
            if b + take < e:
                parts.insert(0, (i, b + take, e))
            want -= take
        out.append(cut)
    return out


_PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
_TOKENIZED = "doc_id bigint, ids binary, terms binary, counts binary"
#: Terms of statistics rows: the documents' last pieces, and their tokens.
_PIECES_ROW, _TOKENS_ROW = -1, -2


class Packer:
    """Takes documents as they stream by, and gives the rows of the sequences that are full."""

    def __init__(self, base: int, length: int, idf: np.ndarray | None, mean: float | None):
        self.base, self.length, self.idf, self.mean = base, length, idf, mean
        self.count = self.held = 0
        self.rows: list[tuple] = []
        #: Unplaced pieces: document, its tokens, where the piece begins, and its ids.
        self.tails: list[tuple[int | None, int, int, np.ndarray]] = []

    def _emit(self, tail: tuple[int | None, int, int, np.ndarray], begin: int, end: int, offset: int) -> None:
        doc, total, at, ids = tail
        self.rows.append((doc, at + begin, end - begin, ids[begin:end].tobytes(), total, self.base + self.count, offset))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.length * self.length
        for begin in range(0, whole, self.length):
            self._emit((doc, len(ids), 0, ids), begin, begin + self.length, 0)
            self.count += 1
        if whole < len(ids):
            # A copy, as the batch that ``ids`` looks into goes.
            self.tails.append((doc, len(ids), whole, ids[whole:].copy()))
            self.held += len(ids) - whole

    def shard(self, last: bool = False) -> None:
        """Arrange what is held; an unfilled window goes over to the next shard, or is cut if this is the last."""
        tails, self.tails, self.held = self.tails, [], 0
        sequences = arrange([len(t[3]) for t in tails], Index([t[3] for t in tails], self.idf, self.mean), self.length)
        if sequences and sum(e - b for _, b, e in sequences[-1]) < self.length:
            rest = sequences.pop()
            if last:
                sequences += powers_of_two(rest)
            else:
                for i, b, e in rest:
                    doc, total, at, ids = tails[i]
                    self.tails.append((doc, total, at + b, ids[b:e]))
                    self.held += e - b
        for sequence in sequences:
            offset = 0
            for i, b, e in sequence:
                self._emit(tails[i], b, e, offset)
                offset += e - b
            self.count += 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The rows so far, a thousand at a time."""
        rows, self.rows = self.rows, []
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 1000]), _KINDS)], list(_NAMES))


def _statistics_batch(counts: np.ndarray, tails: int, size: int) -> pa.RecordBatch:
    used = np.flatnonzero(counts)
    terms, n = np.concatenate([used, [_PIECES_ROW, _TOKENS_ROW]]).astype("<i8"), np.concatenate([counts[used], [tails, size]]).astype("<i8")
    return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([terms.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["doc_id", "ids", "terms", "counts"])


def tokenized(docs: DataFrame, tokenizer_path: str, length: int, separator: int) -> DataFrame:
    """doc_id and packed ids of each document, and a row per task with the pieces that hold each term, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(tokenizer_path)
        kind = "<u2" if max(known.size, separator + 1) <= 1 << 16 else "<u4"
        counts, tails, size = np.zeros(max(known.size, separator + 1), np.int64), 0, 0
        end = np.array([separator], kind)
        for b in batches:
            ids, at = known.encode(b.column(1))
            ids = ids.astype(kind)
            packed = [np.concatenate([ids[x:y], end]) for x, y in zip(at[:-1], at[1:])]
            left = [p[len(p) // length * length :] for p in packed]
            sizes = np.array([len(t) for t in left])
            pairs = np.unique(np.repeat(np.arange(len(left), dtype=np.uint64), sizes) << np.uint64(32) | np.concatenate(left).astype(np.uint64))
            counts += np.bincount((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(counts))
            tails, size = tails + int((sizes > 0).sum()), size + int(sizes.sum())
            none = pa.nulls(len(packed), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.tobytes() for p in packed], pa.binary()), none, none], ["doc_id", "ids", "terms", "counts"])
        yield _statistics_batch(counts, tails, size)

    kept = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    path = shared_path(docs.sparkSession, "tokens")
    kept.mapInArrow(bounded(run, keeps="tokens"), _TOKENIZED).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def statistics(rows: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """The weight of each term over the whole corpus, and the mean size of a last piece; ``size`` token ids at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, counts in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), "<i8")) for x in (terms, counts)], ["term", "n"])

    found = rows.filter("terms is not null").select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size, np.int64)
    total = {_PIECES_ROW: 0, _TOKENS_ROW: 0}
    for r in found:
        if r["term"] < 0:
            total[r["term"]] = r["n"]
        else:
            df[r["term"]] = r["n"]
    return idf_of(df, total[_PIECES_ROW]), total[_TOKENS_ROW] / max(1, total[_PIECES_ROW])


def signed(rows: DataFrame, idf: np.ndarray, length: int, kind: str) -> DataFrame:
    """doc_id, ids, and the terms of each document's signature."""
    names = [f"s{r}" for r in range(SAMPLES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = sample_costs(idf)
        for b in batches:
            ids = [np.frombuffer(x.as_buffer(), kind) for x in b.column(1)]
            left = [x[len(x) // length * length :] for x in ids]
            sizes = np.array([len(x) for x in left])
            flat, begin = np.concatenate(left), np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0]
            columns = []
            for cost in costs:
                # The term of the least cost is in the lower half; none has weight: -1.
                least = np.full(len(left), np.uint64(0xFFFFFFFFFFFFFFFF))
                if len(begin):
                    least[sizes > 0] = np.minimum.reduceat(cost[flat], begin)
                columns.append(pa.array((least & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "ids", *names])

    documents = rows.filter("ids is not null").select("doc_id", "ids")
    return documents.mapInArrow(bounded(run), "doc_id bigint, ids binary, " + ", ".join(f"{n} int" for n in names))


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, separator: int = SEPARATOR, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece; ids are packed little-endian unsigned 32-bit."""
    size = max(tokens(tokenizer_path).size, separator + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = tokenized(docs, tokenizer_path, length, separator)
    idf, mean = statistics(rows, size)
    total = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 32, length, idf, mean)
        for b in pieces(batches):
            for doc, x in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(doc, np.frombuffer(x.as_buffer(), kind).astype("<u4"))
                if packer.held >= shard_tokens:
                    packer.shard()
                    release()
            yield from packer.batches()
        packer.shard(last=True)
        yield from packer.batches()
        release()

    order = [*(f"s{r}" for r in range(SAMPLES)), "doc_id", "tie"]
    ranges = max(partitions_of(docs.sparkSession), math.ceil(total / RANGE_BYTES))
    placed = signed(rows, idf, length, kind).withColumn("tie", F.xxhash64("ids"))
    sorted_rows = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return sorted_rows.select("doc_id", "ids").mapInArrow(run, _PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
