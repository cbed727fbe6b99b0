"""Removal of repeated byte strings by rank pairs, after a sieve of anchors.

This is prefix doubling without its first rounds and without rows of single
positions. In full, every position would be a row (rank, rank at the offset,
document), sorted again for each doubled offset; here

1. ranks begin at ``H``, half the threshold of ``T`` bytes (rounded up): the rank of
   an ``H``-byte string is its 64-bit hash, which all documents agree on without
   a sort. Each ``T``-byte window has one anchor, the smallest ranked (leftmost,
   if equal) of its ``H``-byte strings, so equal windows have equal anchors. Only
   anchors, about two in ``H + 1`` positions, are sent to key buckets; those that
   one document alone holds are unique, and so is every window around them;
2. every window around a surviving anchor is ranked by the pair of ranks ``T - H``
   apart, which is past the threshold: the pairs are sorted, and the smallest
   document of each is found. Surroundings that are equal within a block of
   documents are sent once, and NumPy sorts a bucket's pairs within Spark's tasks.

Exact copies of an earlier document take no part: all their bytes are covered, if
they reach the threshold. Two different strings share a rank with a chance of
about 2**-64. Everything a block sends is distinct within the block, so a passage
that a third of all documents hold is one entry per block.

Null texts are empty; a text shorter than the threshold keeps all bytes; very long
texts are ranked whole, in chunks; matches never cross documents; repeated ids
compare as one document, so their rows never remove each other's bytes. A null id
sorts before all others. An empty table gives no rows. Other columns, whatever
their names, are ignored or (``without_repeats``) kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import byte_hash
from .blocks import KEYS, NULL_ID, ROSTER, blocked, buckets_of, firsts, is_first, key_rows, pack, roster_from, roster_of, rosters, split_keys, unpack
from .common import release

THRESHOLD = 50
_CHUNK = 1 << 18
#: Windows held at once while a bucket of surroundings is ranked.
_RANKED = 1 << 18


class Widths:
    """The widths that follow from a threshold: of windows, anchors, what lies between their starts, and surroundings."""

    def __init__(self, threshold: int):
        if threshold < 2:
            raise ValueError("the threshold must be 2 bytes or more")
        self.window = threshold
        self.anchor = (threshold + 1) // 2
        self.gap = threshold - self.anchor
        self.span = self.gap + threshold
        self.mark_bytes = (self.gap + 8) // 8


class Block:
    """The documents of a block in id order, their anchors and the anchors' surroundings."""

    def __init__(self, table: pa.Table, roster: np.ndarray, widths: Widths):
        self.widths = widths
        table = table.filter(pa.array(is_first(table, roster)))
        table = table.take(pc.sort_indices(table["doc_id"]))
        self.table = table
        self.ids = table["doc_id"].to_numpy()
        self.data, self.at = byte_hash.bytes_of(table["text"])
        self._anchors()

    def _anchors(self) -> None:
        """Anchor positions, documents and ranks; every window start's anchor is the minimum over the window."""
        w = self.widths
        places, ranks, hashes = [], [], []
        for lo, hi in self._chunks():
            data = self.data[lo : hi + w.window - 1]
            rank = byte_hash.fixed(byte_hash.prefix(data), w.anchor)
            # The upper half of a rank orders, the position below breaks ties to the left.
            low = (rank & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(rank), dtype=np.uint64)
            width, least = 1, low
            while width * 2 <= w.gap + 1:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < w.gap + 1:
                rest = w.gap + 1 - width
                least = np.minimum(least[:-rest], least[rest:])
            starts = np.arange(lo, lo + len(least))
            doc = np.searchsorted(self.at, starts, side="right") - 1
            inside = starts + w.window <= self.at[doc + 1]
            flag = np.zeros(len(rank), bool)
            flag[(least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
            found = np.flatnonzero(flag)
            where = found + lo
            left, right = self.sides(where)
            # The surroundings may reach out of the chunk.
            base = max(lo - w.gap, 0)
            around = byte_hash.prefix(self.data[base : hi + w.window - 1 + w.window])
            sides = (left << 32 | right).astype(np.uint64)
            hashes.append(byte_hash.mix(byte_hash.ranges(around, where - left - base, where + right - base) + byte_hash.mix(sides + np.uint64(1))))
            places.append(where)
            ranks.append(rank[found])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.where, self.rank, self.around = join(places, np.int64), join(ranks, np.uint64), join(hashes, np.uint64)
        # Neighbouring chunks may both flag an anchor near their border.
        self.where, keep = np.unique(self.where, return_index=True)
        self.rank, self.around = self.rank[keep], self.around[keep]
        self.owner = np.searchsorted(self.at, self.where, side="right") - 1
        release()

    def sides(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the surroundings of places reach before and after them within their documents."""
        owner = np.searchsorted(self.at, where, side="right") - 1
        return np.minimum(where - self.at[owner], self.widths.gap), np.minimum(self.at[owner + 1] - where, self.widths.window)

    def _chunks(self):
        """Ranges of window starts."""
        last = len(self.data) - self.widths.window + 1
        for lo in range(0, max(last, 0), _CHUNK):
            yield lo, min(lo + _CHUNK, last)

    def distinct_ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchor ranks, and whether documents of two ids hold one."""
        order = np.argsort(self.rank, kind="stable")
        rank, doc = self.rank[order], self.ids[self.owner[order]]
        new = np.ones(len(rank), bool)
        new[1:] = rank[1:] != rank[:-1]
        begin = np.flatnonzero(new)
        if not len(begin):
            return rank, np.empty(0, bool)
        return rank[begin], np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)

    def distinct_around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct surroundings, the first anchor (and so smallest document) of each, and each anchor's place among them."""
        return np.unique(self.around, return_index=True, return_inverse=True)


def _send_ranks(buckets: int, widths: Widths):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, wanted: pa.Table) -> pa.Table:
        ranks, several = Block(table, roster_of(wanted), widths).distinct_ranks()
        order, lows, at = split_keys(ranks, buckets)
        return key_rows(key[0].as_py(), lows, at, several[order].astype(np.uint8))

    return run


def _repeated(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each key sent to a bucket, whether a second document holds it."""
    keys, at = unpack(table["keys"], "<u4")
    several, _ = unpack(table["more"], "u1")
    ordered = np.sort(keys)
    twice = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], keys[several > 0]]))
    place = np.minimum(np.searchsorted(twice, keys), max(len(twice) - 1, 0))
    hit = (twice[place] == keys) if len(twice) else np.zeros(len(keys), bool)
    return pa.table([table["block"], table["bucket"], pack(hit.astype(np.uint8), at)], ["block", "bucket", "hits"])


_SURROUNDINGS = "block int, bucket int, around binary, doc binary, sides binary, bytes binary"


def _send_surroundings(buckets: int, widths: Widths):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, hits: pa.Table) -> pa.Table:
        own = pa.array(hits["bucket"].to_numpy() == ROSTER)
        block = Block(table, roster_from(hits.filter(own)["hits"]), widths)
        ranks, _ = block.distinct_ranks()
        order, _, _ = split_keys(ranks, buckets)
        hit, _ = unpack(hits.filter(pc.invert(own)).sort_by("bucket")["hits"], "u1")
        alive = np.zeros(len(ranks), bool)
        alive[order] = hit > 0
        values, first, _ = block.distinct_around()
        kept = alive[np.searchsorted(ranks, block.rank[first])]
        values, first = values[kept], first[kept]
        where, owner = block.where[first], block.owner[first]
        left, right = block.sides(where)
        bucket = ((block.rank[first] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        padded = np.concatenate([np.zeros(widths.gap, np.uint8), block.data, np.zeros(widths.window, np.uint8)])
        columns: list[list[bytes]] = [[], [], [], []]
        used = np.flatnonzero(np.diff(at))
        for b in used:
            o = order[at[b] : at[b + 1]]
            around = padded[where[o][:, None] + np.arange(widths.span)]
            for column, value in zip(columns, (values[o], block.ids[owner[o]].astype("<i8"), np.stack([left[o], right[o]], 1).astype("<u2"))):
                column.append(value.tobytes())
            columns[3].append(zstandard.compress(around.tobytes(), 1))
        ids = [pa.array([key[0].as_py()] * len(used), pa.int32()), pa.array(used, pa.int32())]
        return pa.table([*ids, *(pa.array(c, pa.binary()) for c in columns)], ["block", "bucket", "around", "doc", "sides", "bytes"])

    return run


_MARKS = "block int, around binary, marks binary"


def _rank_windows(widths: Widths):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """For each surroundings sent, a bit per window that a smaller document holds; those without any are left out."""
        around, at = unpack(table["around"], "<u8")
        doc, _ = unpack(table["doc"], "<i8")
        sides = unpack(table["sides"], "<u2")[0].reshape(-1, 2).astype(np.int64)
        raw = np.concatenate([np.frombuffer(zstandard.decompress(x.as_buffer()), np.uint8) for x in table["bytes"]]).reshape(-1, widths.span)
        marks = np.zeros((len(around), widths.mark_bytes), np.uint8)
        # Windows around different anchors differ, so a bucket is ranked in parts by its anchors.
        anchors = np.empty(len(raw), np.uint64)
        step = max(1, _RANKED // widths.span)
        for lo in range(0, len(raw), step):
            some = raw[lo : lo + step]
            start = np.arange(len(some)) * widths.span + widths.gap
            anchors[lo : lo + len(some)] = byte_hash.ranges(byte_hash.prefix(some.ravel()), start, start + widths.anchor)
        parts = max(1, -(-len(raw) * (widths.gap + 1) // _RANKED))
        # An anchor that many blocks hold has as many rows at most as there are blocks.
        part = (anchors >> np.uint64(7)) % np.uint64(parts)
        groups = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[groups], np.arange(parts + 1))
        before = np.arange(widths.gap + 1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = groups[a:b]
            if not len(rows):
                continue
            sums = byte_hash.prefix(raw[rows].ravel())
            start = (np.arange(len(rows)) * widths.span + widths.gap)[:, None] - before[None, :]
            r, j = np.nonzero((before[None, :] <= sides[rows, :1]) & (widths.window - before[None, :] <= sides[rows, 1:]))
            first = start[r, j]
            # A window's rank is its pair: the rank at its start and that ``gap`` bytes on.
            ranks = byte_hash.ranges(sums, first, first + widths.anchor), byte_hash.ranges(sums, first + widths.gap, first + widths.window)
            owner = doc[rows[r]]
            order = np.lexsort(ranks)
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or(*(x[order][1:] != x[order][:-1] for x in ranks))
            begin = np.flatnonzero(new)
            if not len(begin):
                continue
            least = np.minimum.reduceat(owner[order], begin)
            smaller = np.empty(len(order), bool)
            smaller[order] = np.repeat(least, np.diff(np.append(begin, len(order)))) < owner[order]
            bits = np.zeros((len(rows), widths.gap + 1), bool)
            bits[r[smaller], j[smaller]] = True
            marks[rows] = np.packbits(bits, axis=1, bitorder="little")
        release()
        found = marks.any(1)
        count = np.concatenate([[0], np.cumsum(found)])[at]
        return pa.table([table["block"], pack(around[found], count), pack(marks[found], count)], ["block", "around", "marks"])

    return run


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _remove(widths: Widths):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, marks: pa.Table) -> pa.Table:
        block, copies, (removed, spans, kept) = _removed(table, marks, widths)
        ids = pa.concat_tables([block.table.select(["doc_id"]), copies.select(["doc_id"])])["doc_id"].to_numpy()
        sizes = [len(k) + r for k, r in zip(kept, removed)]
        numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
        return pa.table([pa.array(ids, pa.int64(), mask=ids == NULL_ID), *numbers, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _all_nullable(kind: pa.DataType) -> pa.DataType:
    return pa.struct([pa.field(f.name, _all_nullable(f.type), True) for f in kind]) if pa.types.is_struct(kind) else kind


def _nullable(kind: T.DataType) -> T.DataType:
    return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind]) if isinstance(kind, T.StructType) else kind


def _rewrite(widths: Widths):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, marks: pa.Table) -> pa.Table:
        """The rows with what is left of their texts; characters that lost a byte go with it."""
        block, copies, (_, _, kept) = _removed(table, marks, widths)
        rows = pa.concat_tables([block.table.select(["row"]), copies.select(["row"])])["row"]
        return pa.table([rows.cast(_all_nullable(rows.type)), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())], ["row", "text"])

    return run


def _removed(table: pa.Table, marks: pa.Table, widths: Widths) -> tuple[Block, pa.Table, tuple[list, list, list]]:
    """The block, the exact copies left out of it, and for both in that order the removed bytes, spans and kept bytes."""
    own = marks["marks"].is_null()
    roster = roster_from(marks.filter(own)["around"])
    marks = marks.filter(pc.invert(own))
    copies = table.filter(pa.array(~is_first(table, roster)))
    block = Block(table, roster, widths)
    values, first, place = block.distinct_around()
    bits = np.zeros((len(values), widths.mark_bytes), np.uint8)
    if marks.num_rows:
        known, _ = unpack(marks["around"], "<u8")
        np.bitwise_or.at(bits, np.searchsorted(values, known), unpack(marks["marks"], "u1")[0].reshape(-1, widths.mark_bytes))
    # Within a block, later documents repeat the first with the same surroundings, whatever its windows are.
    ids = block.ids[block.owner]
    later = ids > ids[first][place] if len(ids) else np.empty(0, bool)
    left, right = block.sides(block.where)
    mine = bits[place] if len(place) else bits[:0]
    some = np.flatnonzero(later | mine.any(1))
    starts, whole, marked, before, after = block.where[some], later[some], mine[some], left[some], right[some]
    removed, spans, kept = np.zeros(len(block.ids), np.int64), np.zeros(len(block.ids), np.int64), []
    for d, (a, b) in enumerate(zip(block.at[:-1], block.at[1:])):
        x, y = np.searchsorted(starts, (a, b))
        if x == y:
            kept.append(block.data[a:b].tobytes())
            continue
        edge = np.zeros(b - a + 1, np.int32)
        flags = np.unpackbits(marked[x:y], axis=1, count=widths.gap + 1, bitorder="little").astype(bool) | whole[x:y, None]
        for j in range(widths.gap + 1):
            hit = flags[:, j] & (j <= before[x:y]) & (widths.window - j <= after[x:y])
            begin = starts[x:y][hit] - j - a
            edge[begin] += 1  # anchors of a document differ, so no place comes twice
            edge[begin + widths.window] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        removed[d] = gone.sum()
        spans[d] = gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()
        kept.append(block.data[a:b][~gone].tobytes())
    data, at = byte_hash.bytes_of(copies["text"])
    whole = np.diff(at)
    covered = np.where(whole >= widths.window, whole, 0)
    kept += [b"" if c else data[a : a + n].tobytes() for a, n, c in zip(at[:-1], whole, covered)]
    return block, copies, ([*removed.tolist(), *covered.tolist()], [*spans.tolist(), *(covered > 0).astype(int).tolist()], kept)


def _marked(placed: DataFrame, blocks: int, widths: Widths):
    """The texts by block, and what of them smaller documents hold. Rosters go straight to their blocks."""
    buckets = buckets_of(blocks)
    texts, known = placed.groupBy("block"), rosters(placed, blocks)
    ranked = texts.cogroup(firsts(placed, blocks).groupBy("block")).applyInArrow(_send_ranks(buckets, widths), KEYS).groupBy("bucket").applyInArrow(_repeated, "block int, bucket int, hits binary")
    sent = texts.cogroup(ranked.union(known).groupBy("block")).applyInArrow(_send_surroundings(buckets, widths), _SURROUNDINGS)
    marks = sent.groupBy("bucket").applyInArrow(_rank_windows(widths), _MARKS).union(known.select("block", "entry", F.lit(None).cast("binary")))
    return texts, marks.groupBy("block")


def remove_repeats(docs: DataFrame, block_bytes: int | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes of each text that are left."""
    widths = Widths(threshold)
    texts, marks = _marked(*blocked(docs, block_bytes), widths)
    return texts.cogroup(marks).applyInArrow(_remove(widths), _RESULT)


def without_repeats(docs: DataFrame, block_bytes: int | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """The same rows and columns with repeats taken out of ``text``, and ``n_chars`` recounted if there. Null texts stay null."""
    widths = Widths(threshold)
    placed, blocks = blocked(docs, block_bytes, carry=True)
    texts, marks = _marked(placed, blocks, widths)
    out = texts.cogroup(marks).applyInArrow(_rewrite(widths), T.StructType([T.StructField("row", _nullable(placed.schema["row"].dataType)), T.StructField("text", T.StringType())]))
    own, no_text = F.col("row.own"), F.col("row.no_text")
    made = {c: own.getField(c) for c in docs.columns if c != "text"} | {"text": F.when(~no_text, F.col("text"))}
    if "n_chars" in made:
        made["n_chars"] = F.when(no_text, made["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(made[c].alias(c) for c in docs.columns))


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
