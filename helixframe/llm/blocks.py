"""Blocks of documents and the exchange of packed keys between them and key buckets.

Several operators rank keys over a whole corpus: each document block sends every
distinct key it holds once to the bucket that owns the key's range, and gets a
value for each key back. Keys of a block travel as one packed array per bucket,
so a key that a third of all documents hold is one entry per block, and sorting
happens in NumPy within Spark's tasks. The texts are shuffled to their blocks
once; later passes over a block reuse that exchange.

The number of blocks and of buckets follows the corpus' bytes. A block sends a
row to every bucket, so blocks grow with the root of the corpus, from
``BLOCK_BYTES`` at ``ROOT_BYTES`` to ``MOST_BYTES`` at most: up to 32 GB the rows
between blocks and buckets grow in proportion to the input. Beyond, they grow
faster until a row holds a single key, as in an exchange that packs nothing.
All passes are plain lineage over shuffles: a lost executor's tasks run again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import byte_hash
from .common import quoted, text_of

BLOCK_BYTES, ROOT_BYTES = 2 << 20, 512 << 20
LEAST_BYTES, MOST_BYTES = 256 << 10, 16 << 20
#: Stands for a null id within blocks; it sorts before all others.
NULL_ID = -(1 << 63)
KEYS = "block int, bucket int, keys binary, more binary"
TEXT_KEY = ["h", "h2"]


def block_size(total: int) -> int:
    """The bytes of a block of a corpus of so many bytes."""
    return int(min(MOST_BYTES, max(LEAST_BYTES, BLOCK_BYTES * math.sqrt(total / ROOT_BYTES))))


def blocked(docs: DataFrame, block_bytes: int | None = None, carry: bool = False) -> tuple[DataFrame, int]:
    """doc_id (nulls as ``NULL_ID``), text, its 96-bit key (h, h2) and block of each document, and the number of blocks.

    With ``carry`` the whole row goes along as ``row``: its columns but the text as ``own``, and whether the text is null.
    """
    own = F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns if c != "text"))
    whole = [F.struct(own.alias("own"), F.col("text").isNull().alias("no_text")).alias("row")] if carry else []
    kept = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), text_of().alias("text"), *whole)
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / (block_bytes or block_size(total))))
    keyed = kept.select("doc_id", "text", *(["row"] if carry else []), F.xxhash64("text").alias("h"), F.hash("text", F.length("text")).alias("h2"))
    return keyed.withColumn("block", _block("doc_id", count)), count


def _block(id_col: str, count: int) -> Column:
    """Rows are dealt by id and text, so that an id, or the null one, that many rows hold is in all blocks."""
    return F.pmod(F.xxhash64(id_col, "h"), F.lit(count)).cast("int")


def buckets_of(blocks: int) -> int:
    """A bucket has the keys of two blocks, so that packed arrays shrink more slowly than blocks grow in number."""
    return max(4, blocks // 2)


def firsts(placed: DataFrame, count: int) -> DataFrame:
    """rep, rep_h and block of the document with the smallest id of each distinct text; other documents are exact copies."""
    least = placed.groupBy(*TEXT_KEY).agg(F.min("doc_id").alias("rep"))
    return least.select("rep", (F.col("h") + F.lit(0)).alias("rep_h"), _block("rep", count).alias("block"))


def pair_keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One value for an id and its text's key."""
    return byte_hash.mix(ids.astype(np.uint64)) ^ hashes.astype(np.uint64)


def is_first(table: pa.Table, roster: np.ndarray) -> np.ndarray:
    """Which rows stand for their text, given the pair keys of those that do."""
    return np.isin(pair_keys(table["doc_id"].to_numpy(), table["h"].to_numpy()), roster)


def roster_of(wanted: pa.Table) -> np.ndarray:
    return pair_keys(wanted["rep"].to_numpy(), wanted["rep_h"].to_numpy())


#: Stands for the bucket in roster rows, which go straight to their block.
ROSTER = -1


def rosters(placed: DataFrame, count: int) -> DataFrame:
    """block, bucket (``ROSTER``) and entry, 16 bytes, of each document that stands for its text."""
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    return firsts(placed, count).select("block", F.lit(ROSTER).alias("bucket"), F.unhex(F.concat(digits("rep"), digits("rep_h"))).alias("entry"))


def roster_from(entries: pa.ChunkedArray) -> np.ndarray:
    """The pair keys of roster entries."""
    pairs = np.frombuffer(b"".join(entries.to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
    return pair_keys(pairs[:, 0], pairs[:, 1])


def split_keys(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts 64-bit keys by bucket and key, the 32-bit keys in it, and the buckets' n + 1 offsets.

    The bucket comes from the upper half of a key and the lower half is sent.
    Two keys of a bucket share a lower half with a chance of 2**-32 a pair, and
    buckets don't grow with the corpus.
    """
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    packed = bucket << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF))
    order = np.argsort(packed, kind="stable")
    packed = packed[order]
    return order, (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(packed >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def key_rows(block: int, lows: np.ndarray, at: np.ndarray, more: np.ndarray | None = None) -> pa.Table:
    """One row per bucket that has keys."""
    used = np.flatnonzero(np.diff(at))
    take = lambda a: pa.array([a[at[b] : at[b + 1]].tobytes() for b in used], pa.binary())
    extra = take(more) if more is not None else pa.nulls(len(used), pa.binary())
    return pa.table([pa.array([block] * len(used), pa.int32()), pa.array(used, pa.int32()), take(lows), extra], ["block", "bucket", "keys", "more"])


def unpack(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all packed arrays, and the n + 1 offsets."""
    raw = [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.empty(0, dtype) for x in column]
    return (np.concatenate(raw) if raw else np.empty(0, dtype)), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def pack(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())


def by_bucket(table: pa.Table, names: tuple[str, ...]) -> pa.Table:
    """Rows in bucket order, so that concatenated values line up with the keys that were sent."""
    return table.select(list(names)).sort_by("bucket")
