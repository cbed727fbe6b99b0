"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector's code is the signs of its rotated direction, packed into bits, with
scalars: its length and how well the code stands for it (their inner product).
They give an unbiased estimate of an inner product and a bound of its error, which
falls with the square root of the dimension. The rotation is made from a seed,
nothing is fitted, and every vector is coded.

1. Vectors are dealt into blocks by id and written with their codes in columns of
   their own, so the passes over codes read no vectors.
2. Blocks of codes meet blocks of queries. Each query's best estimates, a few from
   each group of blocks, are scored on the original vectors; their k-th score is the query's
   reach, which the true k-th can't fall below.
3. Codes meet queries again, and every candidate whose estimate plus ``bound``
   standard errors attains the reach is scored on its original vector.

Only a query's vector and its candidates' places travel to a block of vectors, as a
list or a bit each, whichever is shorter. The
bound is probabilistic; ``bound=None`` is the exact way, which scores every
candidate. Scores are double-precision sums of products in component order. Codes
are made from vectors divided by their largest component, so any finite magnitude
has one; products beyond the range of a double are infinite or zero as in any sum.

Vectors that are null, zero or hold null or non-finite components take no part, nor
do null ids; vectors meet those of their own dimension. Rows that repeat an id
count once, with the vector that sorts first. Fewer candidates than k give all of
them; ties go to the smaller id. An empty table, or one without queries, gives no
rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions_of, shared_path

K, BOUND, SEED = 20, 3.0, 20240517
#: Bytes of a block of vectors, and of the codes and the queries that meet in a task.
VECTOR_BYTES, CODE_BYTES, QUERY_BYTES = 16 << 20, 16 << 20, 8 << 20
#: Queries at a time, and candidates of the best estimates that set a query's reach.
_AT_ONCE, _FIRST = 32, 256
#: Bytes of a vector's scalars and id beside its code.
_SCALARS = 32


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, largest components, lengths of the vectors divided by them, and the inner products of directions with their codes."""
    tops = np.abs(vectors).max(1)
    scaled = vectors / tops[:, None]
    norms = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
    turned = (scaled / norms[:, None]) @ rotation(vectors.shape[1], seed).T
    return np.packbits(turned > 0, axis=1), tops, norms, np.abs(turned).sum(1) / math.sqrt(vectors.shape[1])


class Codes:
    """A block's codes, to estimate inner products from."""

    def __init__(self, dim: int, ids: np.ndarray, codes: np.ndarray, tops: np.ndarray, norms: np.ndarray, fits: np.ndarray, seed: int = SEED):
        self.dim, self.ids, self.tops, self.seed = dim, ids, tops, seed
        self.signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
        self.scale = norms / fits
        #: A standard error, and what single precision may add, of a query of length 1.
        self.error = self.scale * np.sqrt(np.maximum(0.0, 1 - fits**2)) / math.sqrt(max(1, dim - 1))
        self.slack = self.scale * dim * 2.0**-22

    def estimates(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, float, float]]:
        """For each query its place, its estimates over the vectors' largest components and its own, that component, and its length over it."""
        tops = np.abs(queries).max(1)
        scaled = queries / tops[:, None]
        lengths = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
        for lo in range(0, len(queries), _AT_ONCE):
            turned = (scaled[lo : lo + _AT_ONCE] @ rotation(self.dim, self.seed).T).astype(np.float32)
            for i, guess in enumerate(turned @ self.signs.T, lo):
                yield i, guess * self.scale, tops[i], lengths[i]


def best(codes: Codes, queries: np.ndarray, query_ids: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places of its best estimates, and these, without the query itself."""
    with np.errstate(over="ignore", invalid="ignore"):
        for i, guess, _, _ in codes.estimates(queries):
            guess = guess * codes.tops
            guess[codes.ids == query_ids[i]] = -np.inf
            top = np.argpartition(-guess, count)[:count] if len(guess) > count else np.arange(len(guess))
            yield i, top[codes.ids[top] != query_ids[i]], guess


def within_reach(codes: Codes, queries: np.ndarray, query_ids: np.ndarray, reach: np.ndarray, bound: float | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the places of all candidates that may attain its reach."""
    with np.errstate(over="ignore", invalid="ignore"):
        for i, guess, top, length in codes.estimates(queries) if bound is not None else ((i, None, 0.0, 0.0) for i in range(len(queries))):
            if guess is None:
                keep = np.ones(len(codes.ids), bool)
            else:
                # Where a product is no number, the candidate stays.
                keep = ~((guess + (bound * codes.error + codes.slack) * length) * (codes.tops * top) < reach[i])
            yield i, np.flatnonzero(keep & (codes.ids != query_ids[i]))


def pack_places(places: np.ndarray, count: int) -> tuple[bool, bytes]:
    """Ascending places below ``count``, as a bit for each or a list."""
    if len(places) * 4 <= count // 8:
        return False, places.astype("<u4").tobytes()
    bits = np.zeros(count, bool)
    bits[places] = True
    return True, np.packbits(bits).tobytes()


def unpack_places(dense: bool, data: pa.Buffer, count: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, "u1"), count=count)) if dense else np.frombuffer(data, "<u4").astype(np.int64)


def top_products(vectors: np.ndarray, ids: np.ndarray, lengths: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` nearest; only those near the k-th are summed in component order."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = vectors @ query
        if len(rough) > k:
            slack = 2.0**-50 * len(query) * lengths.max() * math.sqrt(float(query @ query))
            keep = np.flatnonzero(~(rough < np.partition(rough, -k)[-k] - 2 * slack))
        else:
            keep = np.arange(len(rough))
    score = products(vectors[keep], query)
    top = np.lexsort((ids[keep], -score))[:k]
    return keep[top], score[top]


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed in component order."""
    out = np.zeros(len(vectors))
    with np.errstate(over="ignore", invalid="ignore"):
        for column, q in zip(np.ascontiguousarray(vectors.T), query):
            out += column * q
    return out


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending and once each, and their vectors."""
    ids = table["vec_id"].to_numpy()
    vectors = pc.list_flatten(table["v"].combine_chunks()).to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = ids[1:] != ids[:-1]
    return ids[keep], np.ascontiguousarray(vectors[keep])


_BLOCK = "dim int, block int, part int, ids binary, vectors binary, codes binary, tops binary, norms binary, fits binary"
_QUERIES = "dim int, q_block int, q_ids binary, q_vectors binary, reach binary"
_ASKED = "dim int, block int, query_id bigint, q binary, dense boolean, places binary"
_SCORES = "query_id bigint, vec_id bigint, score double"


def _pack_vectors(parts: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, vectors = _matrix(table)
        raw = (ids.astype("<i8"), vectors, *encode(vectors.astype(np.float64)))
        dim, block = key[0].as_py(), key[1].as_py()
        return pa.table([[dim], [block], [block % parts], *([x.tobytes()] for x in raw)], schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), *((n, pa.binary()) for n in ("ids", "vectors", "codes", "tops", "norms", "fits"))]))

    return run


def _pack_queries(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ids, vectors = _matrix(table)
    known = dict(zip(table["vec_id"].to_pylist(), table["reach"].to_pylist()))
    raw = ids.astype("<i8"), vectors.astype("<f8"), np.array([known[i] for i in ids.tolist()], "<f8")
    return pa.table([[key[0].as_py()], [key[1].as_py()], *([x.tobytes()] for x in raw)], schema=pa.schema([("dim", pa.int32()), ("q_block", pa.int32()), *((n, pa.binary()) for n in ("q_ids", "q_vectors", "reach"))]))


def _ask(first: int | None, bound: float | None):
    """Of codes and queries that meet, the rows (block, query, candidates): the ``first`` best estimates, or all within reach."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            raw = lambda t, n, i, kind="<f8": np.frombuffer(t[n][i].as_buffer(), kind)
            q_ids, queries, reach = raw(right, "q_ids", 0, "<i8"), raw(right, "q_vectors", 0).reshape(-1, dim), raw(right, "reach", 0)
            tops: list[list[tuple]] = [[] for _ in q_ids]
            for b in range(left.num_rows):
                ids, block = raw(left, "ids", b, "<i8"), left["block"][b].as_py()
                codes = Codes(dim, ids, raw(left, "codes", b, "u1").reshape(len(ids), -1), raw(left, "tops", b), raw(left, "norms", b), raw(left, "fits", b))
                if first is None:
                    rows += [(dim, block, int(q_ids[i]), queries[i].tobytes(), *pack_places(c, len(ids))) for i, c in within_reach(codes, queries, q_ids, reach, bound) if len(c)]
                else:
                    for i, c, guess in best(codes, queries, q_ids, first):
                        tops[i] += zip((-guess[c]).tolist(), c.tolist(), [block] * len(c))
                        if len(tops[i]) > 4 * first:
                            tops[i] = sorted(tops[i])[:first]
            for i, found in enumerate(tops):
                by_block: dict[int, list[int]] = {}
                for _, place, block in sorted(found)[:first]:
                    by_block.setdefault(block, []).append(place)
                rows += [(dim, block, int(q_ids[i]), queries[i].tobytes(), False, np.array(sorted(places), "<u4").tobytes()) for block, places in by_block.items()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["dim", "block", "query_id", "q", "dense", "places"])

    return run


def _score(kind: str, k: int):
    """The ``k`` nearest of each query's candidates in a block of vectors."""

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if asked.num_rows and block.num_rows:
            ids = np.frombuffer(block["ids"][0].as_buffer(), "<i8")
            vectors = np.frombuffer(block["vectors"][0].as_buffer(), kind).reshape(len(ids), -1).astype(np.float64)
            lengths = np.multiply(*(np.frombuffer(block[c][0].as_buffer(), "<f8") for c in ("tops", "norms")))
            for query_id, q, dense, wanted in zip(asked["query_id"].to_pylist(), asked["q"], asked["dense"].to_pylist(), asked["places"]):
                place = unpack_places(dense, wanted.as_buffer(), len(ids))
                top, score = top_products(vectors[place], ids[place], lengths[place], np.frombuffer(q.as_buffer(), "<f8"), k)
                for column, value in zip(out, (np.full(len(top), query_id), ids[place][top], score)):
                    column.append(value)
        return pa.table([np.concatenate(c) for c in out], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = K, bound: float | None = BOUND) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's nearest among all other rows."""
    spark = vectors.sparkSession
    narrow = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind, item, number = ("<f4", 4, "float") if narrow else ("<f8", 8, "double")
    usable = f"vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < {number}('infinity')) and exists(v, x -> x != 0)"
    clean = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("v")).filter(usable).withColumn("dim", F.size("v"))
    asks, size = is_query(F.col("vec_id")), F.col("dim").cast("bigint")
    total, code_bytes, asked, asked_bytes = clean.agg(F.sum(size * item), F.sum(size / 8 + _SCALARS), F.count_if(asks), F.sum(F.when(asks, size * 8))).first()
    # Small tables still give every task a share, in blocks and in pairs of blocks.
    tasks = partitions_of(spark)
    blocks = max(math.ceil((total or 0) / VECTOR_BYTES), min(tasks, math.ceil((total or 0) / (VECTOR_BYTES >> 6))), 1)
    parts = min(blocks, max(1, math.ceil((code_bytes or 0) / CODE_BYTES)))
    q_blocks = max(1, math.ceil((asked_bytes or 0) / QUERY_BYTES), min(asked, math.ceil(2 * tasks / parts)))
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    packed = clean.withColumn("block", at(blocks)).groupBy("dim", "block").applyInArrow(_pack_vectors(parts), _BLOCK)
    packed.write.mode("overwrite").parquet(path := shared_path(spark, "vectors"))
    packed = spark.read.parquet(path)
    # Numbered partitions stay as many, however little data they hold.
    pairs = parts * q_blocks
    copies = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    codes = packed.select("dim", "block", "part", "ids", "codes", "tops", "norms", "fits", copies("q_block", q_blocks)).repartition(pairs, "dim", "part", "q_block").groupBy("dim", "part", "q_block")
    rows = clean.filter(asks).select("dim", at(q_blocks).alias("q_block"), "vec_id", "v")

    def ask(queries: DataFrame, first: int | None) -> DataFrame:
        met = queries.groupBy("dim", "q_block").applyInArrow(_pack_queries, _QUERIES).select("*", copies("part", parts)).repartition(pairs, "dim", "part", "q_block")
        return codes.cogroup(met.groupBy("dim", "part", "q_block")).applyInArrow(_ask(first, bound), _ASKED)

    def score(wanted: DataFrame) -> DataFrame:
        held = packed.select("dim", "block", "ids", "vectors", "tops", "norms").repartition(blocks, "dim", "block").groupBy("dim", "block")
        return wanted.repartition(blocks, "dim", "block").groupBy("dim", "block").cogroup(held).applyInArrow(_score(kind, k), _SCORES)

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    none = F.lit(float("-inf"))
    if bound is None:
        reached = rows.withColumn("reach", none)
    else:
        sample = score(ask(rows.withColumn("reach", none), max(8, math.ceil(max(_FIRST, 2 * k) / parts))))
        reach = sample.select("query_id", "score", rank.alias("rank")).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reach"))
        reached = rows.join(reach, "vec_id", "left").withColumn("reach", F.coalesce("reach", none))
    return score(ask(reached, None)).select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
