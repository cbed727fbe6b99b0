import math

import numpy as np
import pytest

from helixframe.llm import vector_search as V
from helixframe.llm.queries import op9_vector_search

from .conftest import SF


def brute(rows, step, k):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        vectors[i] = min(vectors.get(i, v), v)
    out = {}
    for q, a in vectors.items():
        if q % step == 0:
            near = [(-float(np.dot(np.float64(a), np.float64(b))), i) for i, b in vectors.items() if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def test_query_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20)
    got = {}
    for r in op9_vector_search(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 21))
        hits += len({n[1] for n in near} & {w[0] for w in want[q]})
        known = dict(rows)
        assert all(math.isclose(s, float(np.dot(np.float64(known[q]), np.float64(known[i]))), rel_tol=1e-12, abs_tol=1e-12) for _, i, s in near)
    assert hits >= 0.99 * 20 * len(want)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100, None), (120, []), (140, [0.0] * 8), (160, [1.0] + [None] * 7), (180, [float("nan")] * 8), (200, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (220, [1.0, 2.0]), (221, [2.0, 1.0]), (240, [1.0, 2.0, 3.0]), rows[40], rows[3], (300, rows[5][1]), (301, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<double>, block string, dim string").repartition(3)
    got = {}
    for r in V.nearest(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {q: w for q, w in brute(rows, 20, 20).items() if w}
    assert set(got) == set(want)
    for q, near in got.items():
        assert [n[1] for n in sorted(near)] == [w[0] for w in want[q]]
    assert V.nearest(df.filter("false"), lambda i: i % 20 == 0).count() == 0


def test_estimates_lie_within_the_bound():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=64)
    codes, tops, norms, fits = V.encode(x)
    assert codes.shape == (2000, 8) and np.allclose(tops * norms, np.linalg.norm(x, axis=1))
    known = V.Codes(64, np.arange(2000), codes, tops, norms, fits)
    ((_, guess, top, length),) = known.estimates(q[None, :])
    assert math.isclose(top * length, np.linalg.norm(q))
    off = np.abs(guess * tops * top - x @ q)
    assert (off <= V.BOUND * known.error * length * tops * top).mean() > 0.99 and abs((guess * tops * top - x @ q).mean()) < 0.5
    assert np.allclose(V.rotation(64) @ V.rotation(64).T, np.eye(64))


def ranked(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(near)] for q, near in got.items()}


def in_order(rows, step, k):
    """As ``brute``, with sums in component order."""
    known, out = {i: v for i, v in rows if v is not None}, {}
    for q, a in known.items():
        if q % step == 0:
            near = []
            for i, b in known.items():
                if i != q:
                    total = 0.0
                    for x, y in zip(b, a):
                        total += x * y
                    near.append((-total, i))
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


@pytest.mark.parametrize("size", [1e20, 1e-170, 1e150, 1.0])
def test_extreme_magnitudes(spark, size):
    """Any finite vector but zero takes part; products that leave a double's range are zero or infinite for all, and ties go to the smaller id."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * size).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert ranked(V.nearest(df, lambda i: i % 20 == 0)) == in_order(rows, 20, 20)


def test_mixed_magnitudes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=16) * 10.0 ** (i % 60 - 30)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert ranked(V.nearest(df, lambda i: i % 20 == 0)) == in_order(rows, 20, 20)


def test_the_exact_way_scores_every_candidate(spark, monkeypatch):
    monkeypatch.setattr(V, "VECTOR_BYTES", 64 * 50 * 8)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert ranked(V.nearest(df, lambda i: i % 20 == 0, bound=None)) == in_order(rows, 20, 20)
    assert V.nearest(df, lambda i: i < 0, bound=None).count() == V.nearest(df, lambda i: i < 0).count() == 0


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "VECTOR_BYTES", 100 * 16 * 4)
    monkeypatch.setattr(V, "CODE_BYTES", 100 * (16 // 8 + 32))
    monkeypatch.setattr(V, "QUERY_BYTES", 10 * 16 * 8)
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(size=16)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want, hits = brute(rows, 20, 20), 0
    for r in V.nearest(df, lambda i: i % 20 == 0).collect():
        hits += r.vec_id in {w[0] for w in want[r.query_id]}
    assert hits >= 0.98 * 20 * len(want)
