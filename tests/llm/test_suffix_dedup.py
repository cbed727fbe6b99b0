import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import blocks, byte_hash
from helixframe.llm import suffix_dedup as D
from helixframe.llm.queries import op6_suffix_dedup

from .conftest import SF, prose


def brute(rows, size=50):
    """(id, bytes removed, spans, kept) by a dictionary of every 50-byte string's smallest id."""
    low = lambda i: -1 if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            k = b[p : p + size]
            least[k] = min(least.get(k, low(i)), low(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if least[b[p : p + size]] < low(i):
                gone[p : p + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_query(spark, table):
    assert rows_of(op6_suffix_dedup(spark, SF)) == sorted(brute(table[1]), key=str)


@pytest.mark.parametrize("block", [2_000, 1 << 22])
def test_awkward_rows(docs, no_docs, rows, block):
    assert rows_of(D.digest(D.remove_repeats(docs, block))) == sorted(brute([r[:2] for r in rows]), key=str)
    assert D.remove_repeats(no_docs, block).count() == 0


def test_many_blocks_and_chunks(spark, table, monkeypatch):
    monkeypatch.setattr(D, "_CHUNK", 700)
    monkeypatch.setattr(D, "_RANKED", 5_000)
    part = table[0].filter("doc_id < 80")
    assert rows_of(D.digest(D.remove_repeats(part, 20_000))) == sorted(brute([r for r in table[1] if r[0] < 80]), key=str)


def test_rows_keep_their_columns(docs, rows):
    got = D.without_repeats(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes and got.count() == len(rows)
    assert got.filter("text is null").count() == 1 and got.filter("doc_id = 18").first().text == ""
    for r in got.collect():
        assert r.n_chars == (len(r.text) if r.text is not None else None)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=8), st.integers(1, 12))
def test_hashes_do_not_depend_on_the_place(parts, k):
    data = np.frombuffer(b"".join(parts), np.uint8)
    hashes = byte_hash.fixed(byte_hash.prefix(data), k)
    seen = {}
    for p, h in enumerate(hashes.tolist()):
        assert seen.setdefault(bytes(data[p : p + k]), h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("threshold", [2, 9, 31, 64, 200])
def test_other_thresholds(docs, rows, threshold):
    short = [(r[0], (r[1] or "")[:4000]) for r in rows]
    cut = docs.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, 4000))
    assert rows_of(D.digest(D.remove_repeats(cut, 9_000, threshold))) == sorted(brute(short, threshold), key=str)


def test_awkward_names(spark):
    rows = [(1, "a" * 80, 1, 2, 3, 4), (2, "b" + "a" * 79, 1, 2, 3, 4), (3, None, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __null int, `a.b` int, `c``d` int, row int")
    got = D.without_repeats(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a" * 80), (2, "b"), (3, None)]


def test_one_id_for_most_rows(spark):
    """Rows of one id, null or not, lie in many blocks, and never remove each other's bytes."""
    shared = prose(40, 30)
    rows = [(None, prose(300 + i, 40) + " " + shared) for i in range(40)] + [(7, prose(400 + i, 40) + " " + shared) for i in range(40)]
    rows += [(i, prose(500 + i, 40) + shared) for i in range(10)] + [rows[0], rows[0], (7, rows[0][1]), (None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    placed, count = blocks.blocked(docs, 3_000)
    held = placed.groupBy("doc_id").agg(F.count_distinct("block").alias("b"), F.count(F.lit(1)).alias("n"))
    assert count > 4 and all(r.b > 4 for r in held.filter("n > 20").collect())
    assert rows_of(D.digest(D.remove_repeats(docs, 3_000))) == sorted(brute(rows), key=str)
