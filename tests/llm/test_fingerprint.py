import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from helixframe.llm import fingerprint as P
from helixframe.llm.queries import op3_fingerprint

from .conftest import SF


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_query(spark, table):
    rows = sorted(table[1])
    got = {r.doc_id: r for r in op3_fingerprint(spark, SF).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        errors.append(abs(r.near_edited - len(a & b) / max(1, len(a | b))))
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)
    assert sum(errors) / len(errors) < 0.08
    same = {}
    for i, text in rows:
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint


def brute_sketch(text):
    """The fingerprint by a hash library of its own: Spark chains the words, each hash seeding the next."""
    hashes = set()
    for words in shingles(text):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        hashes.add(h - (1 << 64) if h >> 63 else h)
    limit = -(1 << 63) + (1 << 64) // P.SCALE
    return {h for h in hashes if h < limit} or ({min(hashes)} if hashes else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_equals_brute_force(spark, table):
    rows = sorted(table[1])
    got = {r.doc_id: r for r in op3_fingerprint(spark, SF).collect()}
    shown = lambda hashes: ",".join("%X" % (h & (1 << 64) - 1) for h in sorted(hashes))
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half, r = len(text) // 2, got[i]
        own, edited, following = brute_sketch(text), brute_sketch(text[: len(text) - half] + after[:half]), brute_sketch(after)
        assert r.fingerprint == shown(own) and r.edited_fingerprint == shown(edited)
        assert (r.near_edited, r.near_next) == (alike(own, edited), alike(own, following))


def test_a_merged_sketch_is_the_sketch_of_both(spark):
    """Also where one or both texts retain a hash above the limit."""
    texts = [" ".join(f"w{a}x{i}" for i in range(n)) for a in range(40) for n in (3, 5, 6, 30)] + [""]
    rows = [(a, b) for a in texts[:24] for b in texts[-24:]]
    df = spark.createDataFrame(rows, "a string, b string")
    both = F.array_union(P.shingle_hashes(F.col("a")), P.shingle_hashes(F.col("b")))
    want = F.array_sort(P._retained(both, P.SCALE))
    got = df.select(P.merge(P.sketch(F.col("a")), P.sketch(F.col("b"))).alias("m"), want.alias("w"))
    assert got.filter("m != w").count() == 0 and got.count() == len(rows)


def test_plans_stay_small_with_many_partitions(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        plan = P.compare_edited(docs)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(plan) < 200_000


def test_only_built_in_functions(spark):
    plan = op3_fingerprint(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|BatchEval|MapPartitions", plan)


def test_awkward_rows(docs, no_docs, rows):
    got = P.compare_edited(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = {}
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        want.setdefault(r[0], set()).add(hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    for r in got:
        assert r.edited_sha256 in want[r.doc_id] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {r.fingerprint for r in got if r.doc_id in (0, 3, 6)} == {""}
    assert P.compare_edited(no_docs).count() == 0


def test_single_document_follows_itself(spark):
    r = P.compare_edited(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id bigint, text string")).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c d a b c d"[:8] + b"a b c d").hexdigest()


def test_threshold_merge_and_containment(spark):
    whole = " ".join(f"w{i}" for i in range(4000))
    part = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(whole, part)], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"), P.shingle_hashes(F.col("a")).alias("all"))
    row = df.select("*", P.containment(F.col("b"), F.col("a")).alias("inside"), P.likeness(F.col("a"), F.col("b")).alias("like"), P.merge(F.col("a"), F.col("b")).alias("m")).first()
    limit = -(1 << 63) + (1 << 64) // P.SCALE
    assert row.a == sorted({h for h in row["all"] if h < limit}) and row.m == row.a
    assert row.inside == 1.0 and abs(row.like - 0.1) < 0.04
