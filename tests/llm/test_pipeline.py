"""Each stage on its own input, against brute force, and the whole of it."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from helixframe.llm import secret_scan
from helixframe.llm.common import smaller_batches

from .conftest import SF
from .test_ngram_join import brute as classes
from .test_packing import check
from .test_suffix_dedup import brute as removed


def test_stages(spark, table, tmp_path):
    docs = table[0]
    for n, (name, stage) in enumerate(P.STAGES):
        got = stage(spark, docs, SF)
        before = docs.collect()
        if n < 4:
            assert got.columns == table[0].columns
        got.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        after = got.collect()
        rows = [(r.doc_id, r.text) for r in before]
        if name == "language_id":
            assert {r.doc_id for r in after} == {i for i, t in rows if t and any(c.isalpha() for c in t)}
        elif name == "ngram_join":
            assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in classes(rows)})
        elif name == "suffix_dedup":
            gone = {i: r for i, _, r, _, _ in removed(rows)}
            known = dict(rows)
            assert len(after) == len(rows)
            for r in after:
                assert (r.text == known[r.doc_id]) == (gone[r.doc_id] == 0) and r.n_chars == len(r.text)
        elif name == "secret_scan":
            known = dict(rows)
            assert all(r.text == secret_scan.redact(known[r.doc_id], secret_scan.scan(known[r.doc_id])) for r in after)
        else:
            check(after, rows)
        docs = got
    assert [n for n, _ in P.STAGES] == ["language_id", "ngram_join", "suffix_dedup", "secret_scan", "packing"]


def test_run_equals_the_stages(spark, table):
    docs = table[0]
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    # Which pieces meet depends on how rows are stored; what is packed does not.
    whole = lambda df: sorted({(r.doc_id, r.doc_tokens, r.n) for r in df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()})
    got = P.run(spark, SF)
    assert whole(got) == whole(docs)
    check(got.collect(), [(i, None) for i, _, _ in whole(docs)], repeats=True)


def test_awkward_rows(spark, docs, no_docs):
    for table in (docs, no_docs):
        for name, stage in P.STAGES[:-1]:
            got = stage(spark, table, SF)
            assert got.columns == docs.columns, name
            got.count()
        P.STAGES[-1][1](spark, table, SF).count()


def test_small_batches_leave_the_session_as_it_was(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    with smaller_batches(spark, 7, 1 << 20):
        assert [spark.conf.get(n).removesuffix("b") for n in names] == ["7", str(1 << 20)]
    assert [spark.conf.get(n) for n in names] == before


def test_stages_collect_the_heaps_first(spark, no_docs):
    """A local session's executor is the driver's JVM; else its heap stays as large as the stages before made it."""

    def full() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))

    for name, stage in P.STAGES:
        before = full()
        stage(spark, no_docs, SF)
        assert full() > before, name
