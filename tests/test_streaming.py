"""Live views equal batch results."""

import json
import time

from helixframe.operators import reads as R
from helixframe.streaming import telemetry as L


def test_stream_equals_batch(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.fastq").write_bytes(b"".join(b"@r%d\nACGTNNG\n+\nIIIIIII\n" % i for i in range(10 * f + 5)))
    s = L.Session(spark, str(tmp_path), name="t1").start(once=True)
    s.query.awaitTermination(120)
    row = s.table("scalars").first()
    assert (row.read_count, row.total, row.gc, row["at"], row.n, row.violations) == (45, 315, 135, 90, 90, 0)
    assert {(x.bin, x.reads) for x in s.table("gc").collect()} == {(42, 45)}
    assert {(x.bin, x.reads) for x in s.table("lengths").collect()} == {(7, 45)}
    assert s.table("heatmap").count() == 7
    assert s.status() == L.DONE
    s.cancel()
    assert s.status() == L.IDLE


def test_parquet_stream_parameters_and_reset(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "ACGT", "IIII" if i % 4 else "!!!!") for i in range(20)], "id string, seq string, qual string")
    rows.write.parquet(str(tmp_path / "in"))
    s = L.Session(spark, str(tmp_path / "in"), kind="parquet", name="t2").start(once=True)
    s.query.awaitTermination(120)
    assert s.table("scalars").first().read_count == R.basic_stats(rows).first().total_reads == 20
    s.reset()
    assert s.status() == L.IDLE and not spark.catalog.tableExists("t2")
    s.set_params(trim_front=1, min_quality=20.0).start(once=True)
    s.query.awaitTermination(120)
    found = s.table("scalars").first()
    assert (found.read_count, found.total) == (15, 45)
    deadline = time.time() + 30
    while not list(s.progress_lines()) and time.time() < deadline:
        time.sleep(0.1)
    assert json.loads(list(s.progress_lines())[-1]) == {"rows_processed": 20}
    s.reset()


def test_progress_counts_batches_that_the_stream_forgot(spark, tmp_path):
    keep = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for f in range(40):
            (tmp_path / f"{f}.fastq").write_bytes(b"@r\nACGT\n+\nIIII\n")
        s = L.Session(spark, str(tmp_path), name="t3").start(once=True)
        s.query.awaitTermination(120)
        deadline = time.time() + 30
        while (not (x := list(s.progress_lines())) or json.loads(x[-1])["rows_processed"] < 40) and time.time() < deadline:
            time.sleep(0.1)
        assert json.loads(list(s.progress_lines())[-1])["rows_processed"] == 40 and len(s.query.recentProgress) <= 2
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", keep)


def test_windowed_events(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert L.windowed_events(events).agg({"events": "sum"}).first()[0] == events.filter("ts is not null").count()
