import base64
import glob
import hashlib
import zlib
from collections import defaultdict

import pytest

from helixframe.llm import warc as A
from helixframe.llm.common import shared_path
from helixframe.llm.queries import op7_warc
from helixframe.sources import parsing

from .conftest import SF


def brute(rows, least=0):
    by = defaultdict(list)
    for i, h in rows:
        by[h or ""].append(i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        first = min((x for x in by[h or ""] if x is not None), default=None)
        again = len(raw) >= least and first is not None and i != first
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


PAGES = [(5, "u", "<p>x</p>"), (3, "v", "<p>x</p>"), (9, None, "<p>x</p>"), (1, "w\r\nX: y", None), (2, "w", ""), (7, "z", "a\r\n\r\nb WARC/1.1\r\n"), (8, "é", "ü" * 50), (3, "v", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "alone")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, salt string, d string").repartition(3)


def test_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert rows_of(op7_warc(spark, SF)) == brute(rows)


@pytest.mark.parametrize("least", [0, 1, 9])
def test_awkward_pages(spark, least):
    got = A.round_trip(pages(spark), least)
    assert rows_of(got) == brute([(i, h) for i, _, h in PAGES], least)
    for r in got.collect():
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert len(r.payload) == r.payload_bytes


def test_empty_table(spark):
    assert A.round_trip(pages(spark).filter("false")).count() == 0


def test_hot_payload(spark):
    many = spark.range(5000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, 'hot', cast(id as string)) as html")
    got = A.resolve(many)
    assert got.filter("record_type = 'revisit'").count() == 1666 and got.filter("refers_to != 0").count() == 0


def archives(path):
    return sorted(glob.glob(f"{path.removeprefix('file:')}/archives/*"))


def test_damage_is_noticed(spark):
    path = shared_path(spark, "warc-test")
    A.write_archives(A.resolve(pages(spark, PAGES[:1])), path, compressed=False)
    data = open(archives(path)[0], "rb").read()
    fields, _, payload = next(A.parse_records([data]))
    assert payload == b"<p>x</p>" and fields["WARC-Type"] == "response" and fields["WARC-Record-ID"] == "<urn:page:5>"
    with pytest.raises(ValueError, match="differ"):
        A._record(*next(A.parse_records([data.replace(b"<p>x", b"<p>y")])))
    for cut in (6, 60, len(data) - 5):
        with pytest.raises(ValueError):
            list(A.parse_records([data[:-cut]]))
    assert list(A.parse_records(data[i : i + 7] for i in range(0, len(data), 7))) == list(A.parse_records([data]))


@pytest.mark.parametrize("least", [0, 9])
def test_many_shared_digests_join_by_headers(spark, least):
    got = A.resolve(pages(spark), least, lookup_bytes=0)
    assert rows_of(got) == brute([(i, h) for i, _, h in PAGES], least)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # The exchanges of payloads are by page_id; those by digest carry none.
    for line in plan.splitlines():
        if "hashpartitioning(payload_digest" in line or "hashpartitioning(d#" in line:
            assert "html" not in line


def test_payloads_are_not_shuffled(spark):
    plan = A.resolve(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_files_and_members(spark):
    """Files are bounded by bytes, a member holds a record, and files that no task vouches for are not read."""
    path = shared_path(spark, "warc-files")
    rows = spark.range(300).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 400) as html").coalesce(1)
    A.write_archives(A.resolve(rows), path, file_bytes=3_000)
    files = archives(path)
    assert len(files) > 5
    data, members = open(files[0], "rb").read(), 0
    while data:
        inflater = zlib.decompressobj(31)
        assert len(list(A.parse_records([inflater.decompress(data)]))) == 1
        data, members = inflater.unused_data, members + 1
    assert members > 1
    with open(f"{path.removeprefix('file:')}/archives/left-over.warc.gz", "wb") as f:
        f.write(open(files[0], "rb").read())
    assert A.read_archives(spark, path).count() == 300


def test_chunks_may_end_anywhere_in_an_archive(spark):
    """Also within the first two bytes of a gzip member and within its trailer."""
    path = shared_path(spark, "warc-chunks")
    A.write_archives(A.resolve(pages(spark, PAGES[:3]).coalesce(1)), path)
    data = open(archives(path)[0], "rb").read()
    whole = list(A.parse_records(parsing.gunzip([data])))
    assert len(whole) == 3
    for i in range(1, len(data)):
        assert list(A.parse_records(parsing.gunzip([data[:i], data[i:]]))) == whole
    assert list(A.parse_records(parsing.gunzip(data[i : i + 1] for i in range(len(data))))) == whole
    with pytest.raises(parsing.FormatError, match="truncated"):
        list(parsing.gunzip([data, b"\x1f"]))
