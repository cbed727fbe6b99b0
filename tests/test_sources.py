"""FASTQ and BAM reading: formats, splits, modes and round trips."""

import gzip
import io
import os
import struct
import time
import uuid

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe import api
from helixframe.__main__ import main
from helixframe.operators import alignments as A
from helixframe.operators import reads as R
from helixframe.plans.report import alignment_report, read_report
from helixframe.sources import fastq, generate, parsing
from helixframe.sources.bam import bam_records, read_bam, simulate_alignments, write_bam


def text(n, k=0):
    rows = [(f"r{i} x", "ACGT" * (i % 5 + 1), ("@" if i % 3 == 0 else "+") + "I" * (4 * (i % 5 + 1) - 1)) for i in range(k, k + n)]
    return rows, "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in rows).encode()


@pytest.mark.parametrize("kind", ["plain", "gzip", "bgzf"])
@pytest.mark.parametrize("split", ["100", "1000", "100000"])
def test_formats_and_splits(spark, tmp_path, kind, split):
    rows, raw = text(300)
    path = tmp_path / "a.fastq"
    path.write_bytes({"plain": raw, "gzip": gzip.compress(raw), "bgzf": parsing.bgzf_compress(raw, 700)}[kind])
    got = fastq.read_fastq(spark, str(path), splitBytes=split)
    assert sorted((r.id, r.seq, r.qual) for r in got.collect()) == sorted(rows)


def test_ranges_own_each_record_once(tmp_path):
    rows, raw = text(50)
    path = tmp_path / "a.fastq"
    path.write_bytes(raw)
    for step in (1, 7, 33, 64, 129):
        got = []
        for b in range(0, len(raw), step):
            end = b + step if b + step < len(raw) else None
            got += [r[:3] for r in fastq.range_records(fastq.Range(str(path), b, end, "none"))]
        assert got == rows


def test_a_long_line_over_many_chunks():
    line = b"A" * 100_000
    pieces = [(b"@x\n" + line + b"\n+\n" + line)[i : i + 97] for i in range(0, 200_010, 97)]
    assert [x for _, x in parsing.lines(pieces)] == [b"@x", line, b"+", line]


def test_bgzf_blocks_are_inflated_once(tmp_path, monkeypatch):
    rows, raw = text(2000)
    path = tmp_path / "a.fastq.gz"
    path.write_bytes(parsing.bgzf_compress(raw, 4000))
    size, seen, blocks = path.stat().st_size, [], parsing.bgzf_blocks

    def counted(*args):
        for at, data in blocks(*args):
            seen.append(at)
            yield at, data

    monkeypatch.setattr(parsing, "bgzf_blocks", counted)
    got = []
    for b in range(0, size, 1500):
        got += [r[:3] for r in fastq.range_records(fastq.Range(str(path), b, b + 1500 if b + 1500 < size else None, "bgzf"))]
    assert got == rows
    # A range may look one or two blocks ahead for its last record, no more.
    assert len(seen) <= 3 * len(set(seen))


def test_columns_and_crlf(spark, tmp_path):
    _, raw = text(5)
    (tmp_path / "a.fq").write_bytes(raw.replace(b"\n", b"\r\n").rstrip())
    got = fastq.read_fastq(spark, str(tmp_path), columns="seq")
    assert got.columns == ["seq"] and got.count() == 5
    with pytest.raises(Exception, match="unknown columns"):
        fastq.read_fastq(spark, str(tmp_path), columns="nope").count()


BAD = b"@READ1\nACGT\n+\nIII\n@READ2\nAC\n+\nIIII\njunk\n@READ4\nACGT\n-\nIIII\n@READ5\n"


def test_modes(spark, tmp_path):
    (tmp_path / "bad.fq").write_bytes(BAD)
    path = str(tmp_path / "bad.fq")
    assert fastq.read_fastq(spark, path).count() == 3
    errors = {r.id: r._error for r in fastq.read_fastq(spark, path, mode="PERMISSIVE").collect()}
    assert errors == {"READ1": "MismatchedSequenceQuality", "READ2": "MismatchedSequenceQuality", "READ4": "InvalidFormat", "READ5": "IncompleteRecord"}
    assert fastq.read_fastq(spark, path, mode="DROPMALFORMED").count() == 0
    with pytest.raises(Exception, match="MismatchedSequenceQuality"):
        fastq.read_fastq(spark, path, mode="FAILFAST").count()


@pytest.mark.parametrize("kind", ["none", "bgzf"])
@pytest.mark.parametrize("first", ["I", "@"])
def test_ranges_keep_broken_records(tmp_path, kind, first):
    """Broken records and junk at the cuts are found as in one range, also where every quality looks like an id."""
    raw = b"".join(b"@r%d\nACGTA\n%s\n%sIIII%s\n%s" % (i, b"+-"[i % 2 : i % 2 + 1], first.encode(), b"I" * (i % 3 == 0), b"junk\n" * (i % 7 == 0)) for i in range(60))
    path = tmp_path / "a.fastq"
    path.write_bytes(parsing.bgzf_compress(raw, 90) if kind == "bgzf" else raw)
    size = path.stat().st_size
    whole = list(fastq.range_records(fastq.Range(str(path), 0, None, kind)))
    assert [r[0] for r in whole] == [f"r{i}" for i in range(60)] and sum(r[3] is None for r in whole) == 20
    for step in (11, 40, 97, 300):
        got = []
        for b in range(0, size, step):
            got += fastq.range_records(fastq.Range(str(path), b, b + step if b + step < size else None, kind))
        assert got == whole


def test_gzip_records_come_in_batches():
    """Records are cut in arrays of a chunk, not one by one, wherever chunks end."""
    rows, raw = text(5000)
    packed = gzip.compress(raw)
    found = list(parsing.batches(parsing.gunzip(packed[i : i + 1000] for i in range(0, len(packed), 1000)), columns=("id", "seq", "qual")))
    assert len(found) < 5 and [tuple(r.values()) for b in found for r in b.to_pylist()] == rows


def test_bomb_and_damage(tmp_path):
    import io

    zeros = parsing.bgzf_compress(b"A" * 60_000)
    assert sum(len(d) for _, d in parsing.bgzf_blocks(io.BytesIO(zeros))) == 60_000
    with pytest.raises(parsing.FormatError, match="DecompressionBomb"):
        list(parsing.bgzf_blocks(io.BytesIO(zeros), max_ratio=32))
    with pytest.raises(parsing.FormatError, match="StreamError"):
        list(parsing.bgzf_blocks(io.BytesIO(zeros[:-40])))


def test_split_record_over_blocks(spark, tmp_path):
    raw = b"".join(b"@r%d\n%s\n+\n%s\n" % (i, b"ATGC" * 4, b"I" * 16) for i in range(1000))
    (tmp_path / "s.fastq.gz").write_bytes(parsing.bgzf_compress(raw, len(raw) // 2 + 3))
    assert api.qc(str(tmp_path / "s.fastq.gz"))["read_count"] == 1000


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_parser_never_crashes(data):
    list(parsing.records(parsing.lines([data]), incomplete=True))
    list(parsing.records(parsing.lines([data[:50], data[50:]]), resync=True))


def bam(records):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 4) + b"chr\0" + struct.pack("<i", 1000)
    out = []
    for flag, pos, mapq, cigar, seq, tlen in records:
        packed = bytes(("=ACMGRSVTWYHKDBN".index(seq[i]) << 4) | ("=ACMGRSVTWYHKDBN".index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(c)) for n, c in cigar)
        body = struct.pack("<iiBBHHHiiii", 0, pos, 2, mapq, 0, len(cigar), flag, len(seq), -1, -1, tlen) + b"r\0" + ops + packed + bytes([40] * len(seq))
        out.append(struct.pack("<i", len(body)) + body)
    return head + b"".join(out)


def test_bam(spark, tmp_path):
    raw = bam([(99, 5, 60, [(4, "M"), (1, "S")], "ACGTN", 200), (0, 9, 0, [(3, "M")], "GGG", 0)])
    assert [r[4:6] for r in bam_records(raw)] == [("4M1S", "ACGTN"), ("3M", "GGG")]
    (tmp_path / "a.bam").write_bytes(parsing.bgzf_compress(raw))
    got = read_bam(spark, str(tmp_path / "a.bam")).orderBy("position").collect()
    assert (got[0].quality, got[0].flag, got[0].template_length) == ("IIIII", 99, 200)
    assert api.bamstats(str(tmp_path / "a.bam"), 100)["stages"]["alignment_stats"]["mapped_reads"] == 1


def test_bam_splits_own_each_record_once(tmp_path, spark):
    letters = "ACGT"
    made = [(i % 4096, i, i % 61, [(i % 50 + 1, "M"), (i % 3 + 1, "S")], "".join(letters[(i * j) % 4] for j in range(i % 50 + i % 3 + 2)), i % 900) for i in range(3000)]
    path = tmp_path / "a.bam"
    path.write_bytes(parsing.bgzf_compress(bam(made), 3000))
    whole = read_bam(spark, str(path)).collect()
    assert sorted(r.position for r in whole) == list(range(3000))
    for split in ("2000", "7001", "30000"):
        got = read_bam(spark, str(path), splitBytes=split)
        assert got.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole))


def test_bam_round_trip_and_damage(tmp_path, spark):
    made = simulate_alignments(spark, 500)
    write_bam(made, str(tmp_path / "out"), 24)
    got = read_bam(spark, str(tmp_path / "out"))
    assert got.count() == 500 and got.exceptAll(made).count() == 0
    assert read_bam(spark, str(tmp_path / "out"), columns="cigar").columns == ["cigar"]
    with pytest.raises(parsing.FormatError, match="InvalidFormat"):
        list(bam_records(b"nothing"))
    with pytest.raises(parsing.FormatError, match="IncompleteRecord"):
        list(bam_records(bam([(0, 9, 0, [(3, "M")], "GGG", 0)])[:-2]))


def scans(spark, tmp_path, schema, rows, report):
    """How often a report reads each partition of its input."""
    marks = str(tmp_path / "marks")
    os.makedirs(marks)

    def run(batches):
        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    source = rows.repartition(2).mapInArrow(run, schema)
    found = report(source)
    return found, len(os.listdir(marks)) / 2


def test_reports_scan_once(spark, tmp_path):
    reads = generate.mixed(spark, 300)
    found, n = scans(spark, tmp_path, reads.schema, reads, read_report)
    assert n == 1
    assert found["basic_stats"] == R.basic_stats(reads).first().asDict() and found["n_statistics"] == R.n_statistics(reads).first().asDict()
    assert found["nucleotide_composition"] == R.nucleotide_composition(reads).first().asDict()
    assert {i: x for i, x in enumerate(found["gc_distribution"]["bins"]) if x} == {r.bin: r.reads for r in R.gc_distribution(reads).collect()}
    assert {i: x for i, x in enumerate(found["length_distribution"]["bins"]) if x} == {r.bin: r.reads for r in R.length_distribution(reads).collect()}
    data = found["quality_dist"]["data"]
    assert {(i, j): x for i, row in enumerate(data) for j, x in enumerate(row) if x} == {(r.pos, r.phred): r.reads for r in R.quality_dist(reads).collect()}


def test_alignment_report_scans_once(spark, tmp_path):
    records = simulate_alignments(spark, 700)
    found, n = scans(spark, tmp_path, records.schema, records, lambda r: alignment_report(r, 1000)["stages"])
    assert n == 1
    assert found["alignment_stats"] == A.alignment_stats(records).first().asDict() and found["coverage"] == A.coverage(records, 1000).first().asDict()
    assert found["error_rate_stats"] == A.error_rate(records).first().asDict() and found["soft_clipping"] == A.soft_clipping(records).first().asDict()
    insert = dict(found["insert_size"])
    bins = insert.pop("histogram_500bp_bins")
    assert insert == A.insert_size(records).first().asDict() and {i: x for i, x in enumerate(bins) if x} == {r.bin: r.pairs for r in A.insert_size_hist(records).collect()}


def test_a_run_can_be_cancelled(spark):
    def slow(batches):
        import time

        for b in batches:
            time.sleep(60)
            yield b

    run = api.Run(lambda: {"read_count": spark.range(10).mapInArrow(slow, "id long").count()})
    began = time.time()
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() - began < 30:
        time.sleep(0.1)
    run.cancel()
    with pytest.raises(Exception, match="cancel"):
        run.result(30)
    assert time.time() - began < 50
    assert api.Run(lambda: {"read_count": 1}).result(30) == {"read_count": 1}


def test_api_and_cli(spark, tmp_path, capsys):
    (tmp_path / "one.fastq").write_bytes(b"@READ_1\nACGT\n+\nIIII\n")
    path = str(tmp_path / "one.fastq")
    for approx in (False, True):
        found = api.qc(path, approx=approx)
        assert found["read_count"] == 1 and found["gc_distribution"]["bins"][50] == 1
        assert found["quality_dist"]["data"][0][40] == 1 and found["length_distribution"]["bins"] == [0, 0, 0, 0, 1]
    (tmp_path / "c.json").write_text('{"pipeline": ["trim", "filter", "qc", "duplication"], "trim_front": 1, "min_quality": 10}')
    assert api.pipeline(str(tmp_path / "c.json"), path)["qc"]["total_bases"] == 3
    for args in ([path], ["qc", path, "--ndjson"], ["entropy", path, "--text", "--perf"], ["n50", path], ["adapter-detect", path], ["run", str(tmp_path / "c.json"), path]):
        assert main(args) == 0
        assert capsys.readouterr().out


def written_early(spark, monkeypatch, write, row):
    """How many of 200 batches a writer takes in before it gives its first bytes, and all that it gives."""
    taken, kept = [], []
    monkeypatch.setattr(parsing, "write_parts", lambda rows, path, encode, suffix: kept.append((rows, encode)))
    write()
    rows, encode = kept[0]
    batch = pa.RecordBatch.from_pylist([row(rows)] * 500)

    def feed():
        for i in range(200):
            taken.append(i)
            yield batch

    pieces = iter(encode(feed()))
    data = [next(pieces)]
    return len(taken), b"".join([*data, *pieces])


def test_bgzf_is_written_as_it_comes(spark, monkeypatch):
    reads = spark.createDataFrame([("a", "ACGT" * 20, "I" * 80)], "id string, seq string, qual string")
    n, data = written_early(spark, monkeypatch, lambda: fastq.write_fastq(reads, "x", "bgzf"), lambda rows: rows.first().asDict())
    assert n < 5
    text = b"".join(d for _, d in parsing.bgzf_blocks(io.BytesIO(data)))
    assert text == b"@a\n" + b"ACGT" * 20 + b"\n+\n" + b"I" * 80 + b"\n" + text[167:] and text.count(b"@a\n") == 100_000 and len(text) == 100_000 * 167


def test_bam_is_written_as_it_comes(spark, monkeypatch):
    made = simulate_alignments(spark, 1).select("flag", "reference_id", "position", "mapping_quality", "cigar", "template_length")
    n, data = written_early(spark, monkeypatch, lambda: write_bam(made, "x", 24), lambda rows: rows.first().asDict())
    assert n < 20
    got = list(bam_records(b"".join(d for _, d in parsing.bgzf_blocks(io.BytesIO(data)))))
    assert len(got) == 100_000 and set(got) == {tuple(made.selectExpr("flag", "reference_id", "position", "mapping_quality", "cigar", "''", "''", "template_length").first())}


def test_write_and_generate(spark, tmp_path):
    made = generate.mixed(spark, 200)
    assert made.filter("length(seq) != length(qual)").count() == 0
    fastq.write_fastq(made, str(tmp_path / "out"), "gzip")
    back = fastq.read_fastq(spark, str(tmp_path / "out"))
    assert back.count() == 200 and back.exceptAll(made).count() == 0
    assert generate.constant_quality(spark, 10).filter("length(seq) = 16").count() == 10
