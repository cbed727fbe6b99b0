"""Golden values of the read stages."""

import math

import pytest

from helixframe.operators import reads as R
from helixframe.operators import sketches as S
from helixframe.operators import transforms as T
from helixframe.plans import report
from helixframe.plans.config import PipelineConfig
from helixframe.plans.pipeline import bind
from helixframe.plans.registry import READ_STAGES, read_stage, register_stage

DDL = "id string, seq string, qual string"


def make(spark, *rows):
    return spark.createDataFrame([(f"r{i}", s, q if q is not None else "I" * len(s)) for i, (s, q) in enumerate(rows)], DDL)


def seqs(spark, *s):
    return make(spark, *((x, None) for x in s))


def test_qc_and_gc(spark):
    r = make(spark, ("ACGT", "IIII"))
    assert R.qc_summary(r).first().asDict() == {"total_reads": 1, "total_bases": 4, "mean_quality": 40.0}
    assert R.gc_content(r).first().ratio == 0.5
    assert {(x.pos, x.mean_phred) for x in R.quality_decay(r).collect()} == {(i, 40.0) for i in range(4)}


def test_lengths(spark):
    assert R.length_summary(seqs(spark, "A" * 10, "A" * 20, "A" * 30)).first().asDict() == {"mean_length": 20.0, "min_length": 10, "max_length": 30}
    three = seqs(spark, "A" * 100, "A" * 200, "A" * 300)
    assert R.n50(three).first().n50 == 300
    assert {x.x: x.nx for x in R.nx_statistics(three).collect()}[90] == 100
    assert {(x.bin, x.reads) for x in R.length_bins(seqs(spark, "A" * 99, "A" * 100, "A" * 10_000)).collect()} == {("<100", 1), ("<500", 1), (">=10000", 1)}
    assert {(x.bin, x.reads) for x in R.length_distribution(seqs(spark, "A" * 5000, "A" * 3)).collect()} == {(999, 1), (3, 1)}


def test_entropy(spark):
    assert R.entropy_stats(seqs(spark, "AAAAAAAAAA", "ACGTACGTAC")).first().low_complexity_reads == 1
    assert math.isclose(R.entropy_stats(seqs(spark, "ACGT")).first().mean_entropy, 2.0)


def test_kmers(spark):
    assert {(x.kmer, x.kmer_index, x.occurrences) for x in R.kmer_counts(seqs(spark, "ACGT"), 2).collect()} == {("AC", 1, 1), ("CG", 6, 1), ("GT", 11, 1)}
    assert R.kmer_total(seqs(spark, "ACGTA"), 5).first().total_kmers == 1
    assert R.kmer_counts(seqs(spark, "ACNGT"), 3).count() == 0
    assert R.kmer_counts(seqs(spark, "AC"), 5).count() == 0


def test_gc_bins_in_single_precision(spark):
    assert [x.bin for x in R.gc_distribution(seqs(spark, "GCAT")).collect()] == [50]
    assert [x.bin for x in R.gc_distribution(seqs(spark, "G" * 53 + "A" * 47)).collect()] == [52]
    assert R.gc_distribution(seqs(spark, "")).count() == 0


def test_duplication_and_overrepresented(spark):
    r = seqs(spark, "ACGT", "acgt", "TGCA")
    assert R.duplication(r).first().asDict() == {"total_reads": 3, "duplicate_reads": 1, "duplication_ratio": 0.3333}
    assert R.overrepresented(r).first().asDict() == {"unique_sequences": 2, "most_frequent": "ACGT", "most_frequent_count": 2}
    assert R.duplication_warning(r).first().warn is True
    assert S.duplication_approx(r).first().duplicate_reads == 1


def test_adapter(spark):
    assert R.adapter_detect(seqs(spark, "A" * 20)).first().asDict() == {"total_suffix_kmers": 13, "top_kmer": "AAAAAAAA", "top_count": 13, "detected": True}
    assert R.adapter_detect(seqs(spark, "ACGT")).first().asDict() == {"total_suffix_kmers": 0, "top_kmer": "None", "top_count": 0, "detected": False}


def test_composition_and_integrity(spark):
    r = seqs(spark, "ACGTN*", "nnnn")
    assert R.nucleotide_composition(r).first().asDict() == {"a": 1, "c": 1, "g": 1, "t": 1, "n": 6, "total": 10}
    assert R.integrity(r).first().asDict() == {"invalid_bases": 1, "identity_violations": 0}
    assert R.n_statistics(r).first().asDict() == {"n_count": 6, "n_ratio": 0.6}


@pytest.mark.parametrize("name", sorted(set(READ_STAGES) - {"gc"}))
def test_empty_input(spark, name):
    rows = READ_STAGES[name](seqs(spark).filter("false")).collect()
    assert len(rows) <= 1


def test_empty_basic_stats(spark):
    assert R.basic_stats(seqs(spark).filter("false")).first().asDict() == {"total_reads": 0, "total_bases": 0, "min_length": 0, "max_length": 0, "mean_length": 0.0, "integrity_violations": 0}


def test_trim_filter_chain(spark):
    r = make(spark, ("AAAAAGCT", "IIIIIIII"), ("CCCCCCCC", "!!!!!!!!"))
    config = PipelineConfig(pipeline=["basic_stats", "trim", "filter", "basic_stats"], min_quality=20, adapter_sequence="AGCT")
    bound = bind(r, config)
    assert [b.result.first()[0] for b in bound] == [2, 2, 2, 1]
    assert T.trimmed(r, "AGCT").first().seq == "AAAA"
    assert T.filter_stats(r, 20).first().asDict() == {"reads_seen": 2, "reads_passed": 1, "reads_filtered": 1}
    assert report.read_report(r, config)["read_count"] == 2
    assert T.quality_filter(make(spark, ("", "")), 20).count() == 1
    with pytest.raises(ValueError):
        T.trim(r, -1)


def test_trim_ends(spark):
    got = T.trimmed(make(spark, ("ACGTACGT", "IIIIJJJJ"), ("AC", "IJ")), front=2, tail=3).collect()
    assert [(x.seq, x.qual) for x in got] == [("GTA", "IIJ"), ("", "")]


def test_taxonomy(spark):
    sig = spark.createDataFrame([("phix", "A" * 16), ("ecoli", "C" * 16)], "taxon string, kmer string")
    got = R.taxonomic_screening(seqs(spark, "A" * 20, "C" * 16, "G" * 30, "ACG"), sig)
    assert {(x.taxon, x.reads) for x in got.collect()} == {("phix", 1), ("ecoli", 1), ("Unknown", 2)}
    assert {(x.taxon, x.percent) for x in R.taxon_composition(got).collect()} == {("phix", 25.0), ("ecoli", 25.0), ("Unknown", 50.0)}


def test_bloom_never_misses(spark):
    v = spark.range(500).withColumnRenamed("id", "v")
    held = S.bloom_build(v, "v", 500)
    assert S.bloom_contains(v, "v", held, 500).filter("not maybe").count() == 0
    others = spark.range(10_000, 12_000).withColumnRenamed("id", "v")
    assert S.bloom_contains(others, "v", held, 500).filter("maybe").count() < 60


def test_minhash(spark):
    import random

    rng = random.Random(1)
    a = "".join(rng.choice("ACGT") for _ in range(300))
    b = "".join(rng.choice("ACGT") for _ in range(300))
    got = {x.id: x for x in S.minhash_similarity(seqs(spark, a, a, b)).collect()}
    assert set(got) == {"r1"} and got["r1"].other == "r0" and got["r1"].similarity == 1.0


@pytest.mark.parametrize("hot", [3, 10_000])
def test_minhash_equals_brute_force(spark, hot):
    """Families of edited reads with repeated members: every pair of sequences with a band in common, and every copy."""
    import random
    from itertools import combinations

    rng, texts = random.Random(2), ["ACGT", "N" * 30]
    for _ in range(6):
        base = [rng.choice("ACGT") for _ in range(200)]
        for edits in (0, 0, 0, 0, 1, 1, 2, 2, 3, 6):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(200)] = rng.choice("ACGTn")
            texts.append("".join(w))
    rng.shuffle(texts)
    reads = seqs(spark, *texts)
    sketch = {x.id: x.sketch for x in S.minhash(reads).collect()}
    classes = {}
    for r in reads.collect():
        if r.id in sketch:
            classes.setdefault(r.seq.upper(), []).append(r.id)
    want = {(i, min(ids), 1.0) for ids in classes.values() for i in ids if i != min(ids)}
    for x, y in combinations(sorted(map(min, classes.values())), 2):
        if any(sketch[x][i : i + 4] == sketch[y][i : i + 4] for i in range(0, 16, 4)):
            want.add((y, x, round(sum(p == q for p, q in zip(sketch[x], sketch[y])) / 16, 4)))
    got = [tuple(r) for r in S.minhash_similarity(reads, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60

    one_id = S.minhash_similarity(reads.selectExpr("'x' as id", "seq"))
    assert one_id.count() == sum(a != b for a, b, s in want) - sum(len(ids) - 1 for ids in classes.values())


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_partitions_do_not_matter(spark, parts):
    r = seqs(spark, *("ACGTN"[i % 5] * (i % 40 + 1) for i in range(200))).repartition(parts)
    assert R.fused(r).first()[:6] == (200, 4100, 1, 40, 20.5, 0)


def test_registry(spark):
    with pytest.raises(ValueError, match="unknown stage"):
        read_stage("nope")
    register_stage("mine", lambda r: r.groupBy().count())
    assert read_stage("mine")(seqs(spark, "A")).first()[0] == 1
    del READ_STAGES["mine"]


def test_config():
    c = PipelineConfig.from_json('{"pipeline": ["n50"], "mode": "fast", "unknown": 1}')
    assert c.approximate and c.pipeline == ["n50"]
    with pytest.raises(ValueError):
        PipelineConfig(mode="other")


def test_signatures_from_a_file(spark, tmp_path):
    from helixframe.sources.signatures import read_signatures

    (tmp_path / "s.tsv").write_text("taxon\tkmer\nphix\tacgtacgtacgtacgt\nodd\tACGTNCGTACGTACGT\n")
    known = read_signatures(spark, str(tmp_path / "s.tsv"))
    reads = spark.createDataFrame([("a", "ACGTACGTACGTACGTA", "I" * 17), ("b", "T" * 20, "I" * 20), ("c", "ACGTNCGTACGTACGT", "I" * 16)], "id string, seq string, qual string")
    assert {(r.taxon, r.reads) for r in R.taxonomic_screening(reads, known).collect()} == {("phix", 1), ("Unknown", 2)}


def test_kernels_on_awkward_reads(spark):
    rows = [("a", None, None), ("b", "", ""), ("c", "acgtN-é", "!~IéI一I"), ("d", "ACGT" * 300, "I" * 1200)]
    reads = spark.createDataFrame(rows, "id string, seq string, qual string").repartition(3)
    got = R.fused(reads).first()
    assert (got.total_reads, got.total_bases, got.min_length, got.max_length, got.n_count, got.integrity_violations) == (4, 1207, 0, 1200, 3, 2)
    brute = {}
    for _, _, q in rows:
        for i, c in enumerate((q or "")[:512]):
            cell = (i, min(max(min(ord(c), 255) - 33, 0), 93))
            brute[cell] = brute.get(cell, 0) + 1
    assert {(r.pos, r.phred): r.reads for r in R.quality_dist(reads).collect()} == brute
    for k in (3, 11, 31, 33):
        want = {}
        for _, s, _ in rows:
            s = (s or "").upper()
            for i in range(len(s) - k + 1):
                if set(w := s[i : i + k]) <= set("ACGT"):
                    want[w] = want.get(w, 0) + 1
        assert {r.kmer: r.occurrences for r in R.kmer_counts(reads, k).collect()} == want
    assert R.quality_dist(reads.filter("false")).count() == R.kmer_counts(reads.filter("false")).count() == 0


def test_rows_of_one_id_are_called_together(spark):
    """A k-mer that two rows of an id hold is one vote, so the taxon with more distinct k-mers wins."""
    known = spark.createDataFrame([("x", "AAAA"), ("y", "CCCC"), ("y", "CCCG")], "taxon string, kmer string")
    reads = spark.createDataFrame([("a", "AAAA", "IIII"), ("a", "AAAA", "IIII"), ("a", "AAAAT", "IIIII"), ("a", "CCCCG", "IIIII")], "id string, seq string, qual string")
    found = {(r.taxon, r.reads) for r in R.taxonomic_screening(reads, known, 4).collect()}
    assert ("y", 1) in found and "x" not in {t for t, _ in found}


def test_minhash_pairs_are_compared_in_compiled_code(spark):
    """No lambda runs for each pair of reads that meet."""
    plan = S.minhash_similarity(seqs(spark, "ACGT" * 5))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "Join" in plan
