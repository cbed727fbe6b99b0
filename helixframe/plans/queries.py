"""The registered queries over derived reads and alignments, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.sequence import signature, two_bit
from ..operators import alignments as A
from ..operators import reads as R
from ..operators import sketches as S
from ..operators import transforms as T
from ..sources import generate
from ..sources.bam import read_bam, write_bam
from ..sources.fastq import read_fastq, write_fastq
from ..sources.scratch import shared_path
from ..streaming.telemetry import Session
from .derived import ALIGNMENTS_SQL, DOCUMENT_READS_SQL, READS_SQL, alignments, document_reads, reads

ADAPTER, FRONT, TAIL, MIN_QUALITY, REFERENCE = "ACGT", 2, 3, 28.0, 3_000_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_BASES = """b as (select *, length(seq)::bigint as len, (length(seq) - length(replace(upper(seq),'A','')))::bigint as a,
 (length(seq) - length(replace(upper(seq),'C','')))::bigint as c, (length(seq) - length(replace(upper(seq),'G','')))::bigint as g,
 (length(seq) - length(replace(upper(seq),'T','')))::bigint as t, length(regexp_replace(upper(seq),'[ACGT]','','g'))::bigint as n,
 length(regexp_replace(seq,'[ACGTNacgtn]','','g'))::bigint as bad from r)"""
_NSEQ = "regexp_replace(upper(seq), '[^ACGT]', 'N', 'g')"
_CHARS = "q as (select i - 1 as pos, greatest(ascii(substr(qual, i::int, 1)) - 33, 0) as phred from (select qual, unnest(range(1, length(qual) + 1)) as i from r))"
_MEAN = "(length(qual) = 0 or list_sum([greatest(ascii(x) - 33, 0) for x in string_split(qual, '')])::double / length(qual) >= {})"
_TRIMMED = f"""tr as (select id, case when ends_with(s, '{ADAPTER}') then left(s, length(s) - {len(ADAPTER)}) else s end as seq,
 case when ends_with(s, '{ADAPTER}') then left(q, length(s) - {len(ADAPTER)}) else q end as qual, length(o) - length(s) + case when ends_with(s, '{ADAPTER}') then {len(ADAPTER)} else 0 end as gone
 from (select id, seq as o, substr(seq, {FRONT + 1}, greatest(length(seq) - {FRONT + TAIL}, 0)) as s, substr(qual, {FRONT + 1}, greatest(length(qual) - {FRONT + TAIL}, 0)) as q from r))"""


def _with(*parts: str, source: str = READS_SQL) -> str:
    return f"with r as ({source})" + "".join(f", {p}" for p in parts) + " "


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _reads(name: str, stage: Callable[..., DataFrame], sql: str | None = None, **params) -> None:
    _add(name, lambda s, d: stage(reads(s, d), **params), sql)


def _basic(source: str = "b") -> str:
    return f"select count(*) as total_reads, coalesce(sum(len),0)::bigint as total_bases, coalesce(min(len),0) as min_length, coalesce(max(len),0) as max_length, coalesce(round(sum(len)::double/nullif(count(*),0),2),0.0) as mean_length, coalesce(sum(bad),0)::bigint as integrity_violations from {source}"


_reads("basic_stats", R.basic_stats, _with(_BASES) + _basic())
_reads("n_statistics", R.n_statistics, _with(_BASES) + "select sum(n)::bigint as n_count, round(sum(n)::double/sum(len),4) as n_ratio from b")
_reads("nucleotide_composition", R.nucleotide_composition, _with(_BASES) + "select sum(a)::bigint as a, sum(c)::bigint as c, sum(g)::bigint as g, sum(t)::bigint as t, sum(n)::bigint as n, sum(len)::bigint as total from b")
_reads("integrity", R.integrity, _with(_BASES) + "select sum(bad)::bigint as invalid_bases, sum(len-a-c-g-t-n)::bigint as identity_violations from b")
_reads("fused_report", R.fused, _with(_BASES) + "select count(*) as total_reads, sum(len)::bigint as total_bases, min(len) as min_length, max(len) as max_length, round(sum(len)::double/count(*),2) as mean_length, sum(bad)::bigint as integrity_violations, sum(a)::bigint as a_count, sum(c)::bigint as c_count, sum(g)::bigint as g_count, sum(t)::bigint as t_count, sum(n)::bigint as n_count, round(sum(n)::double/sum(len),4) as n_ratio from b")
_reads("gc_distribution", R.gc_distribution, _with(_BASES) + "select least(cast(floor(((g+c)::float/len::float)*100::float) as int),100) as bin, count(*) as reads from b where len > 0 group by 1")
_reads("length_distribution", R.length_distribution, _with() + "select least(length(seq),999)::int as bin, count(*) as reads from r group by 1")
_reads("quality_dist", R.quality_dist, _with(_CHARS) + "select pos::int as pos, least(phred,93)::int as phred, count(*) as reads from q where pos < 512 group by all")
_reads("per_base_quality", R.per_base_quality, _with(_CHARS) + "select pos::int as pos, least(phred,40)::int as phred, count(*) as reads from q where pos < 1000 group by all")
_reads("heatmap_intensity", R.heatmap_intensity, _with(_CHARS, "m as (select pos, least(phred,93) as phred, count(*) as k from q where pos < 512 group by all)") + "select pos::int as pos, phred::int as phred, round(log10(1.0::double+k)/log10(1.0::double+(select max(k) from m)),6) as intensity from m")
_reads("quality_decay", R.quality_decay, _with(_CHARS) + "select pos::int as pos, round(sum(phred)::double/count(*),4) as mean_phred from q where pos < 10000 group by 1")
_reads("per_base_composition", R.per_base_composition, _with() + f"select (i-1)::int as pos, substr(s,i::int,1) as base, count(*) as reads from (select {_NSEQ} as s, unnest(range(1,length(seq)+1)) as i from r) where i <= 1000 group by all")
_reads("qc_summary", R.qc_summary, _with(_CHARS) + "select (select count(*) from r) as total_reads, (select sum(length(seq))::bigint from r) as total_bases, round((select sum(phred) from q)::double/(select sum(length(seq)) from r),4) as mean_quality")
_reads("gc_content", R.gc_content, _with(_BASES) + "select round(sum(g+c)::double/sum(len),4) as ratio from b")
_reads("length_summary", R.length_summary, _with(_BASES) + "select round(sum(len)::double/count(*),2) as mean_length, min(len) as min_length, max(len) as max_length from b")
_BIN_CASE = "case when len<100 then '<100' when len<500 then '<500' when len<1000 then '<1000' when len<5000 then '<5000' when len<10000 then '<10000' else '>=10000' end"
_reads("length_bins", R.length_bins, _with() + f"select {_BIN_CASE} as bin, count(*) as reads from (select length(seq) as len from r) group by 1")
_add("length_bins_documents", lambda s, d: R.length_bins(document_reads(s, d)), _with(source=DOCUMENT_READS_SQL) + f"select {_BIN_CASE} as bin, count(*) as reads from (select length(seq) as len from r) group by 1")
_WALK = "h as (select least(length(seq),29999)::bigint as len, count(*) as n from r group by 1), w as (select len, sum(len*n) over (order by len desc) as cum, sum(n) over (order by len desc) as reads, sum(len*n) over () as total from h)"
_N50 = "select coalesce(max(len) filter (where cum >= total // 2 and total > 0),0)::bigint as n50 from w"
_NX = "select x::int as x, max(len)::bigint as nx, min(reads)::bigint as lx from w, (select unnest([10,20,30,40,50,60,70,80,90]) as x) where cum >= total*x//100 and total > 0 group by 1"
_reads("n50", R.n50, _with(_WALK) + _N50)
_reads("nx_statistics", R.nx_statistics, _with(_WALK) + _NX)
_add("n50_documents", lambda s, d: R.n50(document_reads(s, d)), _with(_WALK, source=DOCUMENT_READS_SQL) + _N50)
_add("nx_documents", lambda s, d: R.nx_statistics(document_reads(s, d)), _with(_WALK, source=DOCUMENT_READS_SQL) + _NX)
_H = "-(case when a>0 then a::double/len*log2(a::double/len) else 0 end + case when c>0 then c::double/len*log2(c::double/len) else 0 end + case when g>0 then g::double/len*log2(g::double/len) else 0 end + case when t>0 then t::double/len*log2(t::double/len) else 0 end)"
_reads("entropy", R.entropy_stats, _with(_BASES, f"e as (select {_H} as h from b where len>0)") + "select round(avg(h),4) as mean_entropy, round(sum(h),2) as total_entropy_sum, count(*) filter (where h<1.5) as low_complexity_reads from e")
_DUP = f"d as (select {_NSEQ} as sequence, count(*) as reads from r group by 1)"
_DUP_OUT = "select sum(reads)::bigint as total_reads, (sum(reads)-count(*))::bigint as duplicate_reads, round((sum(reads)-count(*))::double/sum(reads),4) as duplication_ratio from d"
_reads("duplication", R.duplication, _with(_DUP) + _DUP_OUT)
_add("duplication_by_document", lambda s, d: R.duplication(document_reads(s, d)), _with(_DUP, source=DOCUMENT_READS_SQL) + _DUP_OUT)
_reads("duplication_warning", R.duplication_warning, _with(_DUP) + "select round(round((sum(reads)-count(*))::double/sum(reads),4)*100,4) as duplication_percent, round((sum(reads)-count(*))::double/sum(reads),4) > 0.2 as warn from d")
_reads("overrepresented", R.overrepresented, _with(_DUP) + "select count(*) as unique_sequences, (select sequence from d order by reads desc, sequence limit 1) as most_frequent, max(reads)::bigint as most_frequent_count from d")
_reads("overrepresented_top", R.overrepresented_top, _with(_DUP) + "select sequence, reads from d order by reads desc, sequence limit 20")
_KMERS = "k as (select substr(s, i::int, {k}) as kmer from (select s, unnest(range(1, length(s) - {k} + 2)) as i from (select " + _NSEQ + " as s from {f}) where length(s) >= {k})), kc as (select kmer, count(*) as occurrences from k where not contains(kmer,'N') group by 1)"
_INDEX = "list_sum([((position(substr(kmer, j::int, 1) in 'ACGT') - 1) * pow(4, {k} - j))::bigint for j in range(1, {k} + 1)])::bigint"
_reads("kmer_counts", R.kmer_counts, _with(_KMERS.format(k=5, f="r")) + f"select kmer, {_INDEX.format(k=5)} as kmer_index, occurrences from kc", k=5)
_reads("kmer_total", R.kmer_total, _with(_KMERS.format(k=5, f="r")) + "select sum(occurrences)::bigint as total_kmers, count(*) as distinct_kmers from kc", k=5)
_reads("kmer_spectrum_top3", R.kmer_spectrum_top3, _with(_KMERS.format(k=5, f="r")) + "select 5 as k, row_number() over (order by occurrences desc, kmer)::int as rank, occurrences from kc order by occurrences desc, kmer limit 3", k=5)
_TAILS = "tails as (select right(seq, 20) as seq from r where length(seq) >= 20)"
_reads("adapter_kmers", R.adapter_kmers, _with(_TAILS, _KMERS.format(k=8, f="tails")) + f"select kmer, {_INDEX.format(k=8)} as kmer_index, occurrences from kc")
_reads("adapter_detect", R.adapter_detect, _with(_TAILS, _KMERS.format(k=8, f="tails")) + "select sum(occurrences)::bigint as total_suffix_kmers, (select kmer from kc order by occurrences desc, kmer limit 1) as top_kmer, max(occurrences)::bigint as top_count, max(occurrences) > sum(occurrences)//10 as detected from kc")
_reads("quality_bands", R.quality_bands, _with(_CHARS) + "select case when phred<20 then '<20' when phred<30 then '<30' else '>=30' end as band, count(*) as bases from q group by 1")
_reads("telemetry", R.telemetry, _with(_BASES) + "select count(*) as read_count, sum(g+c)::bigint as gc, sum(a+t)::bigint as at, sum(n)::bigint as n, sum(a+c+g+t+n)::bigint as total, count(*)*128 as memory_estimate from b")
_reads("filter_stats", T.filter_stats, _with() + f"select count(*) as reads_seen, count(*) filter (where {_MEAN.format(MIN_QUALITY)}) as reads_passed, count(*) filter (where not {_MEAN.format(MIN_QUALITY)}) as reads_filtered from r", min_quality=MIN_QUALITY)
_reads("filter_yield", T.filter_yield, _with() + f"select count(*) as reads_seen, count(*) filter (where {_MEAN.format(MIN_QUALITY)}) as reads_passed, round(count(*) filter (where {_MEAN.format(MIN_QUALITY)})*100.0::double/count(*),4) as yield_percent from r", min_quality=MIN_QUALITY)
_add("filtered_basic_stats", lambda s, d: R.basic_stats(T.quality_filter(reads(s, d), MIN_QUALITY)), _with(_BASES) + _basic("b where " + _MEAN.format(MIN_QUALITY)))
_trim = {"adapter": ADAPTER, "front": FRONT, "tail": TAIL}
_reads("trim_stats", T.trim_stats, _with(_TRIMMED) + "select count(*) as reads_seen, count(*) filter (where gone>0) as reads_trimmed, sum(gone)::bigint as bases_trimmed from tr", **_trim)
_reads("trimmed_reads", T.trimmed, _with(_TRIMMED) + "select id, seq, qual from tr", **_trim)
_add("trim_filter_qc", lambda s, d: R.qc_summary(T.quality_filter(T.trimmed(reads(s, d), **_trim), MIN_QUALITY)), _with(_TRIMMED, f"f as (select * from tr where {_MEAN.format(MIN_QUALITY)})") + "select count(*) as total_reads, sum(length(seq))::bigint as total_bases, round(sum(list_sum([greatest(ascii(x)-33,0) for x in string_split(qual,'')]) filter (where length(qual)>0))::double/sum(length(seq)),4) as mean_quality from (select *, 1 from f)".replace("sum(list_sum([greatest(ascii(x)-33,0) for x in string_split(qual,'')]) filter (where length(qual)>0))", "sum(case when length(qual)>0 then list_sum([greatest(ascii(x)-33,0) for x in string_split(qual,'')]) else 0 end)"))
_add("two_bit_encode", lambda s, d: reads(s, d).select("id", two_bit("seq")[0].alias("digits"), two_bit("seq")[1].alias("valid")), _with() + f"select id, translate({_NSEQ},'ACGTN','01230') as digits, translate({_NSEQ},'ACGTN','11110') as valid from r")
_add("read_signature", lambda s, d: reads(s, d).groupBy(signature("seq").alias("sig")).agg(F.count(F.lit(1)).alias("reads")).agg(F.count(F.lit(1)).alias("signatures"), F.max("reads").alias("largest")), _with(_DUP) + "select count(*) as signatures, max(reads)::bigint as largest from d")


def _signatures(frame: DataFrame, k: int = 16) -> DataFrame:
    """Toy signatures: k-mers that start the parts' hashed sequences, a taxon each."""
    return frame.select(F.concat(F.lit("taxon_"), F.col("p_partkey").cast("string")).alias("taxon"), F.substring(F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGN"), 1, k).alias("kmer")).filter("not contains(kmer, 'N')")


def _taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads against the signatures of the whole part table."""
    return R.taxonomic_screening(reads(spark, sf_dir), _signatures(spark.read.parquet(f"{sf_dir}/part.parquet")))


_TAXA = "sig as (select 'taxon_' || p_partkey::varchar as taxon, substr(translate(md5(p_partkey::varchar),'0123456789abcdef','ACGTACGTACGTACGN'),1,16) as kmer from part), s1 as (select distinct taxon, kmer from sig where not contains(kmer,'N')), rk as (select distinct id, substr(s,i::int,16) as kmer from (select id, s, unnest(range(1,length(s)-14)) as i from (select id, " + _NSEQ + " as s from r) where length(s)>=16)), v as (select id, taxon, count(*) as v from rk join s1 using (kmer) group by all), best as (select id, arg_min(taxon, (-v, taxon)) as taxon from v group by 1), c as (select taxon, count(*) as reads from best group by 1), tx as (select taxon, reads from c union all select 'Unknown', (select count(*) from r) - coalesce((select sum(reads) from c),0)::bigint)"
_add("taxonomic_screening", _taxa, _with(_TAXA) + "select taxon, reads::bigint as reads from tx")
_add("taxon_composition", lambda s, d: R.taxon_composition(_taxa(s, d)), _with(_TAXA) + "select taxon, round(reads*100.0::double/(select sum(reads) from tx where reads>0),4) as percent from tx where reads > 0")


def _alignments(name: str, stage: Callable[..., DataFrame], sql: str, **params) -> None:
    _add(name, lambda s, d: stage(alignments(s, d), **params), _with(source=ALIGNMENTS_SQL) + sql)


def _ops(letters: str) -> str:
    return f"coalesce(list_sum([x::bigint for x in regexp_extract_all(cigar, '(\\d+)[{letters}]', 1)]),0)::bigint"


_C = f"(select *, {_ops('M=X')} as aligned, {_ops('I')} as ins, {_ops('D')} as del, {_ops('S')} as soft from r)"
_alignments("alignment_stats", A.alignment_stats, "select count(*) as total_records, count(*) filter (where mapping_quality>0) as mapped_reads, count(*) filter (where mapping_quality<=0) as unmapped_reads, round(avg(mapping_quality) filter (where mapping_quality>0),2) as mean_mapq from r")
_alignments("mapq_distribution", A.mapq_distribution, "select mapping_quality as mapq, count(*) as records from r group by 1")
_alignments("coverage", A.coverage, f"select sum(aligned)::bigint as aligned_bases, {REFERENCE}::bigint as reference_length, round(sum(aligned)::double/{REFERENCE},6) as coverage_estimate from {_C}", reference_length=REFERENCE)
_alignments("error_rate", A.error_rate, f"select sum(aligned)::bigint as aligned_bases, sum(ins+del)::bigint as mismatches, round(sum(ins+del)::double/sum(aligned),6) as error_rate from {_C}")
_alignments("soft_clipping", A.soft_clipping, f"select count(*) filter (where soft>0) as soft_clipped_reads, sum(soft)::bigint as soft_clipped_bases from {_C}")
_alignments("insert_size", A.insert_size, "select count(*) as pairs_analyzed, min(template_length)::bigint as min_insert, max(template_length)::bigint as max_insert, round(avg(template_length),2) as mean_insert from r where template_length>0")
_alignments("insert_size_hist", A.insert_size_hist, "select (template_length//500)::int as bin, count(*) as pairs from r where template_length>0 group by 1")
_alignments("cigar_stats", A.cigars, f"select cigar, count(*) as records, any_value(aligned) as aligned, any_value(ins) as insertions, any_value(del) as deletions, any_value(soft) as soft_clips from {_C} group by 1")

_reads("duplication_approx", S.duplication_approx)
_reads("overrepresented_sampled", S.overrepresented_sampled, _with(f"d as (select {_NSEQ} as sequence, count(*) * 4 as reads from r where ('0x' || substr(md5(id), 1, 8))::bigint % 4 = 0 group by 1)") + "select sequence, reads from d order by reads desc, sequence limit 20")

#: Sketches are minima over the base-4 numbers of the k-mers; bands are four of them in a row.
_MINIMA = ", ".join(f"list_min([({a} * x + {b}) % {S.PRIME} for x in codes])" for a, b in S.permutations(16))
_MINHASH = (
    f"nm as (select id, seq from (select id, {_NSEQ} as seq from r) where regexp_matches(seq, '[ACGT]{{11}}')), "
    "hd as (select seq, min(id) as other from nm group by 1), "
    f"cd as (select seq, other, [{_INDEX.format(k=11).replace('kmer', 'm')} % {S.PRIME} for m in [substr(seq, i::int, 11) for i in range(1, length(seq) - 9)] if not contains(m, 'N')] as codes from hd), "
    f"sk as (select other, seq, [{_MINIMA}] as sketch from cd), "
    "ky as (select other, seq, sketch, unnest([{'band': 1, 'key': sketch[1:4]}, {'band': 2, 'key': sketch[5:8]}, {'band': 3, 'key': sketch[9:12]}, {'band': 4, 'key': sketch[13:16]}]) as x from sk), "
    "pr as (select distinct a.other as id, b.other as other, a.seq as seq1, b.seq as seq2, a.sketch as s1, b.sketch as s2 from ky a join ky b on a.x = b.x and (a.other > b.other or a.other = b.other and a.seq > b.seq)) "
)
_add(
    "minhash_similarity",
    lambda s, d: S.minhash_similarity(reads(s, d)),
    _with(_MINHASH) + "select id, other, round(len([i for i in range(1, 17) if s1[i::int] = s2[i::int]])::double / 16, 4) as similarity from pr union all select nm.id, hd.other, 1.0::double from nm join hd using (seq) where nm.id <> hd.other",
)


def _bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter of the quantities 1 to 25 asked for every quantity: none it holds is missed, and few others seem to be in it."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("bigint").alias("v"))
    asked = S.bloom_contains(rows, "v", S.bloom_build(rows.filter("v <= 25"), "v", 25), 25)
    wrong = F.count_if(F.expr("v > 25 and maybe"))
    return asked.agg(F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.expr("v <= 25 and not maybe")).alias("missed"), (wrong <= 3).alias("few_false_positives"))


_add("bloom_filter", _bloom, "select count(distinct l_quantity::bigint) as distinct_values, 0::bigint as missed, true as few_false_positives from lineitem")


def _fastq_scan(compression: str, **options: str) -> Query:
    """Write the reads as FASTQ files and scan them back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        write_fastq(reads(spark, sf_dir), path := shared_path(spark, "fastq"), compression)
        return R.basic_stats(read_fastq(spark, path, columns="seq", **options))

    return query


def _fastq_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a short quality or a wrong separator among the reads, counted by what a checked scan says of them."""
    broken = F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.when(F.col("id").endswith(".2"), "\n-\n").otherwise("\n+\n"), F.when(F.col("id").endswith(".1"), F.expr("substr(qual, 2)")).otherwise(F.col("qual")))
    reads(spark, sf_dir).select(broken.alias("value")).write.mode("overwrite").text(path := shared_path(spark, "broken"))
    return read_fastq(spark, path, mode="PERMISSIVE").groupBy(F.coalesce("_error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("reads"))


def _live(view: str) -> Query:
    """A live view after a stream has taken in all reads."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        reads(spark, sf_dir).write.mode("overwrite").parquet(path := shared_path(spark, "stream"))
        live = Session(spark, path, kind="parquet", name=f"live_{uuid.uuid4().hex}").start(once=True)
        live.query.awaitTermination()
        return live.table(view)

    return query


def _bam_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the alignments as BAM files and scan them back in splits."""
    write_bam(alignments(spark, sf_dir), path := shared_path(spark, "bam"), 23)
    return read_bam(spark, path, columns="flag,reference_id,position,mapping_quality,cigar,template_length", splitBytes=str(1 << 17))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.report_counts(reads(spark, sf_dir), R.LENGTH_CAP, R.QUALITY_POSITIONS, R.QUALITY_CAP)


_REPORT = _with(_BASES, _CHARS) + """, rp as (
 select 'reads' as what, 0 as x, 0 as y, count(*) as n from b union all select 'bases', 0, 0, sum(len)::bigint from b union all select 'bad', 0, 0, sum(bad)::bigint from b
 union all select 'shortest', 0, 0, min(len) from b union all select 'longest', 0, 0, max(len) from b
 union all select 'base', i, 0, n from (select unnest([{'i': 0, 'n': sum(a)}, {'i': 1, 'n': sum(c)}, {'i': 2, 'n': sum(g)}, {'i': 3, 'n': sum(t)}, {'i': 4, 'n': sum(n)}], recursive := true) from b) where n > 0
 union all select 'gc', least(cast(floor(((g+c)::float/len::float)*100::float) as int),100), 0, count(*) from b where len > 0 group by all
 union all select 'length', least(len, 999), 0, count(*) from b group by all
 union all select 'quality', pos, least(phred, 93), count(*) from q where pos < 512 group by all)
select what, x::int as x, y::int as y, n::bigint as n from rp"""

_add("report_counts", _report, _REPORT)
_add("fastq_scan", _fastq_scan("none"), ORACLE_SQL["basic_stats"])
_add("fastq_scan_gzip", _fastq_scan("gzip"), ORACLE_SQL["basic_stats"])
_add("fastq_scan_bgzf", _fastq_scan("bgzf", splitBytes=str(1 << 17)), ORACLE_SQL["basic_stats"])
_add("fastq_modes", _fastq_modes, _with() + "select case when id like '%.1' then 'MismatchedSequenceQuality' when id like '%.2' then 'InvalidFormat' else 'none' end as error, count(*) as reads from r group by 1")
_add("bam_scan", _bam_scan, f"select flag, reference_id, position, mapping_quality, cigar, template_length from ({ALIGNMENTS_SQL})")
_add("live_telemetry", _live("scalars"), _with(_BASES) + 'select count(*) as read_count, sum(len)::bigint as total, sum(g+c)::bigint as gc, sum(a+t)::bigint as "at", sum(n)::bigint as n, sum(bad)::bigint as violations from b')
_add("live_gc", _live("gc"), ORACLE_SQL["gc_distribution"])
_add("live_lengths", _live("lengths"), ORACLE_SQL["length_distribution"])
_add("live_heatmap", _live("heatmap"), _with(_CHARS) + "select pos::int as pos, least(phred,41)::int as phred, count(*) as reads from q where pos < 150 group by all")

_GEN = "g as (select i as id, translate(substr(md5('{s}.0.'||i)||md5('{s}.1.'||i)||md5('{s}.2.'||i)||md5('{s}.3.'||i)||md5('{s}.4.'||i), 1, 160), '0123456789abcdef', 'ACGTACGTACGTACGT') as t from range({n}) x(i))"
_add("generated_constant", lambda s, d: generate.constant_quality(s, 2000), "with " + _GEN.format(s=1, n=2000) + " select 'read_'||id as id, substr(t, 1, 16) as seq, repeat('I', 16) as qual from g")
_LOT = "(('0x'||substr(md5('{s}.'||i),1,8))::bigint % {n})"
_add(
    "generated_mixed",
    lambda s, d: generate.mixed(s, 2000),
    "with " + _GEN.format(s=9, n=2000) + f", p as (select i as read, case when {_LOT.format(s=7, n=100)} >= 95 then 0 else i end as id, {_LOT.format(s=7, n=100)} as u, case when {_LOT.format(s=7, n=100)} >= 95 then 100 else {_LOT.format(s=8, n=76)} + 75 end as n from range(2000) x(i)) "
    f"select 'read_'||read as id, case when u = 0 then repeat('A', n) when u = 1 then translate(substr(t, 1, n::int), 'CT', 'NN') when u < 4 then substr(t, 1, (n - {len(generate.TRUSEQ)})::int)||'{generate.TRUSEQ}' else substr(t, 1, n::int) end as seq, "
    "array_to_string([chr((73 - i // 5)::int) for i in range(n)], '') as qual from p join g using (id)",
)
