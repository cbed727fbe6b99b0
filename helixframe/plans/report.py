"""Reports: JSON (flat or nested), NDJSON and text, from a pipeline's small results."""

from __future__ import annotations

import json
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import alignments as aln
from ..operators import reads as R
from .config import PipelineConfig
from .pipeline import bind
from .registry import ALIGNMENT_STAGES, READ_STAGES

VERSION = "1.0"
#: Bins of dense arrays in the report: column, size (None: up to the largest bin).
_DENSE = {"gc_distribution": ("bin", "reads", 101), "length_distribution": ("bin", "reads", None), "mapq_distribution": ("mapq", "records", None), "insert_size_hist": ("bin", "pairs", None)}


def _dense(rows: list, key: str, value: str, size: int | None) -> list[int]:
    found = {r[key]: r[value] for r in rows if r[key] is not None}
    return [found.get(i, 0) for i in range(size if size is not None else max(found, default=-1) + 1)]


def _matrix(rows: list, width: int) -> dict[str, Any]:
    depth = max((r["pos"] for r in rows), default=-1) + 1
    data = [[0] * width for _ in range(depth)]
    for r in rows:
        data[r["pos"]][r["phred"]] = r["reads"]
    return {"max_pos": depth, "data": data}


def shaped(name: str, result: DataFrame) -> Any:
    """A stage's rows as its report value. Stage results are histograms or single rows, bounded by their caps; k-mer tables by 4**k."""
    rows = result.collect()
    if name in _DENSE:
        return {"bins": _dense(rows, *_DENSE[name])}
    if name in ("quality_dist", "per_base_quality"):
        return _matrix(rows, 94 if name == "quality_dist" else 41)
    if name == "kmer_spectrum":
        return {"k": rows[0]["k"] if rows else None, "counts": [r["occurrences"] for r in rows]}
    if len(rows) == 1 and name not in ("length_bins", "kmer", "nx_statistics", "quality_bands", "quality_decay", "per_base_composition"):
        return rows[0].asDict(recursive=True)
    return [r.asDict(recursive=True) for r in rows]


def _ratio(a: int, b: int, digits: int) -> float:
    """Rounded half up as Spark rounds, 0 where the denominator is 0."""
    return float(Decimal(repr(a / b)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if b else 0.0


def _cells(counts: DataFrame) -> dict[str, dict[tuple[int, int], int]]:
    """The rows of ``kernels.REPORT``, which are histograms bounded by their caps."""
    found: dict[str, dict[tuple[int, int], int]] = defaultdict(dict)
    for r in counts.collect():
        found[r["what"]][r["x"], r["y"]] = r["n"]
    return found


def _line(cells: dict[tuple[int, int], int], size: int | None = None) -> list[int]:
    return [cells.get((i, 0), 0) for i in range(size if size is not None else max((x for x, _ in cells), default=-1) + 1)]


#: Read stages that one pass gives together, as they are registered by default.
TOGETHER = {n: READ_STAGES[n] for n in ("basic_stats", "gc_distribution", "n_statistics", "length_distribution", "quality_dist", "nucleotide_composition")}


def default_stages(reads: DataFrame) -> tuple[int, dict[str, Any]]:
    """The reads, and the report values of all stages of ``TOGETHER``, from one scan."""
    found = _cells(kernels.report_counts(reads, R.LENGTH_CAP, R.QUALITY_POSITIONS, R.QUALITY_CAP))
    one = lambda what: found[what].get((0, 0), 0)
    count, total, bases = one("reads"), one("bases"), _line(found["base"], 5)
    stages = {
        "basic_stats": {"total_reads": count, "total_bases": total, "min_length": one("shortest"), "max_length": one("longest"), "mean_length": _ratio(total, count, 2), "integrity_violations": one("bad")},
        "gc_distribution": {"bins": _line(found["gc"], 101)},
        "n_statistics": {"n_count": bases[4], "n_ratio": _ratio(bases[4], total, 4)},
        "length_distribution": {"bins": _line(found["length"])},
        "quality_dist": _matrix([{"pos": x, "phred": y, "reads": n} for (x, y), n in found["quality"].items()], R.QUALITY_CAP + 1),
        "nucleotide_composition": {**dict(zip("acgtn", bases)), "total": total},
    }
    return count, stages


def read_report(reads: DataFrame, config: PipelineConfig | None = None, nested: bool = False) -> dict[str, Any]:
    """read_count (every read, before any filter) and each stage under its name.

    Default stages that stand between the same transforms come from one scan;
    any other stage is a plan of its own.
    """
    config = config or PipelineConfig()
    scans: dict[int, tuple[int, dict[str, Any]]] = {}
    stages: dict[str, Any] = {}
    for b in bind(reads, config):
        if b.name in TOGETHER and READ_STAGES[b.name] is TOGETHER[b.name]:
            if id(b.source) not in scans:
                scans[id(b.source)] = default_stages(b.source)
            stages[b.name] = scans[id(b.source)][1][b.name]
        else:
            stages[b.name] = shaped(b.name, b.result)
    count = scans[id(reads)][0] if id(reads) in scans else reads.agg(F.count(F.lit(1))).first()[0]
    if nested:
        return {"version": VERSION, "thread_count": config.threads, "read_count": count, "stages": stages}
    return {"read_count": count, **stages}


_ALIGNED_TOGETHER = dict(ALIGNMENT_STAGES)


def alignment_stages(records: DataFrame, reference_length: int) -> dict[str, Any]:
    """The report values of the alignment stages, from one scan."""
    found = _cells(kernels.alignment_counts(records, aln.INSERT_BIN))
    one = lambda what: found[what].get((0, 0), 0)
    mapq = {x: n for (x, _), n in found["mapq"].items()}
    mapped = sum(n for q, n in mapq.items() if q > 0)
    pairs, aligned, errors = sum(found["pairs"].values()), one("aligned"), one("insertions") + one("deletions")
    return {
        "alignment_stats": {"total_records": one("records"), "mapped_reads": mapped, "unmapped_reads": one("records") - mapped, "mean_mapq": _ratio(sum(q * n for q, n in mapq.items() if q > 0), mapped, 2)},
        "mapq_distribution": {"histogram": _line({k: n for k, n in found["mapq"].items() if k[0] >= 0})},
        "coverage": {"aligned_bases": aligned, "reference_length": reference_length, "coverage_estimate": _ratio(aligned, reference_length, 6)},
        "error_rate_stats": {"aligned_bases": aligned, "mismatches": errors, "error_rate": _ratio(errors, aligned, 6)},
        "soft_clipping": {"soft_clipped_reads": one("clipped"), "soft_clipped_bases": one("soft_clips")},
        "insert_size": {"pairs_analyzed": pairs, "min_insert": one("shortest"), "max_insert": one("longest"), "mean_insert": _ratio(one("inserts"), pairs, 2), "histogram_500bp_bins": _line(found["pairs"])},
    }


def alignment_report(records: DataFrame, reference_length: int = 0) -> dict[str, Any]:
    """The built-in stages from one scan, and every stage that was registered besides or in the place of one by a plan of its own."""
    stages = alignment_stages(records, reference_length)
    for name, stage in ALIGNMENT_STAGES.items():
        if _ALIGNED_TOGETHER.get(name) is not stage:
            stages[name] = shaped(name, stage(records))
    return {"version": VERSION, "read_count": stages["alignment_stats"]["total_records"], "stages": stages}


def to_json(report: dict[str, Any]) -> str:
    return json.dumps(report, ensure_ascii=False)


def to_ndjson(report: dict[str, Any]) -> str:
    """A header line, then a line per stage."""
    stages = report.get("stages") or {k: v for k, v in report.items() if k != "read_count"}
    lines = [{"version": report.get("version", VERSION), "read_count": report["read_count"]}, *({"stage": k, "data": v} for k, v in stages.items())]
    return "\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n"


def to_text(report: dict[str, Any], limit: int = 10) -> str:
    """Lines for people; long lists are cut to their first entries."""
    stages = report.get("stages") or {k: v for k, v in report.items() if k != "read_count"}
    out = [f"reads: {report['read_count']}"]
    for name, value in stages.items():
        out.append(f"[{name}]")
        items = value.items() if isinstance(value, dict) else enumerate(value[:limit])
        out += [f"  {k}: {v[:limit] if isinstance(v, list) else v}" for k, v in items]
    return "\n".join(out) + "\n"


def write_ndjson(report: dict[str, Any], spark, path: str) -> None:
    """The NDJSON lines as a one-file text dataset."""
    spark.createDataFrame([(x,) for x in to_ndjson(report).splitlines()], "value string").coalesce(1).write.mode("overwrite").text(path)
