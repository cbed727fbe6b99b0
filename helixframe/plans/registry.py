"""Stages by name. A stage maps a DataFrame and parameters to a flat DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import alignments, reads, sketches

Stage = Callable[..., DataFrame]

READ_STAGES: dict[str, Stage] = {
    "basic_stats": reads.basic_stats,
    "gc_distribution": reads.gc_distribution,
    "n_statistics": reads.n_statistics,
    "length_distribution": reads.length_distribution,
    "quality_dist": reads.quality_dist,
    "nucleotide_composition": reads.nucleotide_composition,
    "qc": reads.qc_summary,
    "gc_content": reads.gc_content,
    "gc": reads.gc_content,
    "length": reads.length_summary,
    "length_bins": reads.length_bins,
    "n50": reads.n50,
    "nx_statistics": reads.nx_statistics,
    "duplication": reads.duplication,
    "overrepresented": reads.overrepresented,
    "kmer": reads.kmer_counts,
    "kmer_spectrum": reads.kmer_spectrum_top3,
    "entropy": reads.entropy_stats,
    "quality_decay": reads.quality_decay,
    "per_base_quality": reads.per_base_quality,
    "per_base_composition": reads.per_base_composition,
    "adapter_detect": reads.adapter_detect,
    "integrity": reads.integrity,
    "quality_bands": reads.quality_bands,
    "telemetry": reads.telemetry,
}
APPROXIMATE: dict[str, Stage] = {"duplication": sketches.duplication_approx, "overrepresented": lambda r: sketches.overrepresented_sampled(r, top=1)}
ALIGNMENT_STAGES: dict[str, Stage] = {
    "alignment_stats": alignments.alignment_stats,
    "mapq_distribution": alignments.mapq_distribution,
    "coverage": alignments.coverage,
    "error_rate_stats": alignments.error_rate,
    "soft_clipping": alignments.soft_clipping,
    "insert_size": alignments.insert_size,
    "insert_size_hist": alignments.insert_size_hist,
}


def register_stage(name: str, stage: Stage, kind: str = "reads") -> None:
    """Add a stage of one's own; it then works in configurations like any other."""
    {"reads": READ_STAGES, "alignments": ALIGNMENT_STAGES}[kind][name] = stage


def read_stage(name: str, approximate: bool = False) -> Stage:
    if name not in READ_STAGES:
        raise ValueError(f"unknown stage {name!r}; known: {', '.join(sorted(READ_STAGES))}")
    return APPROXIMATE.get(name, READ_STAGES[name]) if approximate else READ_STAGES[name]
