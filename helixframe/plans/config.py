"""Pipeline configuration: a dataclass read from JSON, unknown fields ignored."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

MODES = ("exact", "fast", "approx")
GZIP_MODES = ("auto", "none", "gzip", "bgzf", "native", "libdeflate", "chunked", "compat")
DEFAULT_STAGES = ("basic_stats", "gc_distribution", "n_statistics", "length_distribution", "quality_dist", "nucleotide_composition")


@dataclass
class PipelineConfig:
    pipeline: list[str] = field(default_factory=lambda: list(DEFAULT_STAGES))
    mode: str = "exact"
    threads: int = 8
    gzip_mode: str = "auto"
    trim_front: int = 0
    trim_tail: int = 0
    min_quality: float = 0.0
    adapter_sequence: str | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if self.gzip_mode not in GZIP_MODES:
            raise ValueError(f"gzip_mode must be one of {', '.join(GZIP_MODES)}")

    @property
    def approximate(self) -> bool:
        return self.mode != "exact"

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> PipelineConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    @classmethod
    def from_json(cls, text: str) -> PipelineConfig:
        return cls.from_dict(json.loads(text))
