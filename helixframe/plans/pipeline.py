"""Ordered pipelines: transforms change what later stages see, aggregates bind where they stand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import transforms
from .config import PipelineConfig
from .registry import read_stage

TRANSFORMS = ("trim", "filter")


@dataclass
class Bound:
    """A stage's result, and the DataFrame it is bound to."""

    name: str
    result: DataFrame
    source: DataFrame


def bind(reads: DataFrame, config: PipelineConfig) -> list[Bound]:
    """The stages of a configuration in order. A filter drops reads for the stages after it only."""
    bound, now = [], reads
    for name in config.pipeline:
        if name == "trim":
            args = (config.adapter_sequence, config.trim_front, config.trim_tail)
            bound.append(Bound(name, transforms.trim_stats(now, *args), now))
            now = transforms.trimmed(now, *args)
        elif name == "filter":
            bound.append(Bound(name, transforms.filter_stats(now, config.min_quality), now))
            now = transforms.quality_filter(now, config.min_quality)
        else:
            bound.append(Bound(name, read_stage(name, config.approximate)(now), now))
    return bound
