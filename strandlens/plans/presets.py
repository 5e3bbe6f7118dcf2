"""Named parameter sets for common tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from strandlens.operators.reads import filter_reads, filter_trim

# Presets by kind of task.
PRESETS: dict[str, dict[str, dict[str, Any]]] = {
    "filter_reads": {
        "strict_qc": {"min_len": 1000, "min_qual": 10},
        "lenient_qc": {"min_len": 200, "min_qual": 7},
    },
    "filter_trim": {
        "aggressive_trim": {"headcrop": 50, "tailcrop": 50, "minlength": 500},
        "qual_trim": {"quality": 12, "cutoff": 10, "trim_approach": "trim-by-quality"},
        "inverse_short_reads": {"minlength": 1000, "inverse": True},
    },
    "alignment_report": {
        "with_hist_scaled": {"include_hist": True, "scaled": True},
        "with_flags_and_mapq": {"include_hist": True, "include_mapq": True, "include_flags": True},
    },
    "coverage_tables": {
        "window_1kb": {"window": 1000},
        "fast_quantized": {"fast_mode": True, "quantize": "0:1:10:30:100:"},
    },
}

_FILTERS: dict[str, Callable[..., DataFrame]] = {"filter_reads": filter_reads, "filter_trim": filter_trim}


def preset(task: str, name: str) -> dict[str, Any]:
    """Parameters of a preset, to be passed on as keyword arguments."""
    try:
        return dict(PRESETS[task][name])
    except KeyError:
        known = {t: sorted(p) for t, p in PRESETS.items()}
        raise ValueError(f"No preset {name!r} for {task!r}; there are {known}") from None


def apply_read_preset(reads: DataFrame, name: str) -> DataFrame:
    """Reads through the filter or trimming preset of that name."""
    for task, operator in _FILTERS.items():
        if name in PRESETS[task]:
            return operator(reads, **preset(task, name))
    raise ValueError(f"No read preset {name!r}")
