"""Settings of a run: sections of one JSON file, with defaults for what is missing or null."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path
from typing import TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class SplitSettings:
    protocol: str = "lodo"
    min_domain_size: int = 50
    calib_frac: float = 0.1
    train_frac: float = 0.5
    temporal_calib_frac: float = 0.4
    iso_relax: float = 0.1
    iso_relax_calib: float = 0.6
    seed: int = 42

    def __post_init__(self):
        if self.protocol not in ("lodo", "temporal"):
            raise ValueError(f"unknown protocol {self.protocol!r}")
        for name in ("calib_frac", "train_frac", "temporal_calib_frac", "iso_relax", "iso_relax_calib"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")


@dataclass(frozen=True)
class ClusterSettings:
    similarity: float = 0.995
    bbox_tolerance: float = 0.02
    cosine_distance: float = 0.012
    min_samples: int = 6
    quantile: float = 0.12
    scale: float = 1.02
    k: int = 6
    max_fraction: float = 0.06
    max_size: int = 6000


@dataclass(frozen=True)
class RecallSettings:
    axis_tol_deg: float = 5.73
    axis_tol_hi_deg: float = 8.0
    iou: float = 0.7
    target_recall: float = 0.98


def section(path: str, name: str, kind: type[T]) -> T:
    """The settings of one section; unknown keys are ignored, null and missing ones take the default."""
    have = json.loads(Path(path).read_text()).get(name) or {}
    return kind(**{f.name: have[f.name] for f in fields(kind) if have.get(f.name) is not None})
