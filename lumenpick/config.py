"""Named settings: scoring modes, picking thresholds, analysis presets."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

# Weights, limits and texts that results depend on.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
OUTPUT_FOLDERS = ("01_SELECTED", "02_REVIEW", "03_REJECTED", "04_REPORT")
STATUS_FOLDERS = {"selected": "01_SELECTED", "review": "02_REVIEW", "rejected": "03_REJECTED", "error": "04_REPORT/errors"}
DECISION_ROOT = "02_FINAL_DECISION"
DECISION_FOLDERS = {"post": "Posts", "save": "Save", "delete": "Delete", "undecided": "Undecided"}
DECISIONS = ("post", "save", "delete", "undecided")
NEUTRAL = 0.45
PICK_LIMITS = {"conservative": (0.55, 0.35, 0.12), "balanced": (0.65, 0.45, 0.08), "aggressive": (0.75, 0.55, 0.03)}
PENALTY_WEIGHTS = {"conservative": (0.10, 0.14), "aggressive": (0.22, 0.28)}
DEFAULT_PENALTY_WEIGHTS = (0.15, 0.20)
HASH_THRESHOLD = 8


def pick_limits(mode: str) -> tuple[float, float, float]:
    """Selection and review score and the gap that counts as close; unknown modes are balanced."""
    return PICK_LIMITS.get(mode, PICK_LIMITS["balanced"])


def kept_per_cluster(mode: str) -> int:
    return 3 if mode == "conservative" else 1


def score_mode(performance_mode: str) -> str:
    """The scoring mode that a performance mode implies."""
    return performance_mode if performance_mode in ("balanced", "accurate") else "conservative"


@dataclass(frozen=True)
class Preset:
    mode: str = "balanced"
    max_analysis_size: int = 1600
    face_analysis: bool = True
    body_analysis: bool = True
    copy_files: bool = True
    workers: int | str = "auto"
    cache_version: str = "1"
    scoring_version: str = "1"

    def but(self, **changes) -> Preset:
        return replace(self, **changes)


PRESETS = {
    "fast": Preset("fast", 1024, body_analysis=False, copy_files=False),
    "balanced": Preset(),
    "accurate": Preset("accurate", 2400),
}


def preset(mode: str | None) -> Preset:
    return PRESETS.get(mode or "", PRESETS["balanced"])


def resolve_workers(wanted: int | str | None, mode: str, cpus: int | None = None) -> int:
    """Tasks to run at once: a number as given, at least one, or for auto one less than the processors up to a cap."""
    cap = 2 if mode == "accurate" else 4
    if wanted is None or str(wanted).lower() == "auto":
        return max(1, min((cpus or os.cpu_count() or 1) - 1, cap))
    try:
        return max(1, min(int(wanted), cap))
    except (TypeError, ValueError):
        return 1
