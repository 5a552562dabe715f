"""Settings of a scan, checked when they are made; none of them is ever a column."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Names of the review buckets, best first.
LIKELY, REVIEW, BACKGROUND = "Likely Forced Text", "Needs Review", "Less Likely"
BUCKETS = (LIKELY, REVIEW, BACKGROUND)

DEFAULT_STEP = 23
DIALOGUE_INTERVAL = 2.0
QUIET_INTERVAL = 0.5


@dataclass(frozen=True)
class Mode:
    """How often frames are sampled: every step-th one, or one in interval seconds."""

    name: str
    step: int | None = None
    interval: float | None = None

    def seconds(self, rate: float | None = None) -> float:
        """The time between samples; without a frame rate a step counts as half a second."""
        if self.interval is not None:
            return self.interval
        return self.step / rate if self.step and rate else 0.5


def mode(name: str = "default", step: float | None = None, interval: float | None = None) -> Mode:
    """The mode of a name; a custom one needs a positive whole step or a positive interval, not both."""
    key = name.strip().lower().replace("-", "_")
    if key == "custom":
        if (step is None) == (interval is None):
            raise ValueError("a custom mode takes either a step or an interval")
        if step is not None:
            if isinstance(step, bool) or step != int(step) or step < 1:
                raise ValueError("a step must be a positive whole number")
            return Mode("custom", step=int(step))
        if not math.isfinite(interval) or interval <= 0:
            raise ValueError("an interval must be positive")
        return Mode("custom", interval=float(interval))
    if key == "default":
        return Mode(key, step=DEFAULT_STEP)
    if key in ("advanced", "every_frame", "thorough"):
        return Mode("advanced", step=1)
    if key in ("adaptive", "standard", "fast"):
        return Mode("adaptive", interval=1.0)
    raise ValueError(f"unknown mode: {name}")


def share(value: float, what: str) -> float:
    if not math.isfinite(value) or not 0 <= value <= 1:
        raise ValueError(f"{what} must be between 0 and 1")
    return float(value)


def gap_length(value: float) -> float:
    if not math.isfinite(value) or value < 0:
        raise ValueError("the least gap must be finite and not negative")
    return float(value)


def scan_range(start: float | None, end: float | None, duration: float | None) -> tuple[float, float | None]:
    """The range that is scanned; without a known duration the end may stay open."""
    low = max(0.0, start or 0.0)
    if duration and low >= duration:
        raise ValueError("the start lies after the end of the source")
    high = min(end, duration) if end is not None and duration else (end if end is not None else duration or None)
    if high is not None and high <= low:
        raise ValueError("the end must come after the start")
    return low, high


@dataclass(frozen=True)
class Tracking:
    """When a detection continues an event."""

    similarity: float = 86.0
    centre: float = 0.12
    iou: float = 0.08
    max_gap: float = 1.5

    @staticmethod
    def of_interval(interval: float = 0.5) -> Tracking:
        return Tracking(max_gap=max(1.25, 2.5 * interval))

    @staticmethod
    def of_scan(interval: float, adaptive_with_captions: bool = False) -> Tracking:
        return Tracking(max_gap=max(1.25, 1.4 * max(interval, DIALOGUE_INTERVAL if adaptive_with_captions else 0.0)))


def moment_tolerance(interval: float) -> float:
    return max(0.08, min(0.25, 0.15 * interval))


@dataclass(frozen=True)
class Scan:
    """The settings of ranked_moments."""

    mode: Mode = Mode("default", step=DEFAULT_STEP)
    floor: float = 0.0
    breadth: float = 0.5
    gap: float = 1.0
    padding: float = 0.15
    merge_slack: float = 0.05
    start: float = 0.0
    end: float | None = None
    reuse: bool = True
    tiled: bool = False

    def __post_init__(self):
        share(self.floor, "the confidence floor")
        share(self.breadth, "the review breadth")
        gap_length(self.gap)

    @property
    def reuses(self) -> bool:
        return self.reuse and self.mode.step != 1 and not self.tiled
