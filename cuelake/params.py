"""Operator parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class VadParams:
    """Milliseconds, but for the threshold; ``max_absorb_gap`` None reaches without limit."""

    threshold: float = 0.5
    min_silence: int = 700
    min_speech: int = 1000
    max_absorb_gap: int | None = 3000
    max_chunk: int = 30_000


@dataclass(frozen=True)
class CueParams:
    """Reading-speed limits; None switches a trigger off."""

    cps_threshold: float | None = 15.0
    max_duration: float | None = 7.0
    min_duration: float | None = None
    max_chars: int | None = 40
    gap: float = 0.08


@dataclass(frozen=True)
class FilterParams:
    dedup_repeated: bool = False
    strip_repetition: bool = False
    max_failures: int = 5


def unlimited_if_negative(gap: int | None) -> int | None:
    return None if gap is not None and gap < 0 else gap
