"""Timing advance: the number of whole resolution steps between antenna and handset."""

from __future__ import annotations

import math

from .mathops import NP

#: Metres a step.
RESOLUTION_M = {"LTE": 78.12, "GSM": 550.0}


def resolution(technology: str) -> float:
    key = str(technology).strip().upper()
    if key not in RESOLUTION_M:
        raise ValueError(f"unknown technology {technology!r}; known: LTE, GSM")
    return RESOLUTION_M[key]


def from_distance(d, technology: str, m=NP):
    """The n with n * step <= d < (n + 1) * step, also where the division is a rounding off."""
    step = resolution(technology)
    n = m.floor(d / step)
    n = m.where((n > 0) & (d < n * step), n - 1, n)
    return m.where(d >= (n + 1) * step, n + 1, n)


def ring(value: int, technology: str) -> tuple[float, float]:
    """Inner (inclusive) and outer radius of a value's ring."""
    if value < 0:
        raise ValueError("a timing advance can't be negative")
    step = resolution(technology)
    return value * step, (value + 1) * step


def largest(range_m: float, technology: str) -> int:
    if not 0 <= range_m < math.inf:
        raise ValueError("the range must be finite and not negative")
    return math.floor(range_m / resolution(technology))
