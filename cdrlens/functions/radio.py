"""Antenna pattern, path loss, line of sight and link budget.

Path loss follows 3GPP TR 38.901 (UMa, UMi, RMa). Every formula takes columns (``m=COL``) or arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from .geo import bearing_degrees, elevation_degrees, wrap_degrees
from .mathops import NP

#: Receiver height, shortest link, speed of light, and the antenna's pattern.
UT_HEIGHT_M = 1.5
MIN_DISTANCE_M = 10.0
LIGHT_M_S = 3.0e8
PATTERN_SLOPE, FRONT_TO_BACK_DB, VERTICAL_BEAM_DEG = 12.0, 30.0, 65.0
MAX_RANGE_M = 200_000.0


def antenna_attenuation_db(off_axis, elevation, beam_width, tilt, m=NP):
    """Loss against the beam's peak: horizontal and vertical part, each and together capped."""
    h, v = wrap_degrees(off_axis, m) / beam_width, (elevation - tilt) / VERTICAL_BEAM_DEG
    return m.least(m.least(PATTERN_SLOPE * h * h, FRONT_TO_BACK_DB) + m.least(PATTERN_SLOPE * v * v, FRONT_TO_BACK_DB), FRONT_TO_BACK_DB)


@dataclass(frozen=True)
class PropagationModel:
    """A path loss model: formulas of distance, heights and frequency, and where it holds."""

    name: str
    sigma_los_db: float
    sigma_nlos_db: float
    decorrelation_los_m: float
    decorrelation_nlos_m: float
    max_distance_m: float
    frequency_mhz: tuple[int, int]
    bs_height_m: tuple[float, float]
    ut_height_m: tuple[float, float]

    def los_db(self, d2, d3, bs, ut, ghz, m):
        raise NotImplementedError

    def nlos_db(self, d3, bs, ut, ghz, m):
        raise NotImplementedError

    def los_probability(self, d2, ut, m=NP):
        raise NotImplementedError

    def path_loss_db(self, d2, bs, ut, mhz, los: bool, m=NP):
        d2 = m.greatest(d2, MIN_DISTANCE_M)
        d3, ghz = m.hypot(d2, bs - ut), mhz / 1000.0
        direct = self.los_db(d2, d3, bs, ut, ghz, m)
        return direct if los else m.greatest(direct, self.nlos_db(d3, bs, ut, ghz, m))

    def mixed_db(self, d2, bs, ut, mhz, m=NP):
        """Mean of both cases, weighted by the probability of line of sight."""
        p = self.los_probability(d2, ut, m)
        return p * self.path_loss_db(d2, bs, ut, mhz, True, m) + (1 - p) * self.path_loss_db(d2, bs, ut, mhz, False, m)

    def outside(self, d2: float, bs: float, ut: float, mhz: int) -> str | None:
        """What of a link is outside the model's range of validity, if anything."""
        for what, x, (low, high) in (("distance", d2, (MIN_DISTANCE_M, self.max_distance_m)), ("frequency", mhz, self.frequency_mhz), ("antenna height", bs, self.bs_height_m), ("receiver height", ut, self.ut_height_m)):
            if not low <= x <= high:
                return f"{self.name}: {what} {x:g} is outside [{low:g}, {high:g}]"
        return None

    def sigma_db(self, los: bool) -> float:
        return self.sigma_los_db if los else self.sigma_nlos_db


def _two_slopes(d2, d3, bs, ut, ghz, intercept, near, far, coefficient, m):
    """Urban line of sight: one slope up to the break point, another beyond."""
    break_m = 4 * (bs - 1.0) * (ut - 1.0) * ghz * 1e9 / LIGHT_M_S
    base = intercept + 20 * m.log10(ghz)
    beyond = base + far * m.log10(d3) - coefficient * m.log10(break_m * break_m + (bs - ut) * (bs - ut))
    return m.where(d2 <= break_m, base + near * m.log10(d3), beyond)


def _mixing(d2, certain, decay, m):
    d = m.greatest(d2, MIN_DISTANCE_M)
    share = certain / d
    return m.where(d <= certain, 1.0, m.greatest(0.0, m.least(1.0, share + m.exp(-d / decay) * (1 - share))))


class _UMa(PropagationModel):
    def los_db(self, d2, d3, bs, ut, ghz, m):
        return _two_slopes(d2, d3, bs, ut, ghz, 28.0, 22.0, 40.0, 9.0, m)

    def nlos_db(self, d3, bs, ut, ghz, m):
        return 13.54 + 39.08 * m.log10(d3) + 20 * m.log10(ghz) - 0.6 * (ut - 1.5)

    def los_probability(self, d2, ut, m=NP):
        base = _mixing(d2, 18.0, 63.0, m)
        if ut <= 13.0:
            return base
        d = m.greatest(d2, MIN_DISTANCE_M)
        lift = ((ut - 13.0) / 10.0) ** 1.5 * 1.25
        return m.where(d <= 18.0, 1.0, m.least(1.0, base * (1 + lift * m.power(d / 100.0, 3) * m.exp(-d / 150.0))))


class _UMi(PropagationModel):
    def los_db(self, d2, d3, bs, ut, ghz, m):
        return _two_slopes(d2, d3, bs, ut, ghz, 32.4, 21.0, 40.0, 9.5, m)

    def nlos_db(self, d3, bs, ut, ghz, m):
        return 22.4 + 35.3 * m.log10(d3) + 21.3 * m.log10(ghz) - 0.3 * (ut - 1.5)

    def los_probability(self, d2, ut, m=NP):
        return _mixing(d2, 18.0, 36.0, m)


class _RMa(PropagationModel):
    BUILDING_M, STREET_M = 5.0, 20.0

    def _near(self, d3, ghz, m):
        h = self.BUILDING_M
        grown = h**1.72
        return 20 * m.log10(40 * math.pi / 3 * d3 * ghz) + min(0.03 * grown, 10.0) * m.log10(d3) - min(0.044 * grown, 14.77) + 0.002 * math.log10(h) * d3

    def los_db(self, d2, d3, bs, ut, ghz, m):
        break_m = 2 * math.pi * bs * ut * ghz * 1e9 / LIGHT_M_S
        return m.where(d2 <= break_m, self._near(d3, ghz, m), self._near(break_m, ghz, m) + 40 * m.log10(d3 / break_m))

    def nlos_db(self, d3, bs, ut, ghz, m):
        h, lg = self.BUILDING_M, m.log10(bs)
        ratio = h / bs
        return (
            161.04 - 7.1 * math.log10(self.STREET_M) + 7.5 * math.log10(h) - (24.37 - 3.7 * ratio * ratio) * lg
            + (43.42 - 3.1 * lg) * (m.log10(d3) - 3.0) + 20 * m.log10(ghz) - (3.2 * math.log10(11.75 * ut) ** 2 - 4.97)
        )

    def los_probability(self, d2, ut, m=NP):
        d = m.greatest(d2, MIN_DISTANCE_M)
        return m.where(d <= 10.0, 1.0, m.greatest(0.0, m.least(1.0, m.exp(-(d - 10.0) / 1000.0))))


MODELS: dict[str, PropagationModel] = {}


def register(model: PropagationModel) -> None:
    """Add a model under its name, which must be new."""
    if model is None or model.name in MODELS:
        raise ValueError("a model with a new name is needed")
    MODELS[model.name] = model


register(_UMa("UMa", 4.0, 6.0, 37.0, 50.0, 5_000.0, (500, 100_000), (25.0, 25.0), (1.5, 22.5)))
register(_UMi("UMi", 4.0, 7.82, 10.0, 13.0, 5_000.0, (500, 100_000), (10.0, 10.0), (1.5, 22.5)))
register(_RMa("RMa", 6.0, 8.0, 37.0, 120.0, 10_000.0, (500, 30_000), (10.0, 150.0), (1.0, 10.0)))


def model_named(name: str) -> PropagationModel:
    if name not in MODELS:
        raise ValueError(f"unknown propagation model {name!r}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name]


def received_power_dbm(model: PropagationModel, eirp, azimuth, beam_width, tilt, bs, mhz, dx, dy, ut=UT_HEIGHT_M, m=NP):
    """Power at a point dx east and dy north of the antenna."""
    d2 = m.hypot(dx, dy)
    off = m.where((dx == 0) & (dy == 0), 0.0, wrap_degrees(bearing_degrees(dx, dy, m) - azimuth, m))
    loss = antenna_attenuation_db(off, elevation_degrees(bs - ut, d2, m), beam_width, tilt, m)
    return eirp - model.mixed_db(d2, bs, ut, mhz, m) - loss


def coverage_range_m(model: PropagationModel, eirp: float, sensitivity: float, bs: float, mhz: int, beam_width: float, tilt: float, ut: float = UT_HEIGHT_M) -> float:
    """Distance on the beam's axis at which the power falls to the sensitivity (60 halvings, beyond the
    point the tilted beam hits)."""
    if not (sensitivity < 0 and 0 < ut < bs and mhz > 0 and beam_width > 0 and tilt >= 0 and math.isfinite(eirp)):
        raise ValueError("this link budget isn't physical")

    def power(d: float) -> float:
        loss = antenna_attenuation_db(0.0, elevation_degrees(bs - ut, d), beam_width, tilt)
        return float(eirp - model.mixed_db(d, bs, ut, mhz) - loss)

    peak = (bs - ut) / math.tan(math.radians(tilt)) if tilt > 0 else 0.0
    low = peak if 0 < peak < MAX_RANGE_M else 1.0
    high = MAX_RANGE_M
    if power(low) < sensitivity or power(high) >= sensitivity:
        raise ValueError("the sensitivity isn't crossed within the range searched")
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if power(middle) >= sensitivity else (low, middle)
    return (low + high) / 2
