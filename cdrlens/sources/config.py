"""Scenario files: strict YAML or JSON, profile defaults, and validation of every value."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

from ..functions.timing import RESOLUTION_M


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Profile:
    """What a morphology fixes unless a scenario overrides it."""

    morphology: str
    area_radius_km: float
    inter_site_distance_m: float
    propagation_model: str
    ant_height_m: float
    freq_bands: tuple
    home_work_km: tuple[float, float]
    commute_kmh: float
    d_max_km: float
    beam_width_deg: float
    tilt_deg: float
    eirp_dbm: float
    r_max_m: float


#: The two built-in morphologies.
PROFILES = {
    "urban": Profile("urban", 5, 500, "UMa", 25, ((1800, 0.30), (2100, 0.40), (2600, 0.30)), (1, 8), 30, 5, 65, 6, 58, 5000),
    "rural": Profile("rural", 20, 2000, "RMa", 45, ((800, 0.50), (900, 0.35), (1800, 0.15)), (5, 25), 70, 10, 65, 3, 62, 20000),
}


@dataclass
class Run:
    scenario: str = ""
    name: str = ""
    seed: int = 0


@dataclass
class Area:
    origin_lat: float = 0.0
    origin_lon: float = 0.0
    radius_km: float = 0.0


@dataclass
class Simulation:
    agents: int = 0
    duration_days: int = 0
    tick_minutes: int = 0


@dataclass
class Network:
    sites_min: int = 0
    sites_max: int = 0
    rx_sensitivity_dbm: float = 0.0
    inter_site_distance_m: float | None = None
    ant_height_m: float | None = None
    propagation_model: str | None = None
    freq_bands: list | None = None
    beam_width_deg: float | None = None
    tilt_deg: float | None = None
    eirp_dbm: float | None = None
    r_max_m: float | None = None


@dataclass
class Radio:
    shadowing_sigma_db: float = 0.0
    d_max_km: float = 0.0


@dataclass
class TimingAdvance:
    enabled: bool = False
    technology: str = ""


@dataclass
class Sample:
    calibration_events: int = 0
    validation_events: int = 0


@dataclass
class Analysis:
    grid_resolution_m: float = 0.0
    contour_levels: list = field(default_factory=list)
    neighbor_max_count: int = 0
    sample: Sample = field(default_factory=Sample)


@dataclass
class Calibration:
    split_ratio: float = 0.0
    lambda_min: float = 0.0
    lambda_max: float = 0.0
    target_coverage: float = 0.0
    tolerance: float = 0.0
    max_iterations: int = 0


@dataclass
class Detection:
    velocity_margin_cap: float = 0.0
    time_backstep_tolerance_s: float = 0.0
    activity_min_support: int = 0
    min_findings_for_threshold: int = 0


@dataclass
class Integrity:
    max_velocity_kmh: float = 0.0
    injection_rate: float = 0.0
    rule_weights: dict = field(default_factory=dict)
    detection: Detection = field(default_factory=Detection)


@dataclass
class Privacy:
    k_anonymity: int = 0
    hmac_salt_env: str = ""


@dataclass
class Api:
    max_geometries_per_request: int = 0


@dataclass
class Scenario:
    run: Run = field(default_factory=Run)
    morphology: str = ""
    area: Area = field(default_factory=Area)
    simulation: Simulation = field(default_factory=Simulation)
    network: Network = field(default_factory=Network)
    radio: Radio = field(default_factory=Radio)
    timing_advance: TimingAdvance = field(default_factory=TimingAdvance)
    analysis: Analysis = field(default_factory=Analysis)
    calibration: Calibration = field(default_factory=Calibration)
    integrity: Integrity = field(default_factory=Integrity)
    privacy: Privacy = field(default_factory=Privacy)
    api: Api = field(default_factory=Api)

    @property
    def profile(self) -> Profile:
        """The morphology's profile with the scenario's overrides."""
        if self.morphology not in PROFILES:
            raise ConfigError(f"unknown morphology {self.morphology!r}")
        changes: dict[str, Any] = {k: getattr(self.network, k) for k in ("inter_site_distance_m", "ant_height_m", "propagation_model", "beam_width_deg", "tilt_deg", "eirp_dbm", "r_max_m")}
        changes |= {"area_radius_km": self.area.radius_km or None, "d_max_km": self.radio.d_max_km or None}
        if self.network.freq_bands:
            changes["freq_bands"] = tuple((b["mhz"], b["weight"]) for b in self.network.freq_bands)
        return dataclasses.replace(PROFILES[self.morphology], **{k: v for k, v in changes.items() if v is not None})


def _fill(kind, data: Any, where: str):
    if not isinstance(data, dict):
        raise ConfigError(f"{where or 'the file'} must be a mapping")
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(data) - set(fields):
        raise ConfigError(f"unknown key {where}{sorted(map(str, unknown))[0]}")
    out = kind()
    for key, value in data.items():
        old = getattr(out, key)
        setattr(out, key, _fill(type(old), value, f"{where}{key}.") if dataclasses.is_dataclass(old) else value)
    return out


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def validate(s: Scenario) -> Scenario:
    p = s.profile
    _need(s.run.scenario in ("A", "B", "C", "D"), "run.scenario must be A, B, C or D")
    _need(bool(s.run.name), "run.name is empty")
    _need(p.propagation_model in ("UMa", "UMi", "RMa"), "network.propagation_model is unknown")
    for name in ("area_radius_km", "inter_site_distance_m", "ant_height_m", "commute_kmh", "d_max_km", "beam_width_deg", "r_max_m"):
        _need(getattr(p, name) > 0, f"{name} must be positive")
    _need(p.beam_width_deg <= 360 and 0 <= p.tilt_deg < 90, "beam width must be in (0, 360], tilt in [0, 90)")
    _need(all(m > 0 and w > 0 for m, w in p.freq_bands) and abs(sum(w for _, w in p.freq_bands) - 1) <= 1e-9, "band weights must be positive and sum to 1")
    _need(-90 <= s.area.origin_lat <= 90 and -180 <= s.area.origin_lon <= 180, "area.origin is no place")
    _need(min(s.simulation.agents, s.simulation.duration_days, s.simulation.tick_minutes) > 0, "simulation values must be positive")
    _need(1440 % s.simulation.tick_minutes == 0, "simulation.tick_minutes must divide a day")
    _need(0 < s.network.sites_min <= s.network.sites_max, "network.sites_min and sites_max are wrong")
    _need(s.network.rx_sensitivity_dbm < 0 < s.radio.shadowing_sigma_db, "sensitivity must be negative, sigma positive")
    _need(not s.timing_advance.enabled or s.timing_advance.technology in RESOLUTION_M, "timing_advance.technology must be LTE or GSM")
    _need(s.analysis.grid_resolution_m > 0 and s.analysis.neighbor_max_count > 0, "analysis values must be positive")
    _need(bool(s.analysis.contour_levels) and all(0 < c < 1 for c in s.analysis.contour_levels), "contour levels must be in (0, 1)")
    _need(s.analysis.sample.calibration_events > 0 and s.analysis.sample.validation_events >= 0, "sample sizes are wrong")
    c = s.calibration
    _need(0 < c.split_ratio < 1 and 0 < c.lambda_min < c.lambda_max and 0 < c.target_coverage < 1 and c.tolerance > 0 and c.max_iterations > 0, "calibration values are wrong")
    i = s.integrity
    _need(i.max_velocity_kmh > 0 and 0 <= i.injection_rate < 1, "integrity values are wrong")
    weights = {int(k): v for k, v in i.rule_weights.items()}
    _need(set(weights) == {1, 2, 3, 4, 5} and min(weights.values()) >= 0 and sum(weights.values()) > 0, "rule_weights must name rules 1 to 5, none negative")
    d = i.detection
    d.velocity_margin_cap, d.activity_min_support = d.velocity_margin_cap or 1e6, d.activity_min_support or 2
    d.min_findings_for_threshold = d.min_findings_for_threshold or 30
    _need(d.velocity_margin_cap >= 1 and d.time_backstep_tolerance_s >= 0 and d.activity_min_support >= 1 and d.min_findings_for_threshold >= 1, "detection values are wrong")
    _need(s.privacy.k_anonymity >= 1 and bool(s.privacy.hmac_salt_env), "privacy values are wrong")
    _need(s.api.max_geometries_per_request > 0, "api.max_geometries_per_request must be positive")
    return s


def parse(text: str) -> Scenario:
    """A validated scenario from YAML (where a YAML reader is installed) or JSON."""
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        data = yaml.safe_load(text) if yaml else json.loads(text)
    except Exception as e:
        raise ConfigError(f"the scenario can't be read: {e}") from e
    return validate(_fill(Scenario, data, ""))


def load(path: str) -> Scenario:
    with open(path) as f:
        return parse(f.read())
