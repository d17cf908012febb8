"""Synthetic runs: sites and cells, agents, movement, radio, events and injected faults.

All randomness is a hash of (seed, purpose, agent, tick), so a run is one DataFrame over agents and ticks
that gives the same rows however it is partitioned. Sites, cells and agents are small; ticks are not.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, radio, timing
from ..functions.geo import HexLattice, Plane, bearing_degrees, elevation_degrees
from ..runtime import ship
from ..sources.config import Scenario

AZIMUTHS = (0.0, 120.0, 240.0)
MAX_EVENTS, ANCHOR_NOISE_M, PATH_NOISE_M, SPEED_JITTER = 16, 25.0, 60.0, 0.25
DEPART_WORK, DEPART_HOME, DEPART_JITTER, MIN_COMMUTE = 8 * 60, 18 * 60, 60, 10
SHIFT_US = -2 * 3600 * 1_000_000
EVENT_TYPES = ("MOC", "MTC", "SMS", "DATA")
#: Events an hour by hour of day, ten a day.
DIURNAL = (
    0.12, 0.08, 0.06, 0.05, 0.06, 0.10, 0.22, 0.45, 0.80, 0.75, 0.55, 0.50,
    0.50, 0.50, 0.45, 0.45, 0.50, 0.72, 0.80, 0.72, 0.58, 0.48, 0.36, 0.20,
)
_STREAM = {"place": 11, "move": 12, "events": 13, "faults": 14, "band": 15, "radio": 16}


@dataclass(frozen=True)
class RunSpec:
    run_id: str
    scenario: Scenario
    start_us: int
    salt: bytes

    @property
    def seed(self) -> int:
        return self.scenario.run.seed

    @property
    def plane(self) -> Plane:
        return Plane(self.scenario.area.origin_lat, self.scenario.area.origin_lon)


def _u(spec: RunSpec, stream: str, purpose: int, a, b):
    return identity.uniform(spec.seed, _STREAM[stream], purpose, np.asarray(a, np.int64), np.asarray(b, np.int64))


def site_lattice(radius_m: float, wanted: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Spacing and cells (by r, then q) of a lattice with ``wanted`` sites in a disk: the lattice's cells closest
    to its middle (of equals by r, then q), spread so that the farthest lies on the rim."""
    reach = math.isqrt(wanted) + 2
    q, r = (v.ravel() for v in np.meshgrid(np.arange(-2 * reach, 2 * reach + 1), np.arange(-2 * reach, 2 * reach + 1)))
    far = q * q + q * r + r * r  # the squared distance in spacings
    order = np.lexsort((q, r, far))[:wanted]
    q, r, widest = q[order], r[order], math.sqrt(far[order[-1]])
    order = np.lexsort((q, r))
    return radius_m / max(widest, 1.0), q[order], r[order]


def make_cells(spec: RunSpec) -> pd.DataFrame:
    """The run's cells: three sectors a site, bands by weight, range by the link budget."""
    s, p = spec.scenario, spec.scenario.profile
    low, high = s.network.sites_min, s.network.sites_max
    wanted = low + min(high - low, int(_u(spec, "place", 1, 0, 0) * (high - low + 1)))
    spacing, q, r = site_lattice(p.area_radius_km * 1000, wanted)
    x, y = HexLattice(spacing).centre(q, r)
    lon, lat = spec.plane.lonlat(x, y)
    edges = np.cumsum([w for _, w in p.freq_bands])
    model = radio.model_named(p.propagation_model)
    reach = {mhz: radio.coverage_range_m(model, p.eirp_dbm, s.network.rx_sensitivity_dbm, p.ant_height_m, mhz, p.beam_width_deg, p.tilt_deg) for mhz, _ in p.freq_bands}
    rows = []
    for i in range(len(q)):
        site = uuid.uuid5(uuid.UUID(spec.run_id), f"site {q[i]} {r[i]}")
        for k, azimuth in enumerate(AZIMUTHS):
            band = min(int(np.searchsorted(edges, float(_u(spec, "band", 1, i, k)))), len(edges) - 1)
            mhz = p.freq_bands[band][0]
            rows.append((spec.run_id, str(uuid.uuid5(site, f"sector {k}")), str(site), azimuth, float(p.beam_width_deg), float(p.eirp_dbm), float(p.ant_height_m), float(p.tilt_deg), min(reach[mhz], p.d_max_km * 1000.0), mhz, p.morphology, p.propagation_model, float(lat[i]), float(lon[i])))
    return pd.DataFrame(rows, columns="run_id cell_id site_id azimuth beam_width eirp_dbm ant_height tilt_deg r_max_m freq_mhz morphology model_type lat lon".split())


def make_agents(spec: RunSpec) -> pd.DataFrame:
    """Homes spread evenly over the disk, works at a distance within the profile's bounds (tried up to a
    hundred times to stay inside), and personal hours."""
    s, p = spec.scenario, spec.scenario.profile
    n, radius = s.simulation.agents, p.area_radius_km * 1000
    a = np.arange(n)
    rho, phi = radius * np.sqrt(_u(spec, "place", 2, a, 0)), 2 * np.pi * _u(spec, "place", 3, a, 0)
    hx, hy = rho * np.cos(phi), rho * np.sin(phi)
    wx, wy, open_ = hx.copy(), hy.copy(), np.ones(n, bool)
    near, far = (min(k * 1000, 2 * radius) for k in p.home_work_km)
    for t in range(100):
        d = np.sqrt(near**2 + (far**2 - near**2) * _u(spec, "place", 4, a, t))
        turn = 2 * np.pi * _u(spec, "place", 5, a, t)
        x, y = hx + d * np.cos(turn), hy + d * np.sin(turn)
        ok = open_ & (np.hypot(x, y) <= radius)
        wx, wy, open_ = np.where(ok, x, wx), np.where(ok, y, wy), open_ & ~ok
    commute = np.maximum(MIN_COMMUTE, np.round(np.hypot(wx - hx, wy - hy) / 1000 / p.commute_kmh * 60)).astype(int)
    out = np.clip(DEPART_WORK + np.round((2 * _u(spec, "place", 6, a, 0) - 1) * DEPART_JITTER).astype(int), 0, 1439)
    back = np.clip(DEPART_HOME + np.round((2 * _u(spec, "place", 7, a, 0) - 1) * DEPART_JITTER).astype(int), 0, 1439)
    back = np.maximum(back, np.minimum(out + commute + MIN_COMMUTE + 1, 1439))
    back = np.where(back + commute >= 1440, 1439 - commute, back)
    return pd.DataFrame({"agent_id": a, "hx": hx, "hy": hy, "wx": wx, "wy": wy, "commute": commute, "out": out, "back": back})


def positions(spec: RunSpec, agents: pd.DataFrame, agent: np.ndarray, tick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where agents are in ticks: at home, at work, or on the way with a wavering speed and path."""
    row = agents.iloc[agent]
    minute = tick * spec.scenario.simulation.tick_minutes
    weekend, t = minute // 1440 % 7 >= 5, minute % 1440
    out, back, commute = row["out"].to_numpy(), row["back"].to_numpy(), row["commute"].to_numpy()
    going = ~weekend & (t >= out) & (t < out + commute)
    working = ~weekend & (t >= out + commute) & (t < back)
    coming = ~weekend & ~going & ~working & (t >= back) & (t < back + commute)
    elapsed = np.where(going, t - out, t - back)
    wander = 1 + (2 * _u(spec, "move", 1, agent, tick) - 1) * SPEED_JITTER
    done = np.where(going | coming, np.clip(np.clip(elapsed / commute, 0, 1) * wander, 0, 1), 0.0)
    done = np.where(working, 1.0, np.where(coming, 1 - done, done))
    moving = going | coming
    noise = np.where(moving, PATH_NOISE_M * 4 * done * (1 - done), ANCHOR_NOISE_M)
    x = row["hx"].to_numpy() + (row["wx"] - row["hx"]).to_numpy() * done + (2 * _u(spec, "move", 2, agent, tick) - 1) * noise
    y = row["hy"].to_numpy() + (row["wy"] - row["hy"]).to_numpy() * done + (2 * _u(spec, "move", 3, agent, tick) - 1) * noise
    return x, y


def event_counts(spec: RunSpec, agent: np.ndarray, tick: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion of one uniform number, 16 at most."""
    minutes = spec.scenario.simulation.tick_minutes
    lam = np.array(DIURNAL)[tick * minutes % 1440 // 60] * minutes / 60
    u = _u(spec, "events", 1, agent, tick)
    p, k = np.exp(-lam), np.zeros(len(lam), int)
    total = p.copy()
    for n in range(1, MAX_EVENTS + 1):
        more = u > total
        k = np.where(more, n, k)
        p = p * lam / n
        total = total + p
    return k


def best_servers(spec: RunSpec, cells: pd.DataFrame, x: np.ndarray, y: np.ndarray):
    """Strongest cell at each place under shadowing that is the same for a site's sectors and for places
    close together; the first in order of equals. Only cells that reach the place are tried."""
    site_keys = {s: i for i, s in enumerate(dict.fromkeys(cells["site_id"]))}
    best, power, far, ground = np.full(len(x), -1), np.full(len(x), -np.inf), np.zeros(len(x)), spec.plane
    cx, cy = ground.x(cells["lon"].to_numpy()), ground.y(cells["lat"].to_numpy())
    for site, members in cells.groupby("site_id", sort=False).indices.items():
        first = members[0]
        dx, dy = x - cx[first], y - cy[first]
        d = np.hypot(dx, dy)
        near = np.nonzero(d <= cells["r_max_m"].to_numpy()[members].max())[0]
        if not len(near):
            continue
        c = cells.iloc[first]
        model, bs = radio.model_named(c["model_type"]), c["ant_height"]
        side = model.decorrelation_nlos_m
        h = identity.chain(np.uint64(spec.seed), np.uint64(_STREAM["radio"]), site_keys[site], np.floor(x[near] / side).astype(np.int64), np.floor(y[near] / side).astype(np.int64))
        los = identity.open_unit(identity.chain(h, 1)) < model.los_probability(d[near], radio.UT_HEIGHT_M)
        sigma = np.where(los, model.sigma_los_db, model.sigma_nlos_db)
        shadow = sigma * np.clip(identity.standard_normal(identity.chain(h, 2)), -8, 8)
        bearing, elevation = bearing_degrees(dx[near], dy[near]), elevation_degrees(bs - radio.UT_HEIGHT_M, d[near])
        for m in members:
            c = cells.iloc[m]
            loss = np.where(los, model.path_loss_db(d[near], bs, radio.UT_HEIGHT_M, c["freq_mhz"], True), model.path_loss_db(d[near], bs, radio.UT_HEIGHT_M, c["freq_mhz"], False))
            beam = radio.antenna_attenuation_db(bearing - c["azimuth"], elevation, c["beam_width"], c["tilt_deg"])
            rx = np.where(d[near] <= c["r_max_m"], c["eirp_dbm"] - loss - beam + shadow, -np.inf)
            better = rx > power[near]
            at = near[better]
            best[at], power[at], far[at] = m, rx[better], d[near][better]
    return best, power, far


def trajectories(spark: SparkSession, spec: RunSpec, agents: pd.DataFrame) -> DataFrame:
    """``agent_id, tick, x, y, events``: where each agent is in each tick, and how many events it has."""
    ship(spark)
    s = spec.scenario.simulation
    n, ticks = s.agents, s.duration_days * 1440 // s.tick_minutes

    def work(frames):
        for f in frames:
            agent, tick = f["id"].to_numpy() % n, f["id"].to_numpy() // n
            x, y = positions(spec, agents, agent, tick)
            yield pd.DataFrame({"agent_id": agent, "tick": tick, "x": x, "y": y, "events": event_counts(spec, agent, tick)})

    return spark.range(0, ticks * n).mapInPandas(work, "agent_id long, tick long, x double, y double, events long")


def unknown_cell(event: Column) -> Column:
    """The id of a cell that no inventory has, one an event."""
    return identity.uuid5(str(uuid.uuid5(uuid.NAMESPACE_OID, "cdrlens/unknown-cell")), F.unhex(F.regexp_replace(event, "-", "")))


_MADE = "agent_id int, tick long, seq int, lat double, lon double, covered boolean, cell_id string, ta_value int, event_type string, fault int, swapped_agent long, wrong_cell string"


def make_events(spark: SparkSession, spec: RunSpec, cells: pd.DataFrame, agents: pd.DataFrame) -> DataFrame:
    """One row an event, with its true place, serving cell and injected fault.

    Cells and agents go to the workers with the function: their numbers are parameters of the scenario
    (hundreds, thousands) and don't grow with the ticks.
    """
    ship(spark)
    s = spec.scenario
    ticks = s.simulation.duration_days * 1440 // s.simulation.tick_minutes
    n = s.simulation.agents
    weights = np.array([{int(k): v for k, v in s.integrity.rule_weights.items()}[r] for r in range(1, 6)], float)
    edges = np.cumsum(weights) / weights.sum()
    order = cells.sort_values(["lon", "lat"], kind="stable")
    ox, oy = spec.plane.x(order["lon"].to_numpy()), spec.plane.y(order["lat"].to_numpy())
    names = cells["cell_id"].to_numpy()

    def work(frames):
        for f in frames:
            flat = f["id"].to_numpy()
            agent, tick = flat % n, flat // n
            k = event_counts(spec, agent, tick)
            some = k > 0
            agent, tick, k = agent[some], tick[some], k[some]
            if not len(agent):
                continue
            x, y = positions(spec, agents, agent, tick)
            best, power, far = best_servers(spec, cells, x, y)
            lon, lat = spec.plane.lonlat(x, y)
            covered = power >= s.network.rx_sensitivity_dbm
            ta = timing.from_distance(far, s.timing_advance.technology).astype(int) if s.timing_advance.enabled else np.zeros(len(far), int)
            rep = np.repeat(np.arange(len(k)), k)
            seq = np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
            slot = tick[rep] * MAX_EVENTS + seq
            kind = np.minimum((_u(spec, "events", 2, agent[rep], slot) * 4).astype(int), 3)
            hit = covered[rep] & (_u(spec, "faults", 1, agent[rep], slot) < s.integrity.injection_rate)
            rule = np.where(hit, np.minimum(np.searchsorted(edges, _u(spec, "faults", 2, agent[rep], slot), "right"), 4) + 1, 0)
            other = agent[rep] + 1 + (_u(spec, "faults", 3, agent[rep], slot) * 999).astype(int)
            wrong = np.full(len(rep), None, object)
            for i in np.nonzero(rule == 2)[0]:
                c = cells.iloc[best[rep[i]]]
                wrong[i] = order["cell_id"].iloc[int(np.argmax(np.hypot(ox - spec.plane.x(c["lon"]), oy - spec.plane.y(c["lat"]))))]
            yield pd.DataFrame({
                "agent_id": agent[rep].astype("int32"), "tick": tick[rep], "seq": seq.astype("int32"), "lat": lat[rep], "lon": lon[rep], "covered": covered[rep],
                "cell_id": np.where(covered[rep], names[np.maximum(best[rep], 0)], None), "ta_value": pd.array(np.where(covered[rep] & s.timing_advance.enabled, ta[rep], -1), "Int32").astype("Int32"),
                "event_type": np.array(EVENT_TYPES)[kind], "fault": pd.array(rule, "Int32"), "swapped_agent": other, "wrong_cell": wrong,
            })

    made = spark.range(0, ticks * n).mapInPandas(work, _MADE)
    event = identity.event_id(F.lit(spec.run_id), F.col("agent_id"), F.col("tick"), F.col("seq"))
    at = F.lit(spec.start_us) + F.col("tick") * (s.simulation.tick_minutes * 60_000_000)
    return made.withColumn("event_id", event).withColumn("time_us", at).withColumn("fault", F.nullif("fault", F.lit(0))).withColumn("ta_value", F.when(F.col("ta_value") >= 0, F.col("ta_value")))


def truth_of(events: DataFrame, spec: RunSpec) -> DataFrame:
    """Ground truth of all events, also of those that leave no record."""
    key = identity.partition_key(F.col("event_id"), spec.seed, spec.scenario.calibration.split_ratio)
    return events.select(F.lit(spec.run_id).alias("run_id"), "event_id", "time_us", "agent_id", "lat", "lon", "covered", key.alias("partition_key"), F.col("fault").alias("injected_rule"))


def records_of(events: DataFrame, spec: RunSpec) -> DataFrame:
    """Call records of covered events, with the faults in them: an unknown cell, the farthest cell, a time
    two hours early, a missing record, another's device. seq is the order of sending."""
    fault = F.coalesce("fault", F.lit(0))
    device = identity.device_number(F.when(fault == 5, F.col("swapped_agent")).otherwise(F.col("agent_id")))
    cell = F.when(fault == 1, unknown_cell(F.col("event_id"))).when(fault == 2, F.col("wrong_cell")).otherwise(F.col("cell_id"))
    order = (F.col("tick") * spec.scenario.simulation.agents + F.col("agent_id")) * MAX_EVENTS + F.col("seq")
    return events.filter(F.col("covered") & (fault != 4)).select(
        F.lit(spec.run_id).alias("run_id"), "event_id", order.alias("seq"), F.when(fault == 3, F.col("time_us") + SHIFT_US).otherwise(F.col("time_us")).alias("time_us"),
        identity.pseudonym(identity.subscriber_number(F.col("agent_id")), spec.salt).alias("subscriber"), identity.pseudonym(device, spec.salt).alias("device"),
        "event_type", cell.alias("cell_id"), "ta_value", F.lit(spec.scenario.run.scenario).alias("scenario"),
    )


def uncovered_share(events: DataFrame) -> DataFrame:
    """Share of events without coverage, and whether it passes five in a hundred."""
    share = F.avg((~F.col("covered")).cast("int"))
    return events.agg(share.alias("uncovered_share"), (share > 0.05).alias("warn"))


def generate(spark: SparkSession, spec: RunSpec) -> dict[str, DataFrame]:
    """A run's tables: cells, records, truth."""
    cells, agents = make_cells(spec), make_agents(spec)
    events = make_events(spark, spec, cells, agents)
    return {"cells": spark.createDataFrame(cells), "truth": truth_of(events, spec), "records": records_of(events, spec), "events": events}
