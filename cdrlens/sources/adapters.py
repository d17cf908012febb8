"""Call-record tables derived from the star-schema tables, as SQL that Spark and DuckDB both run.

Only whole numbers, digests and elementary functions are used, so both engines agree on every row. Each
text names its inputs in braces; ``{sha}`` and ``{us}`` are the engine's words for SHA-256 in hex and for
microseconds of a timestamp.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

#: The area's origin, sites to a row of the map, and the injections' time shift.
ORIGIN_LAT, ORIGIN_LON = 38.0, 39.0
SHIFT_US = -24 * 3600 * 1_000_000
SPEED_KMH = 2.0

CELLS = """
SELECT concat('run-', r.run) AS run_id, s.s_suppkey * 10 + k.k AS cell_id, s.s_suppkey AS site_id,
  CAST(k.k * 120 AS DOUBLE) AS azimuth, CAST(65 AS DOUBLE) AS beam_width, CAST(58 AS DOUBLE) AS eirp_dbm,
  CAST(25 AS DOUBLE) AS ant_height, CAST(6 AS DOUBLE) AS tilt_deg,
  CAST(1000 + (s.s_suppkey % 5) * 250 AS DOUBLE) AS r_max_m,
  CAST(1800 + (s.s_suppkey % 3) * 400 AS INT) AS freq_mhz, 'urban' AS morphology, 'UMa' AS model_type,
  CAST(38 AS DOUBLE) + CAST(s.s_suppkey % 40 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
  CAST(39 AS DOUBLE) + CAST((s.s_suppkey * 7) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon
FROM {supplier} s, (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) k,
  (SELECT 'A' AS run UNION ALL SELECT 'B' AS run UNION ALL SELECT 'C' AS run UNION ALL SELECT 'D' AS run) r
"""

_BASE = """
SELECT e.event_id, {us} AS t, e.user_id, e.event_id % 50 AS slot, e.event_type,
  CASE e.user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS scenario,
  (e.user_id + e.event_id % 3) % n.n + 1 AS site, n.n AS sites, e.event_id % 3 AS sector
FROM {events} e, (SELECT count(*) AS n FROM {supplier}) n
"""

RECORDS = (
    "SELECT concat('run-', scenario) AS run_id, event_id, event_id AS seq, CASE WHEN slot = 3 THEN t + (" + str(SHIFT_US) + """) ELSE t END AS time_us,
  {sha_user} AS subscriber, {sha_device} AS device,
  CASE event_id % 5 WHEN 0 THEN 'MOC' WHEN 1 THEN 'MTC' WHEN 2 THEN 'SMS' ELSE 'DATA' END AS event_type,
  CASE slot WHEN 1 THEN -event_id - 1 WHEN 2 THEN ((site + CAST(floor(CAST(sites AS DOUBLE) / CAST(2 AS DOUBLE)) AS BIGINT)) % sites + 1) * 10 + sector ELSE site * 10 + sector END AS cell_id,
  CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 4 END AS INT) AS ta_value, scenario
FROM ("""
    + _BASE
    + ") b WHERE slot <> 4"
)

TRUTH = (
    """
SELECT concat('run-', scenario) AS run_id, event_id, t AS time_us, CAST(user_id AS INT) AS agent_id,
  CAST(38 AS DOUBLE) + CAST(site % 40 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(event_id % 19 AS DOUBLE) / CAST(2000 AS DOUBLE) AS lat,
  CAST(39 AS DOUBLE) + CAST((site * 7) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(event_id % 13 AS DOUBLE) / CAST(1500 AS DOUBLE) AS lon,
  event_id % 11 <> 5 AS covered, CASE WHEN event_id % 5 = 4 THEN 'V' ELSE 'C' END AS partition_key,
  CAST(CASE WHEN slot BETWEEN 1 AND 5 THEN slot ELSE NULL END AS INT) AS injected_rule
FROM ("""
    + _BASE
    + ") b"
)

#: Closed-form estimates: disks around the cell's site, smaller with the method and level.
ESTIMATES = """
SELECT r.run_id, r.event_id, r.time_us, r.scenario, m.method, m.confidence,
  c.lat + m.north AS centroid_lat, c.lon + m.east AS centroid_lon, c.r_max_m * m.part AS radius_m,
  CAST(3.141592653589793 AS DOUBLE) * (c.r_max_m * m.part / CAST(1000 AS DOUBLE)) * (c.r_max_m * m.part / CAST(1000 AS DOUBLE)) AS area_km2,
  CAST(1 + r.event_id % m.parts AS INT) AS part_count, r.event_id % 97 = 0 AS repaired, r.ta_value IS NOT NULL AS ta_used
FROM {records} r JOIN {cells} c ON c.run_id = r.run_id AND c.cell_id = r.cell_id, (
  SELECT 'B0' AS method, CAST(-1 AS DOUBLE) AS confidence, CAST(1 AS DOUBLE) AS part, CAST(0 AS DOUBLE) AS north, CAST(0 AS DOUBLE) AS east, 1 AS parts
  UNION ALL SELECT 'B1', CAST(-1 AS DOUBLE), CAST(0.625 AS DOUBLE), CAST(0.0025 AS DOUBLE), CAST(0.0025 AS DOUBLE), 1
  UNION ALL SELECT 'M', CAST(0.5 AS DOUBLE), CAST(0.25 AS DOUBLE), CAST(0.005 AS DOUBLE), CAST(0.00375 AS DOUBLE), 2
  UNION ALL SELECT 'M', CAST(0.9 AS DOUBLE), CAST(0.4375 AS DOUBLE), CAST(0.005 AS DOUBLE), CAST(0.00375 AS DOUBLE), 3
  UNION ALL SELECT 'M', CAST(0.95 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.005 AS DOUBLE), CAST(0.00375 AS DOUBLE), 4) m
"""

RUNS = """
SELECT g.run_id, substr(g.run_id, 5, 1) AS scenario, 'urban' AS morphology, CAST(42 AS BIGINT) AS seed, CAST(1 AS DOUBLE) AS lambda,
  min(g.time_us) AS started_us, max(g.time_us) AS finished_us, CAST(sum(CASE WHEN g.injected_rule = 4 THEN 0 ELSE 1 END) AS BIGINT) AS published_events,
  CAST(sum(CASE WHEN g.event_id % 50 NOT IN (1, 4) THEN 1 ELSE 0 END) AS BIGINT) AS analyzed_events,
  CAST(CASE WHEN g.run_id = 'run-D' THEN NULL ELSE sum(CASE WHEN g.injected_rule = 4 THEN 0 ELSE 1 END) END AS BIGINT) AS inspected_records
FROM {truth} g GROUP BY g.run_id
"""

TEXTS = {"cells": CELLS, "records": RECORDS, "truth": TRUTH, "estimates": ESTIMATES, "runs": RUNS}
_SPARK = {
    "us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(e.ts AS TIMESTAMP_NTZ))",
    "sha_user": "sha2(CAST(user_id AS STRING), 256)",
    "sha_device": "sha2(concat('d', CAST(CASE WHEN slot = 5 THEN user_id + 1 ELSE user_id END AS STRING)), 256)",
}
_DUCK = {
    "us": "epoch_us(e.ts)",
    "sha_user": "sha256(CAST(user_id AS VARCHAR))",
    "sha_device": "sha256(concat('d', CAST(CASE WHEN slot = 5 THEN user_id + 1 ELSE user_id END AS VARCHAR)))",
}


def _inputs(text: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(text) if name}


class Adapted:
    """The derived tables of a folder, made when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            text = TEXTS.get(name)
            if text is None:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                needed = _inputs(text) - set(_SPARK)
                plain = text.format(**_SPARK, **{n: "{" + n + "}" for n in needed})
                self._made[name] = self.spark.sql(plain, **{n: self.table(n) for n in needed})
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def duck_with(*names: str) -> str:
    """A WITH clause that gives DuckDB the derived tables named, and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in TEXTS and name not in order:
            for n in sorted(_inputs(TEXTS[name]) - set(_DUCK)):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    bodies = []
    for name in order:
        needed = _inputs(TEXTS[name]) - set(_DUCK)
        bodies.append(f"{name} AS ({TEXTS[name].format(**_DUCK, **{n: n for n in needed})})")
    return "WITH " + ",\n".join(bodies)
