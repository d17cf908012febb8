"""Registered queries of the call-record operators, each with the SQL that gives the same rows.

Inputs are the tables that ``sources.adapters`` derives from the star schema. Queries over one run take
``RUN``; measures are rounded where the two engines may differ in the last digit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geo, identity, radio, timing
from .functions.geo import HexLattice, Plane
from .functions.mathops import COL
from .operators import estimation, generator, integrity, measurement, service
from .operators.estimation import Settings
from .operators.integrity import Rules
from .sources import adapters, wire
from .sources.adapters import Adapted, duck_with

RUN = "run-A"
RULES = Rules(max_kmh=adapters.SPEED_KMH)
PLANE = Plane(adapters.ORIGIN_LAT, adapters.ORIGIN_LON)
SETTINGS = Settings(adapters.ORIGIN_LAT, adapters.ORIGIN_LON, grid_m=50.0)
BOX = service.Box(39.05, 38.05, 39.35, 38.3)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register a query over adapted tables, and its SQL over the same tables by name."""

    def register(function: Callable[[Adapted], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Adapted(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            with_ = duck_with(*tables) if tables else ""
            if text.upper().startswith("WITH "):
                text = text[5:]
                SQL[name] = f"{with_},\n{text}" if with_ else f"WITH {text}"
            else:
                SQL[name] = f"{with_}\n{text}" if with_ else text
        return function

    return register


def _rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


# ---- places: the local plane in SQL, the same formula as functions.geo.Plane
_X = f"(c.lon - CAST(39 AS DOUBLE)) * CAST({PLANE.per_lon!r} AS DOUBLE)"
_Y = "(c.lat - CAST(38 AS DOUBLE)) * CAST(110540 AS DOUBLE)"
_PLACED = f"placed AS (SELECT c.*, {_X} AS x, {_Y} AS y FROM cells c)"


def _placed(a: Adapted) -> DataFrame:
    return estimation.on_plane(a.cells, PLANE)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("run_id", "event_id", "rule_id", F.round("margin", 6).alias("margin"), "phase")


# ---- integrity rules
_RULE1 = "SELECT r.run_id, r.event_id, 1 AS rule_id, CAST(1 AS DOUBLE) AS margin, 'stream' AS phase, r.time_us, r.scenario FROM records r WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.run_id = r.run_id AND c.cell_id = r.cell_id)"
_RULE3 = """SELECT run_id, event_id, 3 AS rule_id, least(1e6, greatest(1, (w - time_us) / 1e6 / 300)) AS margin, 'stream' AS phase, time_us, scenario FROM (
  SELECT r.*, max(time_us) OVER (PARTITION BY run_id, subscriber ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM records r) WHERE w - time_us > 0"""
_RULE5 = """SELECT r.run_id, r.event_id, 5 AS rule_id, CAST(m.devices AS DOUBLE) AS margin, 'batch' AS phase, r.time_us, r.scenario FROM records r JOIN (
  SELECT run_id, subscriber, device, n, count(*) OVER (PARTITION BY run_id, subscriber) AS devices, row_number() OVER (PARTITION BY run_id, subscriber ORDER BY n DESC, device) AS k FROM (
    SELECT run_id, subscriber, device, count(*) AS n FROM records WHERE device <> '' GROUP BY 1, 2, 3)) m
  ON m.run_id = r.run_id AND m.subscriber = r.subscriber AND m.k = 1 AND m.devices >= 2 AND m.n >= 2 WHERE r.device <> '' AND r.device <> m.device"""
_CHAIN = f"""chain AS (SELECT r.run_id, r.subscriber, r.event_id, r.time_us, r.scenario, p.x, p.y,
  lead(r.event_id) OVER w AS b_event, lead(r.time_us) OVER w AS b_time, lead(r.scenario) OVER w AS b_scenario, lead(p.x) OVER w AS bx, lead(p.y) OVER w AS by_,
  lag(p.x) OVER w AS px, lag(p.y) OVER w AS py, lead(p.x, 2) OVER w AS nx, lead(p.y, 2) OVER w AS ny
  FROM records r JOIN placed p ON p.run_id = r.run_id AND p.cell_id = r.cell_id WINDOW w AS (PARTITION BY r.run_id, r.subscriber ORDER BY r.time_us, r.event_id)),
pairs AS (SELECT *, sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) AS d, (b_time - time_us) / 1e6 AS dt FROM chain WHERE b_event IS NOT NULL),
speeds AS (SELECT *, CASE WHEN dt <= 0 THEN CASE WHEN d > 1 THEN 1e308 ELSE 0 END ELSE (d / 1000) / (dt / 3600) END AS kmh,
  CASE WHEN px IS NOT NULL AND sqrt((bx - px) * (bx - px) + (by_ - py) * (by_ - py)) > sqrt((x - px) * (x - px) + (y - py) * (y - py)) THEN 'b'
       WHEN nx IS NOT NULL AND sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) > sqrt((bx - nx) * (bx - nx) + (by_ - ny) * (by_ - ny)) THEN 'a' END AS blame FROM pairs)"""
_RULE2 = """SELECT run_id, event_id, 2 AS rule_id, least(1e6, greatest(1, kmh / 2)) AS margin, 'batch' AS phase, time_us, scenario FROM (
  SELECT run_id, CASE blame WHEN 'b' THEN b_event ELSE event_id END AS event_id, CASE blame WHEN 'b' THEN b_time ELSE time_us END AS time_us, CASE blame WHEN 'b' THEN b_scenario ELSE scenario END AS scenario, max(kmh) AS kmh
  FROM speeds WHERE kmh > 2 AND blame IS NOT NULL GROUP BY 1, 2, 3, 4)"""
_FINDINGS = f"""{_PLACED}, {_CHAIN}, hits AS ({_RULE1} UNION ALL {_RULE3} UNION ALL {_RULE5} UNION ALL {_RULE2}),
findings AS (SELECT run_id, event_id, time_us, rule_id, margin, phase AS detected_in, scenario, CASE WHEN rule_id <> winner THEN winner END AS suppressed_by FROM (
  SELECT h.*, first_value(rule_id) OVER (PARTITION BY run_id, event_id ORDER BY CASE phase WHEN 'stream' THEN 1 ELSE 2 END, CASE rule_id WHEN 1 THEN 1 WHEN 5 THEN 2 WHEN 3 THEN 3 ELSE 4 END ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS winner FROM hits h))"""
_HIT = "run_id, event_id, rule_id, round(margin, 6) AS margin, phase"
_T = ("cells", "records")
_ALL = ("cells", "records", "truth", "runs", "estimates")


@query("rule1_inventory", f"SELECT {_HIT} FROM ({_RULE1})", _T)
def _(a):
    return _hits(integrity.unknown_cells(a.records, a.cells, RULES))


@query("rule3_time_order", f"SELECT {_HIT} FROM ({_RULE3})", _T)
def _(a):
    return _hits(integrity.time_backsteps(a.records, RULES))


@query("rule3_time_order_whole", f"SELECT {_HIT} FROM ({_RULE3})", _T)
def _(a):
    return _hits(integrity.time_backsteps(a.records, RULES, block=None))


@query("rule3_time_order_in_blocks", f"SELECT {_HIT} FROM ({_RULE3})", _T)
def _(a):
    return _hits(integrity.time_backsteps(a.records, RULES, block=1000))


@query("rule5_device_activity", f"SELECT {_HIT} FROM ({_RULE5})", _T)
def _(a):
    return _hits(integrity.device_changes(a.records, RULES))


@query("rule2_velocity", f"WITH {_PLACED}, {_CHAIN} SELECT {_HIT} FROM ({_RULE2})", _T)
def _(a):
    return _hits(integrity.impossible_speeds(a.records, _placed(a), RULES))


def _findings(a: Adapted) -> DataFrame:
    return integrity.detect(a.records, _placed(a), RULES)


@query("integrity_findings", f"WITH {_FINDINGS} SELECT run_id, event_id, rule_id, round(margin, 6) AS margin, detected_in, suppressed_by FROM findings", _T)
def _(a):
    return _findings(a).select("run_id", "event_id", "rule_id", F.round("margin", 6).alias("margin"), "detected_in", "suppressed_by")


@query("findings_count", f"WITH {_FINDINGS} SELECT run_id, count(*) AS findings, count(*) FILTER (suppressed_by IS NULL) AS canonical FROM findings GROUP BY run_id", _T)
def _(a):
    return _findings(a).groupBy("run_id").agg(F.count("*").alias("findings"), F.count_if(F.col("suppressed_by").isNull()).alias("canonical"))


@query("implied_speeds", f"WITH {_PLACED}, {_CHAIN} SELECT run_id, event_id, b_event, round(d, 4) AS distance_m, dt AS delta_s, blame FROM speeds", _T)
def _(a):
    return integrity.implied_speeds(a.records, _placed(a)).select("run_id", "event_id", "b_event", F.round("d", 4).alias("distance_m"), F.col("dt").alias("delta_s"), "blame")


@query("modal_device", "SELECT run_id, subscriber, device, n, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, subscriber ORDER BY n DESC, device) AS k FROM (SELECT run_id, subscriber, device, count(*) AS n FROM records WHERE device <> '' GROUP BY 1, 2, 3)) WHERE k <= 1", _T)
def _(a):
    return measurement.modal_devices(a.records)


@query(
    "consecutive_gaps",
    "SELECT run_id, count(*) AS gaps, round(quantile_cont(gap, 0.5), 4) AS median_gap_s, round(quantile_cont(gap, 0.95), 4) AS p95_gap_s FROM (SELECT run_id, (time_us - lag(time_us) OVER (PARTITION BY run_id, subscriber ORDER BY time_us, event_id)) / 1e6 AS gap FROM records) WHERE gap IS NOT NULL GROUP BY run_id",
    _T,
)
def _(a):
    return integrity.consecutive_gaps(a.records).select("run_id", "gaps", *_rounded("median_gap_s", "p95_gap_s", digits=4))


# ---- measurement of findings
@query("precision_counts", f"WITH {_FINDINGS} SELECT f.run_id, f.rule_id, count(*) AS findings, count(*) FILTER (g.injected_rule = f.rule_id) AS true_positives FROM findings f LEFT JOIN truth g ON g.run_id = f.run_id AND g.event_id = f.event_id WHERE f.suppressed_by IS NULL GROUP BY 1, 2", (*_T, "truth"))
def _(a):
    return measurement.precision_counts(_findings(a), a.truth)


@query("recall_counts", f"WITH {_FINDINGS} SELECT g.run_id, g.injected_rule AS rule_id, count(*) AS injected, count(f.event_id) AS caught FROM truth g LEFT JOIN findings f ON f.run_id = g.run_id AND f.event_id = g.event_id AND f.rule_id = g.injected_rule AND f.suppressed_by IS NULL WHERE g.injected_rule IS NOT NULL GROUP BY 1, 2", (*_T, "truth"))
def _(a):
    return measurement.recall_counts(_findings(a), a.truth)


@query("confusion_matrix", f"WITH {_FINDINGS} SELECT f.run_id, f.rule_id, g.injected_rule, count(*) FILTER (f.suppressed_by IS NULL) AS canonical, count(*) FILTER (f.suppressed_by IS NOT NULL) AS suppressed FROM findings f LEFT JOIN truth g ON g.run_id = f.run_id AND g.event_id = f.event_id GROUP BY 1, 2, 3", (*_T, "truth"))
def _(a):
    return measurement.confusion(_findings(a), a.truth)


_Z = repr(measurement.Z95)
_PR = f"""WITH {_FINDINGS},
p AS (SELECT f.run_id, f.rule_id, count(*) AS findings, count(*) FILTER (g.injected_rule = f.rule_id) AS tp FROM findings f LEFT JOIN truth g ON g.run_id = f.run_id AND g.event_id = f.event_id WHERE f.suppressed_by IS NULL GROUP BY 1, 2),
q AS (SELECT g.run_id, g.injected_rule AS rule_id, count(*) AS injected, count(f.event_id) AS caught FROM truth g LEFT JOIN findings f ON f.run_id = g.run_id AND f.event_id = g.event_id AND f.rule_id = g.injected_rule AND f.suppressed_by IS NULL WHERE g.injected_rule IS NOT NULL GROUP BY 1, 2),
rules(rule_id, rule_name) AS (VALUES (1, 'inventory'), (2, 'velocity'), (3, 'time_order'), (4, 'trajectory_gap'), (5, 'activity')),
j AS (SELECT r.run_id, r.scenario, rules.rule_id, rule_name, coalesce(findings, 0) AS n, coalesce(tp, 0) AS tp, coalesce(injected, 0) AS injected, coalesce(caught, 0) AS caught, rules.rule_id <> 4 AND coalesce(findings, 0) > 0 AS judged
  FROM runs r CROSS JOIN rules LEFT JOIN p ON p.run_id = r.run_id AND p.rule_id = rules.rule_id LEFT JOIN q ON q.run_id = r.run_id AND q.rule_id = rules.rule_id),
k AS (SELECT *, CASE WHEN judged THEN tp * 1.0::DOUBLE / n END AS precision_, CAST({_Z} AS DOUBLE) AS z FROM j),
out_ AS (SELECT run_id, scenario, rule_id, rule_name, n AS findings, tp AS true_positives, injected, precision_, CASE WHEN injected > 0 THEN caught * 1.0::DOUBLE / injected ELSE 0 END AS recall_,
  CASE WHEN judged THEN greatest(0, (precision_ + z * z / (2 * n) - z * sqrt(precision_ * (1 - precision_) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END AS lo,
  CASE WHEN judged THEN least(1, (precision_ + z * z / (2 * n) + z * sqrt(precision_ * (1 - precision_) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END AS hi, judged AND n >= 30 AS sufficient FROM k)"""


@query("precision_recall", f"{_PR} SELECT run_id, scenario, rule_id, rule_name, findings, true_positives, injected, round(precision_, 9) AS precision, round(recall_, 9) AS recall, round(lo, 9) AS precision_lo, round(hi, 9) AS precision_hi, sufficient FROM out_", _ALL)
def _(a):
    out = measurement.precision_recall(_findings(a), a.truth, a.runs)
    return out.select("run_id", "scenario", "rule_id", "rule_name", "findings", "true_positives", "injected", *_rounded("precision", "recall", "precision_lo", "precision_hi", digits=9), "sufficient")


@query("verdicts", f"{_PR} SELECT run_id, rule_id, CASE WHEN rule_id = 4 THEN 'out of scope' WHEN precision_ IS NULL THEN 'not measurable' WHEN NOT sufficient THEN concat('insufficient (', findings, ' findings)') WHEN precision_ >= 0.9 THEN 'passed' ELSE 'failed' END AS verdict FROM out_", _ALL)
def _(a):
    return measurement.precision_recall(_findings(a), a.truth, a.runs).select("run_id", "rule_id", measurement.verdict().alias("verdict"))


# ---- measurement of estimates
_DIST = f"2 * CAST({geo.EARTH_RADIUS_M!r} AS DOUBLE) * asin(sqrt(least(1, pow(sin(radians(g.lat - e.centroid_lat) / 2), 2) + cos(radians(e.centroid_lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - e.centroid_lon) / 2), 2))))"
_JOINED = "estimates e JOIN truth g ON g.run_id = e.run_id AND g.event_id = e.event_id WHERE g.partition_key = 'V'"


def _inside() -> Column:
    """The closed-form region: a disk around the centroid, its rim included."""
    return geo.haversine_m(F.col("centroid_lat"), F.col("centroid_lon"), F.col("lat"), F.col("lon"), COL) <= F.col("radius_m")


@query("coverage_rate", f"SELECT e.run_id, e.method, e.confidence, count(*) AS n_events, round(avg(CASE WHEN {_DIST} <= e.radius_m THEN 1 ELSE 0 END), 9) AS coverage_rate FROM {_JOINED} AND g.covered GROUP BY 1, 2, 3", _ALL)
def _(a):
    return measurement.coverage(a.estimates, a.truth, _inside()).select("run_id", "method", "confidence", "n_events", *_rounded("coverage_rate", digits=9))


_AREAS = f"SELECT e.run_id, e.method, e.confidence, round(quantile_cont(e.area_km2, 0.5), 6) AS median_area_km2, round(quantile_cont(e.area_km2, 0.9), 6) AS p90_area_km2, round(quantile_cont(e.part_count, 0.5), 6) AS median_part_count, round(quantile_cont(e.part_count, 0.95), 6) AS p95_part_count, round(avg(CAST(e.repaired AS INT)), 9) AS repaired_ratio FROM {_JOINED} GROUP BY 1, 2, 3"
_ERRORS = f"SELECT run_id, method, confidence, round(quantile_cont(d, 0.5), 4) AS median_haversine_m, round(quantile_cont(d, 0.5), 4) AS r50_m, round(quantile_cont(d, 0.95), 4) AS r95_m FROM (SELECT e.run_id, e.method, e.confidence, {_DIST} AS d FROM {_JOINED} AND g.covered) GROUP BY 1, 2, 3"


@query("area_statistics", _AREAS, _ALL)
def _(a):
    return measurement.areas(a.estimates, a.truth).select("run_id", "method", "confidence", *_rounded("median_area_km2", "p90_area_km2", "median_part_count", "p95_part_count"), *_rounded("repaired_ratio", digits=9))


@query("error_percentiles", _ERRORS, _ALL)
def _(a):
    return measurement.errors(a.estimates, a.truth).select("run_id", "method", "confidence", *_rounded("median_haversine_m", "r50_m", "r95_m", digits=4))


@query(
    "area_reduction",
    f"SELECT run_id, round(b0, 6) AS b0_area_km2, round(b1, 6) AS b1_area_km2, round(m, 6) AS m_area_km2, n AS n_events, round(1 - m / b0, 9) AS reduction_vs_b0, round(1 - m / b1, 9) AS reduction_vs_b1 FROM (SELECT e.run_id, quantile_cont(e.area_km2, 0.5) FILTER (e.method = 'B0') AS b0, quantile_cont(e.area_km2, 0.5) FILTER (e.method = 'B1') AS b1, quantile_cont(e.area_km2, 0.5) FILTER (e.method = 'M' AND e.confidence = 0.9) AS m, count(*) FILTER (e.method = 'M' AND e.confidence = 0.9) AS n FROM {_JOINED} GROUP BY 1)",
    _ALL,
)
def _(a):
    return measurement.reductions(a.estimates, a.truth).select("run_id", *_rounded("b0_area_km2", "b1_area_km2", "m_area_km2"), "n_events", *_rounded("reduction_vs_b0", "reduction_vs_b1", digits=9))


@query("equal_event_sets", "SELECT run_id, b0, b1, m, b0 = b1 AND b1 = m AS equal FROM (SELECT run_id, count(DISTINCT event_id) FILTER (method = 'B0') AS b0, count(DISTINCT event_id) FILTER (method = 'B1') AS b1, count(DISTINCT event_id) FILTER (method = 'M') AS m FROM estimates GROUP BY run_id)", _ALL)
def _(a):
    return measurement.equal_event_sets(a.estimates)


@query(
    "metric_rows",
    f"WITH ar AS ({_AREAS}), er AS ({_ERRORS}), co AS (SELECT e.run_id, e.method, e.confidence, count(*) AS n_events FROM {_JOINED} AND g.covered GROUP BY 1, 2, 3) SELECT ar.run_id, ar.method, ar.confidence, 'V' AS partition_key, n_events, median_area_km2, r95_m, greatest(1, CAST(round(p95_part_count) AS INT)) AS p95_part_count FROM ar JOIN er ON er.run_id = ar.run_id AND er.method = ar.method AND er.confidence = ar.confidence JOIN co ON co.run_id = ar.run_id AND co.method = ar.method AND co.confidence = ar.confidence",
    _ALL,
)
def _(a):
    return measurement.metric_rows(a.estimates, a.truth, _inside()).select("run_id", "method", "confidence", "partition_key", "n_events", *_rounded("median_area_km2"), *_rounded("r95_m", digits=4), "p95_part_count")


_VERIFY = """SELECT run_id, 'records_without_truth' AS check_name, CASE WHEN n = 0 THEN 'OK' ELSE 'FAIL' END AS status, n AS count FROM (SELECT u.run_id, count(r.event_id) AS n FROM runs u LEFT JOIN (SELECT r.* FROM records r LEFT JOIN truth g ON g.run_id = r.run_id AND g.event_id = r.event_id WHERE g.event_id IS NULL) r ON r.run_id = u.run_id GROUP BY 1)
UNION ALL SELECT run_id, 'truth_without_records', CASE WHEN n = 0 THEN 'OK' ELSE 'FAIL' END, n FROM (SELECT u.run_id, count(g.event_id) AS n FROM runs u LEFT JOIN (SELECT g.* FROM truth g LEFT JOIN records r ON g.run_id = r.run_id AND g.event_id = r.event_id WHERE r.event_id IS NULL AND g.injected_rule IS DISTINCT FROM 4) g ON g.run_id = u.run_id GROUP BY 1)
UNION ALL SELECT u.run_id, 'published_vs_stored_records', CASE WHEN published_events IS NULL THEN 'SKIP' WHEN published_events = n THEN 'OK' ELSE 'FAIL' END, n FROM runs u JOIN (SELECT u.run_id, count(r.event_id) AS n FROM runs u LEFT JOIN records r ON r.run_id = u.run_id GROUP BY 1) s ON s.run_id = u.run_id
UNION ALL SELECT u.run_id, 'estimates_per_analyzed_event', CASE WHEN analyzed_events IS NULL OR analyzed_events = 0 THEN 'SKIP' WHEN n = 5 * analyzed_events THEN 'OK' ELSE 'FAIL' END, n FROM runs u JOIN (SELECT u.run_id, count(e.event_id) AS n FROM runs u LEFT JOIN estimates e ON e.run_id = u.run_id GROUP BY 1) s ON s.run_id = u.run_id
UNION ALL SELECT run_id, 'inspected_vs_published_records', CASE WHEN inspected_records IS NULL OR published_events IS NULL THEN 'SKIP' WHEN inspected_records = published_events THEN 'OK' ELSE 'FAIL' END, coalesce(inspected_records, 0) FROM runs"""


@query("verify_integrity", _VERIFY, _ALL)
def _(a):
    return measurement.verify_integrity(a.runs, a.records, a.truth, a.estimates)


@query("records_without_truth", "SELECT r.run_id, r.event_id FROM records r LEFT JOIN truth g ON g.run_id = r.run_id AND g.event_id = r.event_id AND g.injected_rule IS NOT NULL WHERE g.event_id IS NULL", _ALL)
def _(a):
    return a.records.join(a.truth.filter("injected_rule is not null").select("run_id", "event_id"), ["run_id", "event_id"], "left_anti").select("run_id", "event_id")


@query("rejected_records", "SELECT r.run_id, r.event_id, r.cell_id FROM records r WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.run_id = r.run_id AND c.cell_id = r.cell_id)", _T)
def _(a):
    return estimation.rejected(a.records, a.cells).select("run_id", "event_id", "cell_id")


@query(
    "run_difference",
    "WITH a AS (SELECT event_type, cell_id, ta_value FROM records WHERE run_id = 'run-A'), b AS (SELECT event_type, cell_id, ta_value FROM records WHERE run_id = 'run-B') SELECT *, 'run-A' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'run-B' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    _T,
)
def _(a):
    return measurement.run_difference(a.records, "run-A", "run-B", ("run_id", "event_id", "seq", "time_us", "subscriber", "device", "scenario"))


# ---- query service
@query("list_runs", "SELECT run_id, scenario, published_events, analyzed_events, inspected_records FROM runs ORDER BY started_us DESC, run_id LIMIT 50", _ALL)
def _(a):
    return service.list_runs(a.runs).select("run_id", "scenario", "published_events", "analyzed_events", "inspected_records")


@query("subscribers", f"SELECT r.subscriber, count(DISTINCT r.event_id) AS records, count(DISTINCT e.event_id) FILTER (e.method = 'M') AS estimates FROM records r LEFT JOIN estimates e ON e.run_id = r.run_id AND e.event_id = r.event_id WHERE r.run_id = '{RUN}' GROUP BY r.subscriber HAVING count(DISTINCT e.event_id) FILTER (e.method = 'M') > 0 ORDER BY estimates DESC, r.subscriber LIMIT 25", _ALL)
def _(a):
    return service.subscribers(a.records, a.estimates, RUN)


_IN_BOX = "c.lat BETWEEN 38.05 AND 38.3 AND c.lon BETWEEN 39.05 AND 39.35"


@query("cells_in_box", f"SELECT cell_id, site_id, azimuth, beam_width, freq_mhz, round(r_max_m, 1) AS r_max_m, model_type, lat, lon FROM cells c WHERE run_id = '{RUN}' AND {_IN_BOX}", _T)
def _(a):
    return service.cells(a.cells, RUN, BOX)


_SUB0 = hashlib.sha256(b"8").hexdigest()


@query("subscriber_estimates", f"SELECT e.event_id, e.method, e.confidence, round(e.area_km2, 6) AS area_km2, r.time_us FROM estimates e JOIN records r ON r.run_id = e.run_id AND r.event_id = e.event_id WHERE e.run_id = '{RUN}' AND r.subscriber = '{_SUB0}' AND e.method = 'M' AND e.confidence = 0.9", _ALL)
def _(a):
    return service.estimates(a.estimates, a.records, RUN, _SUB0, method="M", confidence=0.9).select("event_id", "method", "confidence", "area_km2", "time_us")


@query("subscriber_estimates_in_window", f"SELECT e.event_id, e.method, r.time_us FROM estimates e JOIN records r ON r.run_id = e.run_id AND r.event_id = e.event_id WHERE e.run_id = '{RUN}' AND r.subscriber = '{_SUB0}' AND r.time_us >= 1704585600000000 AND r.time_us < 1705622400000000", _ALL)
def _(a):
    return service.estimates(a.estimates, a.records, RUN, _SUB0, 1704585600000000, 1705622400000000).select("event_id", "method", "time_us")


@query("findings_with_places", f"WITH {_FINDINGS} SELECT f.event_id, f.rule_id, round(f.margin, 4) AS margin, f.detected_in, c.lat IS NOT NULL AS cell_known, c.lat, c.lon FROM findings f JOIN records r ON r.run_id = f.run_id AND r.event_id = f.event_id LEFT JOIN cells c ON c.run_id = f.run_id AND c.cell_id = r.cell_id WHERE f.run_id = '{RUN}' AND f.suppressed_by IS NULL", _T)
def _(a):
    return service.findings(_findings(a), a.records, a.cells, RUN).select("event_id", "rule_id", "margin", "detected_in", "cell_known", "lat", "lon")


_ACT = f"SELECT r.cell_id, count(*) AS records, count(DISTINCT r.subscriber) AS subscribers FROM records r WHERE r.run_id = '{RUN}' GROUP BY r.cell_id"


@query("cell_activity", f"SELECT a.cell_id, a.records, a.subscribers, c.lat, c.lon FROM ({_ACT}) a JOIN cells c ON c.run_id = '{RUN}' AND c.cell_id = a.cell_id WHERE a.subscribers >= 2", _T)
def _(a):
    return service.activity(a.records, a.cells, RUN, k=2)


@query("cell_activity_suppressed", f"SELECT count(*) AS suppressed FROM ({_ACT}) a JOIN cells c ON c.run_id = '{RUN}' AND c.cell_id = a.cell_id WHERE a.subscribers < 2", _T)
def _(a):
    return service.suppressed_cells(a.records, a.cells, RUN, k=2)


# ---- functions
@query("haversine", f"SELECT e.event_id, e.method, e.confidence, round({_DIST}, 4) AS distance_m FROM estimates e JOIN truth g ON g.run_id = e.run_id AND g.event_id = e.event_id", _ALL)
def _(a):
    both = a.estimates.join(a.truth.select("run_id", "event_id", "lat", "lon"), ["run_id", "event_id"])
    d = geo.haversine_m(F.col("centroid_lat"), F.col("centroid_lon"), F.col("lat"), F.col("lon"), COL)
    return both.select("event_id", "method", "confidence", F.round(d, 4).alias("distance_m"))


@query(
    "hexagon_of_truth",
    f"WITH p AS (SELECT event_id, (c.lon - 39) * CAST({PLANE.per_lon!r} AS DOUBLE) AS x, (c.lat - 38) * 110540::DOUBLE AS y FROM truth c), f AS (SELECT event_id, (x * (sqrt(3) / 3) - y / 3) / (150 / sqrt(3)) AS q, y * (2.0::DOUBLE / 3) / (150 / sqrt(3)) AS r FROM p), n AS (SELECT *, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM f), d AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM n) SELECT event_id, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM d",
    ("truth",),
)
def _(a):
    q, r = HexLattice(150.0).at(PLANE.x(F.col("lon")), PLANE.y(F.col("lat")), COL)
    return a.truth.select("event_id", q.cast("long").alias("q"), r.cast("long").alias("r"))


_PAIR = f"{_PLACED}, pairs AS (SELECT r.event_id, p.azimuth, p.beam_width, p.tilt_deg, p.ant_height, p.eirp_dbm, p.freq_mhz, (g.lon - 39) * CAST({PLANE.per_lon!r} AS DOUBLE) - p.x AS dx, (g.lat - 38) * 110540::DOUBLE - p.y AS dy FROM records r JOIN placed p ON p.run_id = r.run_id AND p.cell_id = r.cell_id JOIN truth g ON g.run_id = r.run_id AND g.event_id = r.event_id)"
_OFF = "CASE WHEN b > 180 THEN b - 360 WHEN b <= -180 THEN b + 360 ELSE b END"
_ANT = f"""b AS (SELECT *, fmod(degrees(atan2(dx, dy)) - azimuth, 360) AS b, sqrt(dx * dx + dy * dy) AS d2 FROM pairs),
o AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE {_OFF} END AS off_axis, CASE WHEN d2 <= 0 THEN 90 ELSE degrees(atan2(ant_height - 1.5, d2)) END AS elevation FROM b),
t AS (SELECT *, least(least(12 * pow(off_axis / beam_width, 2), 30) + least(12 * pow((elevation - tilt_deg) / 65, 2), 30), 30) AS attenuation, greatest(d2, 10) AS d, sqrt(pow(greatest(d2, 10), 2) + pow(ant_height - 1.5, 2)) AS d3, freq_mhz / 1000.0::DOUBLE AS ghz FROM o)"""


def _links(a: Adapted) -> DataFrame:
    both = a.records.join(_placed(a), ["run_id", "cell_id"]).join(a.truth.select("run_id", "event_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), ["run_id", "event_id"])
    return both.withColumn("dx", PLANE.x(F.col("t_lon")) - F.col("x")).withColumn("dy", PLANE.y(F.col("t_lat")) - F.col("y"))


@query("antenna_attenuation", f"WITH {_PAIR}, {_ANT} SELECT event_id, round(off_axis, 6) AS off_axis, round(elevation, 6) AS elevation, round(attenuation, 6) AS attenuation FROM t", _ALL)
def _(a):
    off = geo.wrap_degrees(geo.bearing_degrees(F.col("dx"), F.col("dy"), COL) - F.col("azimuth"), COL)
    off = F.when((F.col("dx") == 0) & (F.col("dy") == 0), 0.0).otherwise(off)
    up = geo.elevation_degrees(F.col("ant_height") - radio.UT_HEIGHT_M, F.hypot("dx", "dy"), COL)
    loss = radio.antenna_attenuation_db(off, up, F.col("beam_width"), F.col("tilt_deg"), COL)
    return _links(a).select("event_id", F.round(off, 6).alias("off_axis"), F.round(up, 6).alias("elevation"), F.round(loss, 6).alias("attenuation"))


def _urban_sql(intercept, near, far, coefficient, nlos, decay) -> str:
    return f"""l AS (SELECT *, 4 * (ant_height - 1) * 0.5 * ghz * 1e9 / 3e8 AS bp FROM t),
m AS (SELECT *, CASE WHEN d <= bp THEN {intercept} + 20 * log10(ghz) + {near} * log10(d3) ELSE {intercept} + 20 * log10(ghz) + {far} * log10(d3) - {coefficient} * log10(bp * bp + pow(ant_height - 1.5, 2)) END AS los, CASE WHEN d <= 18 THEN 1 ELSE greatest(0, least(1, 18 / d + exp(-d / {decay}) * (1 - 18 / d))) END AS p FROM l),
n AS (SELECT *, greatest(los, {nlos}) AS nlos FROM m)"""


_UMA = _urban_sql("28::DOUBLE", 22, 40, 9, "13.54 + 39.08 * log10(d3) + 20 * log10(ghz)", 63)
_UMI = _urban_sql("32.4::DOUBLE", 21, 40, 9.5, "22.4 + 35.3 * log10(d3) + 21.3 * log10(ghz)", 36)
_RMA = """l AS (SELECT *, 2 * pi() * ant_height * 1.5 * ghz * 1e9 / 3e8 AS bp, least(0.03 * pow(5, 1.72), 10) AS s, least(0.044 * pow(5, 1.72), 14.77) AS i FROM t),
m AS (SELECT *, CASE WHEN d <= bp THEN 20 * log10(40 * pi() / 3 * d3 * ghz) + s * log10(d3) - i + 0.002 * log10(5) * d3 ELSE 20 * log10(40 * pi() / 3 * bp * ghz) + s * log10(bp) - i + 0.002 * log10(5) * bp + 40 * log10(d3 / bp) END AS los, CASE WHEN d <= 10 THEN 1 ELSE greatest(0, least(1, exp(-(d - 10) / 1000))) END AS p FROM l),
n AS (SELECT *, greatest(los, 161.04 - 7.1 * log10(20) + 7.5 * log10(5) - (24.37 - 3.7 * pow(5 / ant_height, 2)) * log10(ant_height) + (43.42 - 3.1 * log10(ant_height)) * (log10(d3) - 3) + 20 * log10(ghz) - (3.2 * pow(log10(11.75 * 1.5), 2) - 4.97)) AS nlos FROM m)"""


def _path_loss(name: str, sql: str) -> None:
    @query(f"received_power_{name.lower()}", f"WITH {_PAIR}, {_ANT}, {sql} SELECT event_id, round(p, 6) AS los_probability, round(p * los + (1 - p) * nlos, 5) AS path_loss_db, round(eirp_dbm - (p * los + (1 - p) * nlos) - attenuation, 5) AS power_dbm FROM n", _ALL)
    def _(a):
        model, d = radio.model_named(name), F.hypot("dx", "dy")
        mhz, bs = F.col("freq_mhz").cast("double"), F.col("ant_height")
        power = radio.received_power_dbm(model, F.col("eirp_dbm"), F.col("azimuth"), F.col("beam_width"), F.col("tilt_deg"), bs, mhz, F.col("dx"), F.col("dy"), m=COL)
        return _links(a).select("event_id", F.round(model.los_probability(d, radio.UT_HEIGHT_M, COL), 6).alias("los_probability"), F.round(model.mixed_db(d, bs, radio.UT_HEIGHT_M, mhz, COL), 5).alias("path_loss_db"), F.round(power, 5).alias("power_dbm"))


for _name, _sql in (("UMa", _UMA), ("UMi", _UMI), ("RMa", _RMA)):
    _path_loss(_name, _sql)


@query("timing_advance", f"WITH {_PAIR} SELECT event_id, CAST(floor(sqrt(dx * dx + dy * dy) / 78.12) AS BIGINT) AS lte, CAST(floor(sqrt(dx * dx + dy * dy) / 550) AS BIGINT) AS gsm FROM pairs", _ALL)
def _(a):
    d = F.hypot("dx", "dy")
    return _links(a).select("event_id", timing.from_distance(d, "LTE", COL).cast("long").alias("lte"), timing.from_distance(d, "GSM", COL).cast("long").alias("gsm"))


@query("sector_membership", f"WITH {_PAIR}, {_ANT} SELECT event_id, d2 <= 1500 AND abs(off_axis) <= beam_width / 2 AS inside FROM t", _ALL)
def _(a):
    off = geo.wrap_degrees(geo.bearing_degrees(F.col("dx"), F.col("dy"), COL) - F.col("azimuth"), COL)
    off = F.when((F.col("dx") == 0) & (F.col("dy") == 0), 0.0).otherwise(off)
    return _links(a).select("event_id", ((F.hypot("dx", "dy") <= 1500) & (F.abs(off) <= F.col("beam_width") / 2)).alias("inside"))


_RUN_UUID = "11111111-2222-4333-8444-555555555555"
_NAME = f"concat('{_RUN_UUID.replace('-', '')}', lpad(lower(to_hex(user_id)), 8, '0'), lpad(lower(to_hex(event_id)), 16, '0'), '00000000')"
_EVENT_ID = f"""WITH h AS (SELECT event_id, sha1(unhex(concat('{identity.EVENT_NAMESPACE.replace('-', '')}', {_NAME}))) AS s FROM events),
u AS (SELECT event_id, concat(substr(s, 1, 8), '-', substr(s, 9, 4), '-5', substr(s, 14, 3), '-', substr('89ab', (strpos('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1), substr(s, 18, 3), '-', substr(s, 21, 12)) AS uid FROM h)"""


def _ids(a: Adapted) -> DataFrame:
    return a.events.select("event_id", identity.event_id(F.lit(_RUN_UUID), F.col("user_id"), F.col("event_id"), F.lit(0)).alias("uid"))


@query("event_ids", f"{_EVENT_ID} SELECT event_id, uid FROM u")
def _(a):
    return _ids(a)


@query("partition_split", f"{_EVENT_ID}, d AS (SELECT event_id, sha256(unhex(concat(replace(uid, '-', ''), '000000000000002a'))) AS s FROM u) SELECT event_id, CASE WHEN CAST(concat('0x', substr(s, 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < 0.8 THEN 'C' ELSE 'V' END AS partition_key FROM d")
def _(a):
    return _ids(a).select("event_id", identity.partition_key(F.col("uid"), 42).alias("partition_key"))


@query("identity_numbers", "SELECT DISTINCT user_id, concat('9050', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS subscriber, concat('35', lpad(CAST(user_id AS VARCHAR), 13, '0')) AS device FROM events")
def _(a):
    u = F.col("user_id")
    return a.events.select("user_id", identity.subscriber_number(u).alias("subscriber"), identity.device_number(u).alias("device")).distinct()


# ---- estimation, sampling
@query(
    "neighbour_candidates",
    f"WITH {_PLACED}, c AS (SELECT run_id, cell_id, r_max_m, x, y, x + 2 * r_max_m * sin(radians(32.5)) / (3 * radians(32.5)) * sin(radians(azimuth)) AS cx, y + 2 * r_max_m * sin(radians(32.5)) / (3 * radians(32.5)) * cos(radians(azimuth)) AS cy FROM placed) SELECT a.run_id, a.cell_id, least(8, count(b.cell_id)) AS neighbours FROM c a LEFT JOIN c b ON a.run_id = b.run_id AND a.cell_id <> b.cell_id AND sqrt((a.cx - b.x) * (a.cx - b.x) + (a.cy - b.y) * (a.cy - b.y)) <= b.r_max_m GROUP BY 1, 2",
    _T,
)
def _(a):
    out = estimation.with_neighbours(a.cells, SETTINGS)
    return out.select("run_id", "cell_id", F.coalesce(F.size("neighbours"), F.lit(0)).cast("long").alias("neighbours"))


@query("density_prefix", "SELECT run_id, cell_id, count(*) AS members FROM (SELECT run_id, cell_id, sum(n) OVER (PARTITION BY run_id, cell_id ORDER BY n DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before, sum(n) OVER (PARTITION BY run_id, cell_id) AS total FROM (SELECT run_id, cell_id, event_id, event_id % 17 + 1 AS n FROM records)) WHERE before < 0.9 * total GROUP BY 1, 2", _T)
def _(a):
    """The smallest likeliest set that holds nine tenths, as a window over long-form weights."""
    rows = a.records.select("run_id", "cell_id", "event_id", (F.col("event_id") % 17 + 1).alias("n"))
    group = Window.partitionBy("run_id", "cell_id")
    order = group.orderBy(F.desc("n"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("total", F.sum("n").over(group))
    return rows.filter(F.col("before") < 0.9 * F.col("total")).groupBy("run_id", "cell_id").agg(F.count("*").alias("members"))


@query("estimates_per_event", "SELECT r.run_id, count(*) AS events, count(*) * 5 AS n FROM records r JOIN cells c ON c.run_id = r.run_id AND c.cell_id = r.cell_id GROUP BY 1", _T)
def _(a):
    return estimation.estimates(a.records, a.cells, SETTINGS).groupBy("run_id").agg(F.count_distinct("event_id").alias("events"), F.count("*").alias("n"))


@query("wire_round_trip", "SELECT event_id, time_us, subscriber, ta_value FROM records", _T)
def _(a):
    texts = a.records.select(F.lit(_RUN_UUID).alias("run_id"), identity.event_id(F.lit(_RUN_UUID), F.lit(0), F.col("event_id"), F.lit(0)).alias("event_id"), "time_us", "subscriber", "device", "event_type", F.lit(_RUN_UUID).alias("cell_id"), "ta_value", "scenario")
    good, _ = wire.decode_records(wire.encode_records(texts))
    back = a.records.select(F.col("event_id").alias("number"), identity.event_id(F.lit(_RUN_UUID), F.lit(0), F.col("event_id"), F.lit(0)).alias("event_id"))
    return good.join(back, "event_id").select(F.col("number").alias("event_id"), "time_us", "subscriber", "ta_value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity findings of all runs measured against the truth: precision, recall, intervals, verdicts."""
    a = Adapted(spark, sf_dir)
    out = measurement.precision_recall(_findings(a), a.truth, a.runs)
    return out.withColumn("verdict", measurement.verdict())


#: A small scenario for the generator: a day of a hundred agents, or of as many as there are users.
DEMO = {
    "run": {"scenario": "A", "name": "demo", "seed": 42}, "morphology": "urban", "area": {"origin_lat": 38.6748, "origin_lon": 39.2225, "radius_km": 3},
    "simulation": {"agents": 100, "duration_days": 1, "tick_minutes": 5}, "network": {"sites_min": 20, "sites_max": 40, "rx_sensitivity_dbm": -110},
    "radio": {"shadowing_sigma_db": 7, "d_max_km": 5}, "timing_advance": {"enabled": True, "technology": "LTE"},
    "analysis": {"grid_resolution_m": 100, "contour_levels": [0.5, 0.9, 0.95], "neighbor_max_count": 8, "sample": {"calibration_events": 200, "validation_events": 200}},
    "calibration": {"split_ratio": 0.8, "lambda_min": 0.5, "lambda_max": 3.0, "target_coverage": 0.9, "tolerance": 0.005, "max_iterations": 12},
    "integrity": {"max_velocity_kmh": 300, "injection_rate": 0.02, "rule_weights": {1: 0.2, 2: 0.2, 3: 0.2, 4: 0.2, 5: 0.2}},
    "privacy": {"k_anonymity": 5, "hmac_salt_env": "HMAC_SALT"}, "api": {"max_geometries_per_request": 500},
}


def demo_spec(agents: int = 100) -> generator.RunSpec:
    import json

    from .sources.config import parse

    scenario = DEMO | {"simulation": DEMO["simulation"] | {"agents": agents}}
    return generator.RunSpec(_RUN_UUID, parse(json.dumps(scenario)), 1_704_067_200_000_000, b"0123456789abcdef0123456789abcdef")
