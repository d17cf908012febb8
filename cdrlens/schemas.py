"""Table schemas, their keys and the conditions their rows must meet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import clock

EVENT_TYPES = ("MOC", "MTC", "SMS", "DATA", "IDLE")


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


@dataclass(frozen=True)
class Table:
    """A table's columns, unique key, partition columns and row conditions (name to SQL predicate)."""

    name: str
    ddl: str
    key: tuple[str, ...] = ()
    partitions: tuple[str, ...] = ("run_id",)
    checks: dict = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return _schema(self.ddl)

    def violations(self, df: DataFrame) -> Column:
        """Names of the conditions a row breaks (a null value breaks none)."""
        broken = [F.when(~F.coalesce(F.expr(c), F.lit(True)), F.lit(n)) for n, c in self.checks.items()]
        return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")

    def checked(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Good rows, and bad ones with the names of what they break."""
        marked = df.withColumn("violations", self.violations(df))
        return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


TABLES = {
    t.name: t
    for t in (
        Table(
            "runs",
            "run_id string, scenario string, morphology string, seed long, lambda double, started_us long, finished_us long, config string, published_events long, analyzed_events long, inspected_records long",
            ("run_id",),
            checks={"scenario": "scenario IN ('A','B','C','D')", "morphology": "morphology IN ('urban','rural')"},
        ),
        Table(
            "cells",
            "run_id string, cell_id string, site_id string, azimuth double, beam_width double, eirp_dbm double, ant_height double, tilt_deg double, r_max_m double, freq_mhz int, morphology string, model_type string, lat double, lon double",
            ("run_id", "cell_id"),
            checks={
                "azimuth": "azimuth >= 0 AND azimuth < 360", "beam_width": "beam_width > 0 AND beam_width <= 360", "r_max_m": "r_max_m > 0",
                "model_type": "model_type IN ('UMa','UMi','RMa')", "place": "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180", "freq_mhz": "freq_mhz > 0", "ant_height": "ant_height > 0",
            },
        ),
        Table(
            "records",
            "run_id string, event_id string, seq long, time_us long, subscriber string, device string, event_type string, cell_id string, ta_value int, scenario string",
            ("run_id", "event_id", "time_us"),
            ("run_id", "event_date"),
            {"event_type": "event_type IN ('MOC','MTC','SMS','DATA','IDLE')", "ta_value": "ta_value >= 0"},
        ),
        Table(
            "truth",
            "run_id string, event_id string, time_us long, agent_id int, lat double, lon double, covered boolean, partition_key string, injected_rule int",
            ("run_id", "event_id", "time_us"),
            ("run_id", "event_date"),
            {"partition_key": "partition_key IN ('C','V')", "injected_rule": "injected_rule BETWEEN 1 AND 5"},
        ),
        Table(
            "estimates",
            "run_id string, event_id string, time_us long, scenario string, method string, confidence double, geometry binary, centroid_lat double, centroid_lon double, area_km2 double, part_count int, ta_used boolean, repaired boolean",
            ("run_id", "event_id", "method", "confidence", "time_us"),
            ("run_id", "event_date"),
            {"method": "rtrim(method) IN ('B0','B1','M')", "area": "area_km2 > 0", "parts": "part_count >= 1"},
        ),
        Table(
            "findings",
            "run_id string, event_id string, time_us long, rule_id int, rule_name string, margin double, evidence string, scenario string, detected_in string, suppressed_by int",
            ("run_id", "event_id", "rule_id"),
            checks={
                "margin": "margin BETWEEN 1 AND 1e6", "rule_id": "rule_id IN (1,2,3,5)", "detected_in": "detected_in IN ('stream','batch')",
                "suppressed_by": "suppressed_by <> rule_id", "evidence": "get_json_object(evidence, '$.v') IS NOT NULL",
            },
        ),
        Table(
            "metrics",
            "run_id string, scenario string, method string, confidence double, partition_key string, n_events long, coverage_rate double, median_area_km2 double, p90_area_km2 double, median_haversine_m double, r50_m double, r95_m double, median_part_count int, p95_part_count int, repaired_ratio double, reduction_vs_b0 double, reduction_vs_b1 double",
        ),
        Table(
            "integrity_metrics",
            "run_id string, scenario string, rule_id int, rule_name string, findings long, true_positives long, injected long, precision double, recall double, precision_lo double, precision_hi double, sufficient boolean",
            ("run_id", "rule_id"),
            checks={"true_positives": "true_positives <= findings"},
        ),
        Table("audit", "time_us long, run_id string, principal string, action string, resource string, detail string", partitions=()),
    )
}


def event_date(time_us: str = "time_us") -> Column:
    return clock.day(time_us)
