"""JSON messages of records and ground truth, decoded with what doesn't fit set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock

RECORD = "run_id string, event_id string, time string, pseudo_msisdn string, pseudo_imei string, event_type string, cell_id string, ta_value int, scenario string"
TRUTH = "run_id string, event_id string, time string, agent_id int, lat double, lon double, covered boolean, partition_key string, injected_rule int"
_UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
_NIL = "00000000-0000-0000-0000-000000000000"


def time_us(text: Column) -> Column:
    """Microseconds of an RFC 3339 time, null if it isn't one."""
    return F.unix_micros(F.try_to_timestamp(text))


def encode_records(df: DataFrame, *keep: str) -> DataFrame:
    """``key, value`` of each record: keyed by subscriber, so that a partition keeps a subscriber's order; columns
    named in ``keep`` pass beside them."""
    body = F.struct("run_id", "event_id", clock.text("time_us").alias("time"), F.col("subscriber").alias("pseudo_msisdn"), F.col("device").alias("pseudo_imei"), "event_type", "cell_id", "ta_value", "scenario")
    return df.select(F.col("subscriber").alias("key"), F.to_json(body).alias("value"), *keep)


def encode_truth(df: DataFrame) -> DataFrame:
    """``key, value`` of each truth row, keyed by agent."""
    body = F.struct("run_id", "event_id", clock.text("time_us").alias("time"), "agent_id", "lat", "lon", "covered", "partition_key", "injected_rule")
    return df.select(F.col("agent_id").cast("string").alias("key"), F.to_json(body).alias("value"))


def _identified(*ids: str) -> Column:
    ok = F.lit(True)
    for i in ids:
        ok = ok & F.coalesce(F.col(f"m.{i}").rlike(_UUID) & (F.col(f"m.{i}") != _NIL), F.lit(False))
    return ok


def _decoded(messages: DataFrame, ddl: str, ok: Column) -> tuple[DataFrame, DataFrame]:
    parsed = messages.withColumn("m", F.from_json(F.col("value").cast("string"), ddl, {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.col("m").isNotNull() & ok & time_us(F.col("m.time")).isNotNull(), F.lit(False))
    return parsed.filter(good), parsed.filter(~good).drop("m")


def decode_records(messages: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of ``messages`` (value), and the messages that aren't any: broken JSON, missing or nil ids,
    no time. Columns in ``order`` (say partition and offset) pass as they are, for the arrival order."""
    good, bad = _decoded(messages, RECORD, _identified("run_id", "event_id", "cell_id"))
    keep = [F.col(c) for c in order or []]
    return good.select("m.run_id", "m.event_id", time_us(F.col("m.time")).alias("time_us"), F.col("m.pseudo_msisdn").alias("subscriber"), F.col("m.pseudo_imei").alias("device"), "m.event_type", "m.cell_id", "m.ta_value", "m.scenario", *keep), bad


def decode_truth(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth rows of ``messages``, and those that aren't any; the partition must be C or V."""
    ok = _identified("run_id", "event_id") & F.coalesce(F.col("m.partition_key").isin("C", "V"), F.lit(False))
    good, bad = _decoded(messages, TRUTH, ok)
    return good.select("m.run_id", "m.event_id", time_us(F.col("m.time")).alias("time_us"), "m.agent_id", "m.lat", "m.lon", "m.covered", "m.partition_key", "m.injected_rule"), bad
