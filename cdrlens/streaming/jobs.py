"""Streaming: sources, the persister, and rules 1 and 3 with keyed state.

Late records are the signal here, so there is no event-time watermark, which would drop them: state is a
subscriber's largest time and the event that set it, kept for good. At-least-once delivery is made
exactly-once by writing each batch through the store's duplicate-free append.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import clock
from ..operators import integrity
from ..operators.integrity import Rules
from ..runtime import ship
from ..sources import wire
from ..sources.store import Store

#: Rows of a micro-batch, about, by source files.
FILES_A_TRIGGER = 16


def message_stream(spark: SparkSession, path: str, files: int = FILES_A_TRIGGER) -> DataFrame:
    """Messages (key, value, partition, offset) from JSON-lines files, oldest first."""
    stream = spark.readStream.schema("key string, value string, partition int, offset long").option("maxFilesPerTrigger", files)
    return stream.json(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, offsets_a_trigger: int = 100_000) -> DataFrame:
    """The same from a Kafka topic, where the connector is on the class path."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    stream = stream.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", offsets_a_trigger)
    return stream.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset")


def write_messages(messages: DataFrame, path: str, partitions: int = 4) -> None:
    """Publish (key, value) rows: a key's messages stay in one partition, offsets follow ``seq``."""
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int")
    order = Window.partitionBy("partition").orderBy("seq")
    rows = messages.withColumn("partition", part).withColumn("offset", (F.row_number().over(order) - 1).cast("long"))
    rows.select("key", "value", "partition", "offset").sortWithinPartitions("partition", "offset").write.mode("append").json(path)


def stored_records(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoder of record messages for :func:`persist`: the offset is kept as the arrival order, which
    holds for a subscriber because its messages share a partition."""
    return wire.decode_records(messages.select("value", "partition", F.col("offset").alias("seq")), ["seq"])


def persist(messages: DataFrame, decode: Callable, store: Store, table: str, checkpoint: str, run_id: str | None = None) -> StreamingQuery:
    """Decode messages and append them to a table batch by batch; what can't be decoded or breaks the
    table's conditions goes to ``<table>_rejected``, where it counts once (:meth:`Store.rejected`) however often
    it comes. Ends when all that is there was read."""
    of = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read once for the table and the rejects
        try:
            good, bad = decode(batch)
            good = good.filter(F.col("run_id") == run_id) if run_id else good
            broken = store.append(table, good)
            rejects = bad.select(F.to_json(F.struct("*")).alias("row")).unionByName(broken.select(F.to_json(F.struct("*")).alias("row")))
            store.reject(table, rejects, f"{of}-{number}")
        finally:
            batch.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_OUT = "run_id string, event_id string, time_us long, scenario string, watermark long, prev_event_id string"


def _backsteps(tolerance_us: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, event = state.get if state.exists else (None, None)
        # order within a micro-batch isn't kept by the shuffle: arrival numbers restore it
        rows = pd.concat(list(frames)).sort_values(["partition", "offset"], kind="stable")
        times = rows["time_us"].to_numpy(np.int64)
        events = np.concatenate([[event], rows["event_id"].to_numpy(object)])
        marks = np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min if top is None else top], times]))
        # the place of the event that set each mark: where it last rose
        set_at = np.maximum.accumulate(np.where(np.concatenate([[True], marks[1:] > marks[:-1]]), np.arange(len(marks)), 0))
        # differences only where there is a mark: the first row of a new subscriber has none
        late = np.nonzero((times < marks[:-1]) & (marks[:-1] - np.minimum(times, marks[:-1]) > tolerance_us))[0]
        late = late[(set_at[late] > 0) | (top is not None)]
        state.update((int(marks[-1]), str(events[set_at[-1]])))
        found = rows.iloc[late]
        yield pd.DataFrame({"run_id": key[0], "event_id": found["event_id"].to_numpy(), "time_us": times[late], "scenario": found["scenario"].to_numpy(), "watermark": marks[:-1][late], "prev_event_id": events[set_at[late]]})

    return step


def stream_hits(records: DataFrame, cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Hits of rules 1 and 3 on a stream of records (with partition and offset).

    Rule 1 joins the stream with the static inventory; rule 3 keeps state by run and subscriber.
    """
    ship(records.sparkSession)
    known = cells.select("run_id", "cell_id").distinct()
    size = known.groupBy("run_id").agg(F.count("*").alias("inventory_size"))
    unknown = records.join(known.withColumn("known", F.lit(True)), ["run_id", "cell_id"], "left").filter("known is null").join(size, "run_id")
    proof = integrity.evidence(integrity.INVENTORY, {"cell_id": F.col("cell_id").cast("string"), "inventory_size": F.col("inventory_size")})
    first = integrity._hits(unknown, integrity.INVENTORY, F.lit(1.0), proof, rules.margin_cap)

    slim = records.filter(F.length("subscriber") > 0).select("run_id", "subscriber", "event_id", "time_us", "scenario", "partition", "offset")
    found = slim.groupBy("run_id", "subscriber").applyInPandasWithState(_backsteps(int(rules.tolerance_s * 1e6)), _OUT, "top long, event string", "append", GroupStateTimeout.NoTimeout)
    back = (F.col("watermark") - F.col("time_us")) / F.lit(1e6)
    proof = integrity.evidence(
        integrity.TIME_ORDER,
        {"record_time": clock.text("time_us"), "watermark": clock.text("watermark"), "prev_event_id": F.col("prev_event_id")},
        {"backstep_s": back, "tolerance_s": F.lit(rules.tolerance_s)},
        rules.margin_cap,
    )
    return first.unionByName(integrity._hits(found, integrity.TIME_ORDER, back / rules.tick_s, proof, rules.margin_cap))


def detect_stream(messages: DataFrame, store: Store, cells: DataFrame, run_id: str, checkpoint: str, rules: Rules = Rules()) -> StreamingQuery:
    """The stream phase of a run: decode, find, resolve against earlier claims, append. Ends when all that
    is there was read."""
    records = wire.decode_records(messages, ["partition", "offset"])[0].filter(F.col("run_id") == run_id)

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            store.append("findings", integrity.resolve(batch, store.canonical_claims(run_id)))
        finally:
            batch.unpersist()

    return stream_hits(records, cells, rules).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_to_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Publish (key, value) rows to a Kafka topic, where the connector is on the class path: acknowledged by all
    replicas, a key's messages in one partition, in the order of ``seq`` within each task."""
    part = messages.repartition(F.col("key")).sortWithinPartitions("seq").select("key", "value")
    writer = part.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    writer.option("kafka.acks", "all").option("kafka.enable.idempotence", "true").save()


class Progress:
    """Rows read and rows still waiting, from a query's progress reports."""

    def __init__(self, query: StreamingQuery):
        self.query = query

    def rows(self) -> int:
        return sum(p["numInputRows"] for p in self.query.recentProgress)

    def lag(self) -> int | None:
        last = self.query.lastProgress
        waiting = [int(s["metrics"].get("maxOffsetsBehindLatest", 0)) for s in last["sources"] if s.get("metrics")] if last else []
        return max(waiting) if waiting else None
