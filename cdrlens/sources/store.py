"""Tables as Parquet folders: appends without duplicates, partition overwrites, counters and audit."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, Table, event_date


#: Seconds that noting an access may take a caller.
AUDIT_S = 3.0


class Store:
    """The tables of one root folder, in any store Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        #: Accesses that couldn't be noted.
        self.audits_dropped = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        """The table, empty if it was never written. Filters on run_id (and event_date) prune folders."""
        table = TABLES[name]
        if not self.exists(name):
            empty = self.spark.createDataFrame([], table.schema)
            return empty.withColumn("event_date", F.lit(None).cast("string")) if "event_date" in table.partitions else empty
        ddl = table.ddl + (", event_date string" if "event_date" in table.partitions else "")
        return self.spark.read.schema(ddl).parquet(self.path(name))

    def _shaped(self, table: Table, df: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in table.schema.fields}
        out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        return out.withColumn("event_date", event_date()) if "event_date" in table.partitions else out

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add the good rows of ``df`` whose key isn't there yet, each key once; returns the bad ones.

        The anti-join reads only the key columns of the partitions (runs and days) that ``df`` has, so a
        repeated batch costs in proportion to itself and adds nothing.
        """
        table = TABLES[name]
        good, bad = table.checked(self._shaped(table, df))
        if table.key:
            good = good.dropDuplicates(list(table.key))
            if self.exists(name):
                old = self.read(name)
                touched = good.select(*table.partitions).distinct() if table.partitions else None
                if touched is not None:
                    old = old.join(touched, list(table.partitions), "left_semi")
                good = good.join(old.select(*table.key), list(table.key), "left_anti")
        writer = good.write.mode("append")
        (writer.partitionBy(*table.partitions) if table.partitions else writer).parquet(self.path(name))
        return bad

    def reject(self, name: str, rows: DataFrame, batch: str) -> None:
        """Keep rows (as JSON in ``row``) that didn't become any of the table's; a repeated batch replaces its own."""
        rows.select("row").write.mode("overwrite").json(f"{self.path(name)}_rejected/{batch}")

    def rejected(self, name: str) -> DataFrame:
        """``row``: all rows that were kept aside, each once however often it was delivered."""
        if not self.exists(f"{name}_rejected"):
            return self.spark.createDataFrame([], "row string")
        return self.spark.read.schema("row string").option("recursiveFileLookup", "true").json(f"{self.path(name)}_rejected").distinct()

    def overwrite_run(self, name: str, df: DataFrame) -> None:
        """Replace what the table has of the runs in ``df``: an upsert of whole runs, safe to repeat."""
        table = TABLES[name]
        good, bad = table.checked(self._shaped(table, df))
        if bad.limit(1).count():
            raise ValueError(f"rows of {name} break {bad.first()['violations']}")
        good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*table.partitions).parquet(self.path(name))

    def delete_run(self, name: str, run_id: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/run_id={run_id}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def insert_run(self, run: DataFrame, cells: DataFrame) -> None:
        """A new run and its cells; a run that exists is left as it is, its cells are made whole."""
        self.append("runs", run)
        self.overwrite_run("cells", cells)

    def update_run(self, run_id: str, **values) -> None:
        """Set counters of a run (finished_us, published_events, analyzed_events, inspected_records,
        lambda); an unknown run is an error."""
        allowed = {"finished_us", "published_events", "analyzed_events", "inspected_records", "lambda"}
        if not values or set(values) - allowed:
            raise ValueError(f"only {sorted(allowed)} can be set")
        rows = self.read("runs").filter(F.col("run_id") == run_id).collect()
        if not rows:
            raise LookupError(f"run {run_id} doesn't exist")
        self.overwrite_run("runs", self.spark.createDataFrame([rows[0].asDict() | values], TABLES["runs"].schema))

    def status(self, run_id: str):
        """The run's row."""
        row = self.read("runs").filter(F.col("run_id") == run_id).first()
        if row is None:
            raise LookupError(f"run {run_id} doesn't exist")
        return row

    def count(self, name: str, run_id: str) -> int:
        return self.read(name).filter(F.col("run_id") == run_id).count()

    def ordered_records(self, run_id: str) -> DataFrame:
        """A run's records by time and event, a missing device as an empty one."""
        out = self.read("records").filter(F.col("run_id") == run_id)
        return out.withColumn("device", F.coalesce("device", F.lit(""))).orderBy("time_us", "event_id")

    def canonical_claims(self, run_id: str) -> DataFrame:
        out = self.read("findings").filter((F.col("run_id") == run_id) & F.col("suppressed_by").isNull())
        return out.select("run_id", "event_id", "rule_id")

    def finding_counts(self, run_id: str) -> DataFrame:
        out = self.read("findings").filter(F.col("run_id") == run_id)
        return out.agg(F.count("*").alias("findings"), F.count_if(F.col("suppressed_by").isNull()).alias("canonical"))

    def audit(self, principal: str, action: str, resource: str, run_id: str | None = None, detail: str = "{}", timeout_s: float = AUDIT_S) -> bool:
        """Note an access, as well as it goes in ``timeout_s``: failing to is told by the result and counted in
        ``audits_dropped``, never raised, and a slow note doesn't keep the caller waiting."""
        row, noted = (time.time_ns() // 1000, run_id, principal, action, resource, detail), []

        def write() -> None:
            try:
                self.spark.createDataFrame([row], TABLES["audit"].schema).write.mode("append").json(self.path("audit"))
                noted.append(True)
            except Exception:  # told by the result
                pass

        if action and resource:
            thread = threading.Thread(target=write, daemon=True)
            thread.start()
            thread.join(timeout_s)
        self.audits_dropped += not noted
        return bool(noted)

    def inventory(self, run_id: str, fallback: DataFrame | None = None) -> DataFrame:
        """A run's cells by latitude, longitude and azimuth; from ``fallback`` if the store has none."""
        own = self.read("cells").filter(F.col("run_id") == run_id)
        if fallback is not None and own.limit(1).count() == 0:
            own = fallback.filter(F.col("run_id") == run_id)
        return own.orderBy("lat", "lon", "azimuth")


#: Tables that each role may read, and those it may add to. Rules and kernel never see the truth.
READABLE = {
    "analysis": ("cells", "records", "runs", "estimates"),
    "integrity": ("cells", "records", "runs", "findings"),
    "validation": ("truth", "estimates", "records", "cells", "findings", "runs", "metrics"),
    "persister": ("truth", "runs"),
}
WRITABLE = {"analysis": ("estimates", "audit"), "integrity": ("findings", "audit"), "validation": ("metrics", "audit"), "persister": ("truth", "audit")}


class View:
    """A store as a role may use it: reading or adding to any other table is a PermissionError."""

    def __init__(self, store: Store, role: str):
        self._store, self.role = store, role

    def read(self, name: str) -> DataFrame:
        if name not in READABLE[self.role]:
            raise PermissionError(f"{self.role} may not read {name}")
        return self._store.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        if name not in WRITABLE[self.role]:
            raise PermissionError(f"{self.role} may not add to {name}")
        return self._store.append(name, df)


def views(store: Store, role: str) -> View:
    if role not in READABLE:
        raise ValueError(f"role must be one of {sorted(READABLE)}")
    return View(store, role)
