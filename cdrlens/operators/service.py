"""Read-only queries over a run: filters, GeoJSON, limits and k-anonymous aggregates."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geo import haversine_m
from ..functions.mathops import COL
from ..runtime import ship

MAX_GEOMETRIES, K_ANONYMITY = 500, 5
DAY_US = 86_400_000_000
METHODS, CONFIDENCES, RULES = ("B0", "B1", "M"), (0.5, 0.9, 0.95, -1.0), (1, 2, 3, 4, 5)
_KEEP_NULLS = {"ignoreNullFields": "false"}


class BadRequest(ValueError):
    """The caller's parameters are wrong."""


class TooManyGeometries(BadRequest):
    """The answer would have more features than allowed; it is refused, never cut off."""

    def __init__(self, limit: int, hint: str):
        super().__init__(f"more than {limit} geometries; {hint}")


class NotFound(LookupError):
    """The run doesn't exist."""


class OutOfTime(TimeoutError):
    """The answer took longer than a request may."""


#: Seconds that a request may take.
REQUEST_S = 15.0


def within(seconds: float, spark: SparkSession, call: Callable):
    """``call()``, if it ends in time; else its jobs are cancelled and :class:`OutOfTime` is raised."""
    done, group = [], f"request-{uuid.uuid4().hex}"

    def work() -> None:
        spark.sparkContext.setJobGroup(group, "request", interruptOnCancel=True)
        try:
            done.append((True, call()))
        except Exception as e:  # handed to the caller
            done.append((False, e))

    thread = InheritableThread(target=work)
    thread.daemon = True
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        ended = threading.Event()
        while thread.is_alive() and not ended.wait(0.05):  # a job may be submitted after the first cancelling
            spark.sparkContext.cancelJobGroup(group)
        raise OutOfTime(f"no answer in {seconds:g} s")
    ok, out = done[0]
    if not ok:
        raise out
    return out


def require_run(runs: DataFrame, run_id: str) -> None:
    if _run(runs, run_id).limit(1).count() == 0:
        raise NotFound(f"run {run_id} doesn't exist")


#: What an error is to a client.
def status_of(error: Exception) -> int:
    return 400 if isinstance(error, BadRequest) else 404 if isinstance(error, NotFound) else 500


@dataclass(frozen=True)
class Box:
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def __post_init__(self):
        if not (-180 <= self.min_lon < self.max_lon <= 180 and -90 <= self.min_lat < self.max_lat <= 90):
            raise BadRequest("the box must lie within the longitudes and latitudes and have an extent")

    def holds(self, lat: Column, lon: Column) -> Column:
        return lat.between(self.min_lat, self.max_lat) & lon.between(self.min_lon, self.max_lon)


def window(start_us: int | None, end_us: int | None) -> tuple[int, int] | None:
    """A half-open time window; one end alone means a day, none means all time."""
    if start_us is None and end_us is None:
        return None
    start = end_us - DAY_US if start_us is None else start_us
    end = start_us + DAY_US if end_us is None else end_us
    if end <= start:
        raise BadRequest("the window must end after it starts")
    return start, end


def _run(df: DataFrame, run_id: str) -> DataFrame:
    if not run_id:
        raise BadRequest("run_id is needed")
    return df.filter(F.col("run_id") == run_id)


def limited(df: DataFrame, limit: int = MAX_GEOMETRIES, hint: str = "narrow the request") -> DataFrame:
    """``df`` if it has ``limit`` rows at most; looks at one row more, never at all."""
    if df.limit(limit + 1).count() > limit:
        raise TooManyGeometries(limit, hint)
    return df


def _in_window(df: DataFrame, span: tuple[int, int] | None, column: str) -> DataFrame:
    return df if span is None else df.filter((F.col(column) >= span[0]) & (F.col(column) < span[1]))


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs first; 50 for a limit outside 1 to 200."""
    return runs.orderBy(F.desc("started_us"), "run_id").limit(limit if 0 < limit <= 200 else 50)


def subscribers(records: DataFrame, estimates: DataFrame, run_id: str, limit: int = 25) -> DataFrame:
    """Subscribers with model estimates, most first; 25 for a limit outside 1 to 100. Model estimates are
    made distinct by event before the join, so a record's several rows don't multiply."""
    model = _run(estimates, run_id).filter(F.rtrim("method") == "M").select("run_id", "event_id").distinct().withColumn("has", F.lit(1))
    rows = _run(records, run_id).select("run_id", "event_id", "subscriber").distinct().join(model, ["run_id", "event_id"], "left")
    out = rows.groupBy("subscriber").agg(F.count("*").alias("records"), F.count("has").alias("estimates")).filter("estimates > 0")
    return out.orderBy(F.desc("estimates"), "subscriber").limit(limit if 0 < limit <= 100 else 25)


def metrics(table: DataFrame, run_id: str) -> DataFrame:
    return _run(table, run_id).orderBy("method", "confidence", "partition_key")


def integrity_metrics(table: DataFrame, run_id: str) -> DataFrame:
    return _run(table, run_id).orderBy("rule_id")


def cells(table: DataFrame, run_id: str, box: Box | None = None) -> DataFrame:
    out = _run(table, run_id)
    out = out.filter(box.holds(F.col("lat"), F.col("lon"))) if box else out
    return out.select("cell_id", "site_id", "azimuth", "beam_width", "freq_mhz", F.round("r_max_m", 1).alias("r_max_m"), "model_type", "lat", "lon")


def estimates(table: DataFrame, records: DataFrame, run_id: str, subscriber: str, start_us: int | None = None, end_us: int | None = None, method: str = "", confidence: float = 0, box: Box | None = None) -> DataFrame:
    """A subscriber's estimates; empty method and zero confidence mean all. A box keeps regions that meet it."""
    if not subscriber:
        raise BadRequest("a subscriber is needed")
    if method and method not in METHODS:
        raise BadRequest(f"method must be one of {METHODS}")
    if confidence and confidence not in CONFIDENCES:
        raise BadRequest(f"confidence must be one of {CONFIDENCES}")
    r = _in_window(_run(records, run_id).filter(F.col("subscriber") == subscriber), window(start_us, end_us), "time_us")
    e = _run(table, run_id)
    e = e.filter(F.rtrim("method") == method) if method else e
    e = e.filter(F.col("confidence") == confidence) if confidence else e
    out = e.drop("time_us").join(r.select("run_id", "event_id", "time_us"), ["run_id", "event_id"])
    if box:
        ship(table.sparkSession)

        @F.pandas_udf("boolean")
        def meets(shape: pd.Series) -> pd.Series:
            return shape.map(lambda w: g.meets_box(g.from_wkb(w), box.min_lon, box.min_lat, box.max_lon, box.max_lat))

        out = out.filter(meets("geometry"))
    return out.withColumn("area_km2", F.round("area_km2", 6))


def findings(table: DataFrame, records: DataFrame, inventory: DataFrame, run_id: str, rule_id: int = 0, canonical_only: bool = True, start_us: int | None = None, end_us: int | None = None, box: Box | None = None) -> DataFrame:
    """Findings with the place of their record's cell, which is null where the cell is unknown."""
    if rule_id and rule_id not in RULES:
        raise BadRequest("rule_id must be 1 to 5")
    f = _in_window(_run(table, run_id), window(start_us, end_us), "time_us")
    f = f.filter("suppressed_by is null") if canonical_only else f
    f = f.filter(F.col("rule_id") == rule_id) if rule_id else f
    out = f.join(_run(records, run_id).select("run_id", "event_id", "cell_id"), ["run_id", "event_id"])
    out = out.join(_run(inventory, run_id).select("run_id", "cell_id", "lat", "lon"), ["run_id", "cell_id"], "left")
    out = out.filter(box.holds(F.col("lat"), F.col("lon"))) if box else out
    return out.select("event_id", "rule_id", "rule_name", F.round("margin", 4).alias("margin"), "evidence", "detected_in", "suppressed_by", "time_us", F.col("lat").isNotNull().alias("cell_known"), "lat", "lon")


def activity(records: DataFrame, inventory: DataFrame, run_id: str, k: int = K_ANONYMITY, box: Box | None = None) -> DataFrame:
    """Records and distinct subscribers of each known cell with ``k`` subscribers or more."""
    if k < 1:
        raise BadRequest("k must be 1 or more")
    out = _activity(records, inventory, run_id).filter(F.col("subscribers") >= k)
    out = out.filter(box.holds(F.col("lat"), F.col("lon"))) if box else out
    return out


def _activity(records: DataFrame, inventory: DataFrame, run_id: str) -> DataFrame:
    by_cell = _run(records, run_id).groupBy("cell_id").agg(F.count("*").alias("records"), F.count_distinct("subscriber").alias("subscribers"))
    return by_cell.join(_run(inventory, run_id).select("cell_id", "lat", "lon"), "cell_id")


def suppressed_cells(records: DataFrame, inventory: DataFrame, run_id: str, k: int = K_ANONYMITY) -> DataFrame:
    """How many known cells have fewer than ``k`` subscribers, wherever they are."""
    return _activity(records, inventory, run_id).agg(F.count_if(F.col("subscribers") < k).alias("suppressed"))


def point(lat: Column, lon: Column) -> Column:
    """GeoJSON point, null where a coordinate is."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def features(df: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One JSON feature a row; null fields stay in it."""
    made = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(made, _KEEP_NULLS).alias("feature"))


def region_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """As :func:`features`, with geometries from WKB multipolygons."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def feature(shape: pd.Series, properties: pd.Series) -> pd.Series:
        out = []
        for w, p in zip(shape, properties, strict=True):
            shown = {"type": "MultiPolygon", "coordinates": g.to_coordinates(g.from_wkb(w))} if w is not None else None
            out.append(json.dumps({"type": "Feature", "geometry": shown, "properties": json.loads(p)}))
        return pd.Series(out)

    return df.select(feature("geometry", F.to_json(F.struct(*properties), _KEEP_NULLS)).alias("feature"))


def _document(made: list[str]) -> str:
    return '{"type":"FeatureCollection","features":[' + ",".join(sorted(made)) + "]}"


def collection(made: DataFrame, limit: int = MAX_GEOMETRIES, hint: str = "narrow the request") -> str:
    """A feature collection of at most ``limit`` features, as one document; more are refused."""
    rows = made.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooManyGeometries(limit, hint)
    return _document([r["feature"] for r in rows])


def collections(made: DataFrame, limit: int = MAX_GEOMETRIES) -> DataFrame:
    """All features, however many there are, as rows of ``document``: feature collections of at most ``limit``
    features each. They are made where the rows are; the driver holds none of them."""
    ship(made.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for frame in frames:
            held += frame["feature"].tolist()
            whole = len(held) - len(held) % limit
            if whole:
                yield pd.DataFrame({"document": [_document(held[k : k + limit]) for k in range(0, whole, limit)]})
                held = held[whole:]
        if held:
            yield pd.DataFrame({"document": [_document(held)]})

    return made.select("feature").mapInPandas(work, "document string")


def nearby_sites(inventory: DataFrame, run_id: str, lat: float, lon: float, radius_m: float, limit: int = 50) -> DataFrame:
    """Sites within a radius of a place on the sphere, nearest first."""
    d = haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"), COL)
    out = _run(inventory, run_id).select("site_id", d.alias("distance_m")).distinct()
    return out.filter(F.col("distance_m") <= radius_m).orderBy("distance_m", "site_id").limit(limit)
