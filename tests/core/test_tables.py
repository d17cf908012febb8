"""Store, messages, configuration, query service."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from cdrlens import queries
from cdrlens.functions import geometry as g
from cdrlens.operators import service
from cdrlens.schemas import TABLES
from cdrlens.sources import config, wire
from cdrlens.sources.store import Store

RUN = "11111111-2222-4333-8444-555555555555"
EVENTS = [f"00000000-0000-4000-8000-00000000000{k}" for k in range(1, 6)]


def record_rows(spark, ids=EVENTS, t=1_704_067_200_000_000):
    rows = [(RUN, e, k, t + k * 1_000_000, f"s{k % 2}", "d", "DATA", EVENTS[0], None if k == 2 else k, "A") for k, e in enumerate(ids)]
    return spark.createDataFrame(rows, TABLES["records"].schema)


def test_appends_add_each_key_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.read("records").count() == 0
    rows = record_rows(spark)
    bad = store.append("records", rows.unionByName(rows).unionByName(rows.limit(1).withColumn("event_type", F.lit("FAX")).withColumn("event_id", F.lit("x"))))
    assert [r.violations for r in bad.collect()] == [["event_type"]]
    store.append("records", rows)
    assert store.count("records", RUN) == 5
    store.append("records", record_rows(spark, [EVENTS[0], "new"], 1_704_067_200_000_000))
    assert store.count("records", RUN) == 6
    order = [r.event_id for r in store.ordered_records(RUN).collect()]
    assert order[0] == EVENTS[0] and len(order) == 6


def test_run_folders_are_pruned(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.append("records", record_rows(spark))
    plan = store.read("records").filter((F.col("run_id") == RUN) & (F.col("event_date") == "2024-01-01")).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "ReadSchema: struct<event_id:string>" in plan


def test_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    run = spark.createDataFrame([(RUN, "A", "urban", 1, None, 5, None, "{}", None, None, None)], TABLES["runs"].schema)
    cells = spark.createDataFrame([(RUN, "c", "s", 0.0, 65.0, 58.0, 25.0, 6.0, 900.0, 2100, "urban", "UMa", 38.0, 39.0)], TABLES["cells"].schema)
    store.insert_run(run, cells)
    store.insert_run(run, cells)
    assert store.read("runs").count() == 1 and store.read("cells").count() == 1
    store.update_run(RUN, published_events=7, **{"lambda": 1.5})
    assert (store.status(RUN)["published_events"], store.status(RUN)["lambda"]) == (7, 1.5)
    with pytest.raises(LookupError):
        store.update_run("none", published_events=1)
    with pytest.raises(ValueError):
        store.update_run(RUN, seed=1)
    with pytest.raises(ValueError):
        store.overwrite_run("cells", cells.withColumn("azimuth", F.lit(360.0)))
    other = cells.withColumn("run_id", F.lit("other"))
    assert store.inventory("other", other).count() == 1 and store.inventory(RUN, other).count() == 1
    store.delete_run("cells", RUN)
    assert store.read("cells").count() == 0
    assert store.audit("me", "read", "cells", RUN) and not Store(spark, "nowhere://x").audit("me", "read", "cells")


def test_messages(spark):
    rows = record_rows(spark)
    sent = wire.encode_records(rows)
    assert {r.key for r in sent.collect()} == {"s0", "s1"}
    broken = [("k", "{"), ("k", "{}"), ("k", json.dumps({"run_id": RUN, "event_id": "0" * 8 + "-0000-0000-0000-" + "0" * 12, "cell_id": EVENTS[0], "time": "2024-01-01T00:00:00Z"})), ("k", None)]
    good, bad = wire.decode_records(sent.unionByName(spark.createDataFrame(broken, "key string, value string")))
    assert bad.count() == 4
    assert sorted(map(tuple, good.drop("seq").collect())) == sorted(map(tuple, rows.select(good.columns).collect()))
    truth = spark.createDataFrame([(RUN, EVENTS[0], 5_000_000, 3, 38.0, 39.0, True, "C", None), (RUN, EVENTS[1], 5_000_000, 3, 38.0, 39.0, True, "Q", 2)], TABLES["truth"].schema)
    good, bad = wire.decode_truth(wire.encode_truth(truth))
    assert [r.event_id for r in good.collect()] == [EVENTS[0]] and bad.count() == 1


def test_scenarios():
    s = config.parse(json.dumps(queries.DEMO))
    assert s.profile.area_radius_km == 3 and s.profile.propagation_model == "UMa" and s.integrity.detection.activity_min_support == 2
    wrong = [("run", "scenario", "E"), ("run", "nmae", "x"), ("simulation", "tick_minutes", 7), ("network", "rx_sensitivity_dbm", 1), ("calibration", "split_ratio", 1), ("integrity", "rule_weights", {1: 1}), ("timing_advance", "technology", "5G"), ("network", "freq_bands", [{"mhz": 900, "weight": 0.5}])]
    for part, key, value in wrong:
        data = copy.deepcopy(queries.DEMO)
        data[part][key] = value
        with pytest.raises(config.ConfigError):
            config.parse(json.dumps(data))
    data = copy.deepcopy(queries.DEMO)
    data["extra"] = {}
    with pytest.raises(config.ConfigError):
        config.parse(json.dumps(data))
    with pytest.raises(config.ConfigError):
        config.parse("[")


def test_windows_boxes_and_statuses():
    day = service.DAY_US
    assert service.window(None, None) is None and service.window(10, None) == (10, 10 + day) and service.window(None, day) == (0, day)
    for call in (lambda: service.window(5, 5), lambda: service.Box(0, 0, 0, 1), lambda: service.Box(-181, 0, 0, 1)):
        with pytest.raises(service.BadRequest):
            call()
    assert [service.status_of(e) for e in (service.BadRequest(), service.TooManyGeometries(1, ""), service.NotFound(), KeyError())] == [400, 400, 404, 500]


def test_limits_refuse(spark):
    rows = spark.range(5).selectExpr("concat('{\"n\":', id, '}') AS feature")
    assert json.loads(service.collection(rows, 5))["features"][4] == {"n": 4}
    with pytest.raises(service.TooManyGeometries):
        service.collection(rows, 4)
    with pytest.raises(service.TooManyGeometries):
        service.limited(rows, 4)
    assert json.loads(service.collection(rows.limit(0))) == {"type": "FeatureCollection", "features": []}


def test_collections_hold_all(spark):
    rows = spark.range(0, 1234, numPartitions=3).selectExpr("concat('{\"n\":', id, '}') AS feature")
    made = [json.loads(r.document) for r in service.collections(rows).collect()]
    assert {d["type"] for d in made} == {"FeatureCollection"} and max(len(d["features"]) for d in made) <= service.MAX_GEOMETRIES
    assert sorted(f["n"] for d in made for f in d["features"]) == list(range(1234))
    assert [len(json.loads(r.document)["features"]) for r in service.collections(rows.coalesce(1), 1234).collect()] == [1234]
    assert service.collections(rows.limit(0)).count() == 0


def test_collection_size_over_the_limit(spark, tmp_path):
    """More cells in the box than one request may ask for."""
    from cdrlens.catalogue import QUERIES

    spark.range(2000).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    want = 3 * sum(5 <= s % 40 <= 30 and 5 <= s * 7 % 50 <= 35 for s in range(2000))
    got = [tuple(r) for r in QUERIES["collection_size"](spark, str(tmp_path)).collect()]
    assert want > service.MAX_GEOMETRIES and got == [("FeatureCollection", want)]
    spark.range(0).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "none" / "supplier.parquet"))
    assert [tuple(r) for r in QUERIES["collection_size"](spark, str(tmp_path / "none")).collect()] == [("FeatureCollection", 0)]


def test_features_keep_nulls(spark):
    rows = spark.createDataFrame([("a", None, None, 1), ("b", 38.0, 39.0, None)], "id string, lat double, lon double, n int")
    made = [json.loads(r.feature) for r in service.features(rows, service.point(F.col("lat"), F.col("lon")), ["id", "n"]).collect()]
    assert made[0]["geometry"] is None and made[1] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [39.0, 38.0]}, "properties": {"id": "b", "n": None}}


def test_estimates_in_a_box(spark):
    shape = bytes(g.to_wkb(g.disk(39.0, 38.0, 0.01)))
    table = spark.createDataFrame([(RUN, EVENTS[0], 1, "M", 0.9, shape, 1.23456789)], "run_id string, event_id string, time_us long, method string, confidence double, geometry binary, area_km2 double")
    records = spark.createDataFrame([(RUN, EVENTS[0], "s", 7)], "run_id string, event_id string, subscriber string, time_us long")
    found = service.estimates(table, records, RUN, "s", box=service.Box(38.9, 37.9, 39.1, 38.1))
    assert [(r.time_us, r.area_km2) for r in found.collect()] == [(7, 1.234568)]
    assert service.estimates(table, records, RUN, "s", box=service.Box(30, 30, 31, 31)).count() == 0
    feature = json.loads(service.region_features(found, ["event_id", "method"]).first().feature)
    assert feature["geometry"]["type"] == "MultiPolygon" and feature["properties"]["method"] == "M"
    for bad in ({"method": "Q"}, {"confidence": 0.7}):
        with pytest.raises(service.BadRequest):
            service.estimates(table, records, RUN, "s", **bad)
    with pytest.raises(service.BadRequest):
        service.estimates(table, records, "", "s")
