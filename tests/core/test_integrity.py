"""Rules on hand-made sequences, resolution, and measurement."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cdrlens.operators import integrity as it
from cdrlens.operators import measurement as ms

RECORD = "run_id string, event_id string, seq long, time_us long, subscriber string, device string, cell_id string, scenario string"
CELL = "run_id string, cell_id string, x double, y double"
MINUTE = 60_000_000

#: Places in metres with minutes since the record before (None: an unknown cell), and the expected hit.
SEQUENCES = {
    "plausible": ([((0, 0), 0), ((10000, 0), 144), ((0, 0), 144)], None),
    "jump": ([((0, 0), 0), ((100, 0), 5), ((40000, 0), 5), ((200, 0), 5), ((300, 0), 5)], (2, 1.596)),
    "zero interval": ([((0, 0), 0), ((100, 0), 5), ((10000, 0), 0), ((200, 0), 5), ((300, 0), 5)], (2, 1e6)),
    "same tick, same cell": ([((0, 0), 0), ((0, 0), 0), ((0, 0), 0)], None),
    "undecidable": ([((0, 0), 0), ((40000, 0), 5)], None),
    "symmetric": ([((0, 0), 0), ((-20000, 0), 60), ((20000, 0), 5), ((0, 0), 60)], None),
    "unknown cell inside": ([((0, 0), 0), ((100, 0), 5), (None, 5), ((200, 0), 5), ((300, 0), 5)], None),
}


def sequence(spark, places, subscriber="s"):
    rows, cells, t = [], {}, 10_000 * MINUTE
    for k, (place, gap) in enumerate(places):
        t += gap * MINUTE
        cell = "unknown" if place is None else f"c{place}"
        if place is not None:
            cells[cell] = place
        rows.append(("r", f"e{k}", k, t, subscriber, "d", cell, "A"))
    return spark.createDataFrame(rows, RECORD), spark.createDataFrame([("r", c, float(x), float(y)) for c, (x, y) in cells.items()], CELL)


@pytest.mark.parametrize("name", SEQUENCES)
def test_velocity(spark, name):
    places, want = SEQUENCES[name]
    hits = it.impossible_speeds(*sequence(spark, places)).collect()
    if want is None:
        assert hits == []
        return
    (hit,) = hits
    assert hit.event_id == f"e{want[0]}" and hit.margin == pytest.approx(want[1], rel=1e-3)
    proof = json.loads(hit.evidence)
    assert proof["v"] == 1 and proof["rule"] == 2 and proof["zero_interval"] == (name == "zero interval")
    assert ("capped" in proof) == (name == "zero interval")


def records(spark, rows):
    return spark.createDataFrame([("r", e, k, t, s, d, c, "A") for k, (e, t, s, d, c) in enumerate(rows)], RECORD)


@pytest.mark.parametrize("block", [None, 2])
def test_time_order(spark, block):
    rows = [
        ("a", 100, "s", "d", "c"), ("b", 100, "s", "d", "c"), ("c", 300, "s", "d", "c"), ("d", 200, "s", "d", "c"), ("e", 250, "s", "d", "c"),
        ("f", 50, "t", "d", "c"), ("g", 60, "t", "d", "c"), ("h", 10, "", "d", "c"), ("i", 5, "", "d", "c"), ("j", 300, "s", "d", "c"), ("k", 299, "s", "d", "c"),
    ]
    rows = [(e, 1_000_000_000 + t * 1_000_000, s, d, c) for e, t, s, d, c in rows]
    hits = {r.event_id: r for r in it.time_backsteps(records(spark, rows), block=block).collect()}
    assert set(hits) == {"d", "e", "k"}
    assert json.loads(hits["d"].evidence)["prev_event_id"] == "c" and json.loads(hits["k"].evidence)["prev_event_id"] == "c"
    assert json.loads(hits["e"].evidence)["backstep_s"] == 50.0 and hits["e"].margin == 1.0
    late = {r.event_id for r in it.time_backsteps(records(spark, rows), it.Rules(tolerance_s=60), block).collect()}
    assert late == {"d"}


def test_inventory(spark):
    cells = spark.createDataFrame([("r", "c", 0.0, 0.0)], CELL)
    hits = it.unknown_cells(records(spark, [("a", 1, "s", "d", "c"), ("b", 2, "s", "d", "zz")]), cells).collect()
    assert [(h.event_id, h.margin) for h in hits] == [("b", 1.0)] and json.loads(hits[0].evidence)["inventory_size"] == 1
    with pytest.raises(ValueError):
        it.require_inventory(cells, "other")


def test_device_activity(spark):
    rows = [(f"a{i}", i, "s", "d1", "c") for i in range(3)] + [("x", 9, "s", "d0", "c"), ("n", 10, "s", "", "c")]
    rows += [("t1", 1, "t", "d1", "c"), ("t2", 2, "t", "d2", "c")]  # no device has support
    rows += [("u1", 1, "u", "b", "c"), ("u2", 2, "u", "b", "c"), ("u3", 3, "u", "a", "c"), ("u4", 4, "u", "a", "c")]  # a tie: the smaller name is the mode
    hits = {h.event_id: h.margin for h in it.device_changes(records(spark, rows)).collect()}
    assert hits == {"x": 2.0, "u1": 2.0, "u2": 2.0}


HIT = "run_id string, event_id string, time_us long, scenario string, rule_id int, margin double, evidence string, phase string"


def hits_frame(spark, pairs):
    return spark.createDataFrame([("r", e, 1, "A", rule, 2.0, '{"v":1}', it.PHASE[rule]) for e, rule in pairs], HIT)


def test_resolution_and_reruns(spark):
    hits = hits_frame(spark, [("a", 5), ("a", 3), ("a", 2), ("b", 5), ("b", 2), ("c", 2), ("c", 2)])
    got = {(r.event_id, r.rule_id): r.suppressed_by for r in it.resolve(hits).collect()}
    # the stream phase comes first, then precedence
    assert got == {("a", 3): None, ("a", 5): 3, ("a", 2): 3, ("b", 5): None, ("b", 2): 5, ("c", 2): None}
    claims = it.resolve(hits).filter("suppressed_by is null").select("run_id", "event_id", "rule_id")
    again = {(r.event_id, r.rule_id): r.suppressed_by for r in it.resolve(hits, claims).collect()}
    assert again == {("a", 5): 3, ("a", 2): 3, ("b", 2): 5}


def test_bad_hits_are_set_aside(spark):
    rows = [("r", "a", 1, "A", 1, 1.0, '{"v":1}', "stream"), ("r", "b", 1, "A", 4, 1.0, '{"v":1}', "batch"), ("r", None, 1, "A", 1, 1.0, '{"v":1}', "stream"), ("r", "c", 1, "Z", 1, 1.0, '{"v":1}', "stream"), ("r", "d", 1, "A", 1, 1.0, "{}", "stream"), ("r", "e", 1, "A", 1, 0.5, '{"v":1}', "stream")]
    good, bad = it.valid_hits(spark.createDataFrame(rows, HIT))
    assert [r.event_id for r in good.collect()] == ["a"] and bad.count() == 5


def test_clamping(spark):
    values = [float("nan"), float("inf"), float("-inf"), 0.5, 3.0, 2e6]
    got = [r.m for r in spark.createDataFrame([(v,) for v in values], "v double").select(it.clamp_margin(F.col("v")).alias("m")).collect()]
    assert got == [1e6, 1e6, 1.0, 1.0, 3.0, 1e6]
    for key in ("lat", "Agent_id", "v", "true_location"):
        with pytest.raises(ValueError):
            it.evidence(1, {key: F.lit(1)})


@given(st.integers(0, 500), st.integers(0, 500))
def test_wilson_holds_the_share(k, n):
    k = min(k, n)
    low, high = ms.wilson_value(k, n)
    assert 0 <= low <= high <= 1
    if n:
        assert low - 1e-12 <= k / n <= high + 1e-12


def test_wilson_columns(spark):
    cases = [(3, 3), (100, 100), (45, 50), (0, 10), (0, 0)]
    low, high = ms.wilson(F.col("k"), F.col("n"))
    for r in spark.createDataFrame(cases, "k long, n long").select("k", "n", low.alias("a"), high.alias("b")).collect():
        assert (r.a, r.b) == pytest.approx(ms.wilson_value(r.k, r.n), abs=1e-12)


def test_partition_guard():
    for bad in ("", "c", "X", None):
        with pytest.raises(ValueError):
            ms.partition(bad)


def test_gaps(spark):
    row = it.consecutive_gaps(records(spark, [("a", 0, "s", "", "c"), ("b", 4_000_000, "s", "", "c"), ("c", 10_000_000, "s", "", "c")])).first()
    assert (row.gaps, row.median_gap_s) == (2, 5.0)


def test_phases_keep_to_their_rules(spark):
    rows, cells = sequence(spark, SEQUENCES["jump"][0])
    assert it.phase_hits(it.BATCH, rows, cells, which=(2,)).count() == 1
    for bad in ((it.STREAM, (5,)), (it.BATCH, (1,)), ("other", None)):
        with pytest.raises(ValueError):
            it.phase_hits(bad[0], rows, cells, which=bad[1])
