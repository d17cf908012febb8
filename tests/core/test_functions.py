"""Closed forms, frozen vectors and properties of the function library."""

import hashlib
import hmac
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cdrlens.functions import clock, geo, identity, radio, timing
from cdrlens.functions import geometry as g
from cdrlens.functions.geo import HexLattice, Plane
from cdrlens.functions.mathops import COL, normal_cdf

RUN = "11111111-2222-4333-8444-555555555555"
#: Agent, tick, sequence number, event id, split number, part.
VECTORS = [
    (42, 8639, 0, "6e89a177-fb74-5d45-aa75-cd6d47b2a41f", 0.98626186358900503, "V"),
    (42, 8639, 1, "3afa79dc-78e3-51c6-a136-7fde9d5c7220", 0.00040636319810083, "C"),
    (1, 0, 0, "f97a725f-773d-522a-a4f3-19799e145606", 0.90415044947628886, "V"),
    (0, 1, 0, "e2445eb0-ef03-5bae-8784-d8c6a6320579", 0.69421431252939469, "C"),
]


def test_frozen_ids_and_splits(spark):
    df = spark.createDataFrame([v[:3] for v in VECTORS], "a long, t long, s long")
    event = identity.event_id(F.lit(RUN), F.col("a"), F.col("t"), F.col("s"))
    df = df.withColumn("e", event).withColumn("u", identity.split_uniform(F.col("e"), 42)).withColumn("p", identity.partition_key(F.col("e"), 42))
    got = {(r.a, r.t, r.s): r for r in df.collect()}
    for a, t, s, event_id, u, part in VECTORS:
        r = got[a, t, s]
        assert (r.e, r.p) == (event_id, part) and abs(r.u - u) < 1e-14
    nil = spark.range(1).select(identity.split_uniform(F.lit("00000000-0000-0000-0000-000000000000"), 42).alias("u")).first()
    assert abs(nil.u - 0.01794211329003259) < 1e-14


def test_pseudonyms_are_hmac(spark):
    for salt in (b"s" * 32, b"t" * 100):
        got = spark.createDataFrame([(i,) for i in range(5)], "i long").select("i", identity.pseudonym(identity.subscriber_number(F.col("i")), salt).alias("p")).collect()
        for r in got:
            assert r.p == hmac.new(salt, f"9050{r.i:08d}".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        identity.pseudonym(F.lit("x"), b"short")


@given(st.floats(0, 60_000), st.sampled_from(["LTE", "GSM"]))
def test_timing_advance_ring_holds_the_distance(d, technology):
    n = int(timing.from_distance(np.array([d]), technology)[0])
    inner, outer = timing.ring(n, technology)
    assert inner <= d < outer


@given(st.integers(0, 500))
def test_timing_advance_at_ring_edges(n):
    for technology in ("LTE", "GSM"):
        assert int(timing.from_distance(np.array([timing.ring(n, technology)[0]]), technology)[0]) == n


def test_timing_advance_rejects():
    with pytest.raises(ValueError):
        timing.resolution("UMTS")
    with pytest.raises(ValueError):
        timing.ring(-1, "LTE")
    assert timing.largest(5000, "LTE") == 64


@given(st.floats(-1e6, 1e6))
def test_wrapped_angles(a):
    w = float(geo.wrap_degrees(np.array([a]))[0])
    assert -180 < w <= 180 and abs(math.remainder(a - w, 360)) < 1e-6


def test_columns_and_arrays_agree(spark):
    df = spark.range(1, 9000, 13).select(F.col("id").cast("double").alias("x"), (F.col("id") * 0.7 - 2000).alias("y"))
    for model in radio.MODELS.values():
        power = radio.received_power_dbm(model, F.lit(58.0), F.lit(30.0), F.lit(65.0), F.lit(6.0), F.lit(25.0), F.lit(2100.0), F.col("x"), F.col("y"), m=COL)
        rows = df.select("x", "y", power.alias("p")).toPandas()
        want = radio.received_power_dbm(model, 58.0, 30.0, 65.0, 6.0, 25.0, 2100.0, rows.x.to_numpy(), rows.y.to_numpy())
        assert np.abs(rows.p - want).max() < 1e-9


def test_path_loss_grows_and_blockage_costs():
    d = np.arange(20.0, 5000.0, 10.0)
    for model in radio.MODELS.values():
        open_, blocked = (model.path_loss_db(d, 25.0, 1.5, 2100.0, los) for los in (True, False))
        assert (np.diff(open_) > 0).all() and (blocked >= open_).all()
        p = model.los_probability(d, 1.5)
        assert ((p >= 0) & (p <= 1)).all() and (np.diff(p) <= 1e-12).all()


def test_urban_loss_near_hata():
    """Within 10 dB of the Okumura-Hata formula where both hold."""
    for d in (1.0, 2.0, 5.0):
        hata = 69.55 + 26.16 * math.log10(900) - 13.82 * math.log10(30) - (3.2 * math.log10(11.75 * 1.5) ** 2 - 4.97) + (44.9 - 6.55 * math.log10(30)) * math.log10(d)
        ours = float(radio.MODELS["UMa"].path_loss_db(np.array([d * 1000]), 30.0, 1.5, 900.0, False)[0])
        assert abs(hata - ours) < 10


def test_coverage_range_is_where_the_power_ends():
    model = radio.MODELS["UMa"]
    r = radio.coverage_range_m(model, 58, -110, 25, 2100, 65, 6)
    at = radio.received_power_dbm(model, 58.0, 0.0, 65.0, 6.0, 25.0, 2100.0, np.array([0.0]), np.array([r]))
    assert abs(float(at[0]) + 110) < 1e-6
    with pytest.raises(ValueError):
        radio.coverage_range_m(model, -500, -110, 25, 2100, 65, 6)


def test_registry():
    with pytest.raises(ValueError):
        radio.register(radio.MODELS["UMa"])
    with pytest.raises(ValueError):
        radio.model_named("none")
    assert radio.MODELS["UMa"].outside(6000, 25, 1.5, 2100) and radio.MODELS["UMa"].outside(500, 25, 1.5, 2100) is None


def test_normal_cdf():
    x = np.array([-3.0, 0.0, 1.0])
    assert np.allclose(normal_cdf(x), [0.0013498980316301, 0.5, 0.841344746068543], atol=1e-14)


@given(st.floats(-5000, 5000), st.floats(-5000, 5000))
def test_hexagon_of_a_point_is_the_nearest(x, y):
    lattice = HexLattice(100.0)
    q, r = (int(v[0]) for v in lattice.at(np.array([x]), np.array([y])))
    own = math.dist(lattice.centre(q, r), (x, y))
    assert all(own <= math.dist(lattice.centre(q + a, r + b), (x, y)) + 1e-6 for a, b in HexLattice.STEPS)


def test_hex_distance_of_neighbours():
    assert {int(geo.hex_distance(0, 0, a, b)) for a, b in HexLattice.STEPS} == {1}


def test_plane_round_trip():
    p = Plane(38.6748, 39.2225)
    lon, lat = p.lonlat(np.array([1234.5]), np.array([-987.6]))
    assert np.allclose([p.x(lon), p.y(lat)], [[1234.5], [-987.6]])
    with pytest.raises(ValueError):
        Plane(89, 0)


@settings(max_examples=60, deadline=None)
@given(st.floats(0, 359), st.floats(10, 360), st.floats(300, 2000))
def test_sector_cells_and_areas(azimuth, beam, radius):
    lattice = HexLattice(60.0)
    sector = g.Sector(100.0, -50.0, azimuth, beam, radius)
    q, r = sector.cells(lattice)
    far_q, far_r = lattice.disk(100.0, -50.0, radius)
    inside = sector.contains(*lattice.centre(far_q, far_r))
    assert set(zip(q.tolist(), r.tolist())) == set(zip(far_q[inside].tolist(), far_r[inside].tolist()))
    assert abs(g.plane_area(sector.outline()) - math.pi * radius**2 * beam / 360) < 0.001 * math.pi * radius**2
    assert g.plane_area(sector.outline()) <= g.plane_area(g.disk(100.0, -50.0, radius)) * (1 + 1e-9)


@settings(max_examples=60, deadline=None)
@given(st.floats(-150, 150), st.floats(-150, 150), st.floats(1, 250))
def test_disk_overlap_against_sampling(x, y, radius):
    hexagon = HexLattice(100.0).corners(np.array([0]), np.array([0]))
    got = float(g.disk_overlap(hexagon, x, y, radius)[0])
    xs, ys = np.meshgrid(np.linspace(-60, 60, 241), np.linspace(-60, 60, 241))
    ring = np.concatenate([hexagon[0], hexagon[0][:1]])
    inside = g.in_ring(ring, xs.ravel(), ys.ravel()) & (np.hypot(xs.ravel() - x, ys.ravel() - y) <= radius)
    assert abs(got - inside.sum() * 0.25) < 130


def test_rings_share_a_hexagon_out():
    hexagons = HexLattice(100.0).corners(np.array([3, 5]), np.array([2, 7]))
    shares = sum(g.ring_shares(hexagons, 0.0, 0.0, 78.12 * n, 78.12 * (n + 1)) for n in range(40))
    assert np.allclose(shares, 1.0)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=40))
def test_hexagons_become_valid_shapes(cells):
    lattice = HexLattice(50.0)
    q, r = (np.array(v) for v in zip(*cells, strict=True))
    shape = g.hexagons_to_shape(q, r, lattice)
    assert abs(g.plane_area(shape) - len(cells) * lattice.cell_area) < 1e-6
    assert all(g.contains(shape, *lattice.centre(a, b))[0] for a, b in cells)
    around = {(a + x, b + y) for a, b in cells for x, y in HexLattice.STEPS} - cells
    assert not any(g.contains(shape, *lattice.centre(a, b))[0] for a, b in around)
    assert g.is_valid(shape)
    back = g.from_wkb(g.to_wkb(shape))
    assert all(np.array_equal(a, b) for p, s in zip(shape, back, strict=True) for a, b in zip(p, s, strict=True))


def test_ring_of_hexagons_has_a_hole():
    q, r = (np.array(v) for v in zip(*HexLattice.STEPS, strict=True))
    shape = g.hexagons_to_shape(q, r, HexLattice(10.0))
    assert len(shape) == 1 and len(shape[0]) == 2 and not g.contains(shape, 0.0, 0.0)[0]


def test_sphere_area_of_a_disk():
    plane = Plane(38.6748, 39.2225)
    area = g.sphere_area_km2(g.to_lonlat(g.disk(0, 0, 1000.0), plane))
    assert abs(area - math.pi) < 0.02


def test_boxes_meet_shapes():
    shape = g.disk(0, 0, 10.0)
    assert g.meets_box(shape, -1, -1, 1, 1) and g.meets_box(shape, 9, -20, 30, 20) and not g.meets_box(shape, 11, 11, 20, 20)


def test_counter_based_numbers_are_uniform():
    u = identity.uniform(7, 1, 2, np.arange(20_000) % 100, np.arange(20_000) // 100)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    z = identity.standard_normal(identity.chain(np.uint64(1), np.arange(20_000)))
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03


def test_times_are_utc_in_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.createDataFrame([(1_704_067_199_999_999,), (0,), (-1,)], "t long")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [tuple(r) for r in rows.select(clock.text("t"), clock.day("t")).collect()]
            assert got == [("2023-12-31T23:59:59.999999Z", "2023-12-31"), ("1970-01-01T00:00:00.000000Z", "1970-01-01"), ("1969-12-31T23:59:59.999999Z", "1969-12-31")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
