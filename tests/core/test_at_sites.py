"""Queries against their SQL on places that small tables lack: sites on the lattice, places on its edges."""

import datetime
from types import SimpleNamespace

import duckdb
import numpy as np

from cdrlens import catalogue, queries
from cdrlens.functions import geometry
from cdrlens.operators import calibration, estimation
from cdrlens.operators.estimation import CellKernel
from cdrlens.sources.adapters import Adapted


def like_sql(spark, folder, name, suppliers, events):
    """Rows of a query, which are the rows of its SQL. events: (event_id, user_id)."""
    spark.range(suppliers).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    rows = [(e, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=e), u, "view") for e, u in events]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    for t in ("supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    asked = con.execute(catalogue.SQL[name])
    at = [[d[0] for d in asked.description].index(c) for c in got.columns]
    got, want = sorted(map(tuple, got.collect()), key=str), sorted((tuple(r[i] for i in at) for r in asked.fetchall()), key=str)
    assert got == want
    return got


#: Events of the one site whose number is 200, which is a hexagon's centre; every 247th is at the site itself.
AT_SITE = [(247 * k, 199 - 247 * k % 3) for k in range(60)]


def test_hexagons_centred_on_the_site(spark, tmp_path):
    (row,) = like_sql(spark, tmp_path, "calibration_diagnostics", 201, AT_SITE)
    samples, in_wedge, in_region, _, _ = row
    assert 0 < in_region < in_wedge <= samples
    a = Adapted(spark, str(tmp_path))
    whole = calibration.diagnostics(calibration.calibration_set(a.records, a.truth), a.cells, queries.SETTINGS).first()
    assert whole.in_wedge == in_wedge and whole.in_region > in_region  # the kernel's rule: the site is in all its sectors


def test_sectors_without_a_place_at_a_centre(spark, tmp_path):
    rows = like_sql(spark, tmp_path, "unexplained_records", 201, AT_SITE)
    assert sum(reason == "the sector holds no hexagon of the lattice" for _, _, reason in rows) > 5


def test_places_on_the_edge_of_two_hexagons(spark, tmp_path):
    """Places due north of a site whose axis is an edge of the lattice, where the region's last hexagon is one of two."""
    rows = like_sql(spark, tmp_path, "places_in_regions", 1000, [(13 * k, 849 - 13 * k % 3) for k in range(456)])
    assert {m for _, m, *_ in rows} == {"B0", "B1", "M"}


def test_masses_apart_by_rounding_are_ties():
    """Two equal masses stay ties wherever a step of the fifteenth digit falls between them."""
    r, q = np.array([3, 2, 2, 1]), np.array([0, 5, 4, 9])
    for mass in np.random.default_rng(1).uniform(0.05, 0.06, 4000):
        for a, b in ((1, 1 + 6e-15), (1 + 6e-15, 1)):
            order, _ = CellKernel.ranked(SimpleNamespace(q=q, r=r), np.array([0.5, mass * a, mass * b, mass - 1e-12]))
            assert order.tolist() == [0, 2, 1, 3]


def test_no_shape_is_moved_for_places_in_regions(spark, tmp_path):
    """Rows of disks, sectors and hexagons would be several KB a record: the plan has no geometry."""
    rows = like_sql(spark, tmp_path, "places_in_regions", 201, AT_SITE)
    assert sum(n for *_, n, _ in rows) > 0
    plan = catalogue.QUERIES["places_in_regions"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "geometry" not in plan


def test_places_in_a_disk_or_sector_like_its_outline():
    rng = np.random.default_rng(5)
    for span, middle in ((65.0, 120.0), (65.0, -170.0), (200.0, 10.0), (0.7, 33.0), (360.0, 0.0)):
        angle, far = rng.uniform(0, 2 * np.pi, 4000), np.append(1000 * rng.uniform(1 - 1e-4, 1, 2000), rng.uniform(0, 1020, 2000))
        x, y = far * np.sin(angle), far * np.cos(angle)
        shape = geometry.disk(0, 0, 1000.0) if span == 360 else geometry.Sector(0, 0, middle, span, 1000.0).outline()
        assert (geometry.in_arc(x, y, 1000.0, span, middle) == geometry.contains(shape, x, y, boundary=True)).all()


def test_neighbours_among_many_cells_of_one_mast(spark):
    """Cells alike in all but their number have the first eight others of the strongest; no more than nine are looked at."""
    rows = [("A", k, 0.0 if k < 40 else 120.0, 65.0, 58.0, 25.0, 6.0, 1000.0, 1800, "UMa", 38.1, 39.1) for k in range(60)]
    cells = spark.createDataFrame(rows, "run_id string, cell_id long, azimuth double, beam_width double, eirp_dbm double, ant_height double, tilt_deg double, r_max_m double, freq_mhz int, model_type string, lat double, lon double")
    near = estimation.with_neighbours(cells, queries.SETTINGS)
    got = {r.cell_id: [(n.rank, n.cell_id) for n in r.neighbours] for r in near.collect()}
    for k in range(60):
        same = [j for j in (range(40) if k < 40 else range(40, 60)) if j != k]
        assert got[k] == [(i + 1, j) for i, j in enumerate(same[:8])]
    assert "explode(n_ids" in near._jdf.queryExecution().optimizedPlan().toString()


def test_mirrored_hexagons_at_a_regions_end(spark, tmp_path):
    """Cell 4001 with a timing advance of 3: its 95 % region ends between two mirrored hexagons, which the SQL's masses
    to fifteen digits tell apart."""
    rows = like_sql(spark, tmp_path, "density_contours", 1000, [(19, 398), (31, 398)])
    assert {r[1:3] for r in rows} == {(4001, 3)} and len(rows) == 3
