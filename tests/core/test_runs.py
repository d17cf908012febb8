"""Generated runs through streaming, batch, analysis, calibration and validation."""

import dataclasses
import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from cdrlens import queries
from cdrlens.functions import geometry as g
from cdrlens.functions import timing
from cdrlens.functions.geo import HexLattice, Plane
from cdrlens.operators import calibration, estimation, generator, integrity, measurement, sampling
from cdrlens.operators.estimation import CellKernel, Settings
from cdrlens.plans import runs
from cdrlens.schemas import TABLES
from cdrlens.sources import wire
from cdrlens.sources.store import Store
from cdrlens.streaming import jobs

SETTINGS = Settings(38.6748, 39.2225, grid_m=150.0)
PLANE = Plane(38.6748, 39.2225)


@pytest.fixture(scope="module")
def made(spark):
    tables = generator.generate(spark, queries.demo_spec())
    return {k: v.persist() for k, v in tables.items()}


def test_generated_run(made):
    n, truths = made["records"].count(), made["truth"].count()
    dropped = made["truth"].filter("injected_rule = 4 or not covered").count()
    assert n > 500 and truths - n == dropped
    assert made["truth"].select("event_id").distinct().count() == truths
    share = made["events"].filter("fault is not null").count() / n
    assert 0.005 < share < 0.05
    assert made["records"].join(made["cells"], "cell_id", "left_anti").count() == made["truth"].filter("injected_rule = 1").count()
    true = made["records"].join(made["truth"].filter("injected_rule is null").select("event_id", "lat", "lon"), "event_id").join(made["cells"].select("cell_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")), "cell_id")
    for r in true.limit(200).collect():
        d = np.hypot(PLANE.x(r.lon) - PLANE.x(r.c_lon), PLANE.y(r.lat) - PLANE.y(r.c_lat))
        inner, outer = timing.ring(r.ta_value, "LTE")
        assert inner - 1e-3 <= d < outer + 1e-3
    assert generator.uncovered_share(made["events"]).first().warn in (True, False)


def test_partitioning_changes_nothing(spark, made):
    spec = queries.demo_spec()
    cells, agents = generator.make_cells(spec), generator.make_agents(spec)
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "7")
    try:
        again = generator.truth_of(generator.make_events(spark, spec, cells, agents), spec)
        assert again.exceptAll(made["truth"]).count() == 0 and made["truth"].exceptAll(again).count() == 0
    finally:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", before) if before else spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_event_rate_follows_the_day():
    spec = queries.demo_spec()
    agent, tick = np.meshgrid(np.arange(400), np.arange(288), indexing="ij")
    k = generator.event_counts(spec, agent.ravel(), tick.ravel()).reshape(400, 288)
    assert abs(k.sum() / 400 - sum(generator.DIURNAL)) < 0.6
    assert k[:, 36 * 0 : 48].mean() < k[:, 216:240].mean()


def test_golden_site():
    """One site on the beam's axis: masses sum to one, the true cell has mass, the ring holds the distance."""
    cell = {"x": 0.0, "y": 0.0, "azimuth": 0.0, "beam_width": 65.0, "eirp_dbm": 58.0, "ant_height": 25.0, "tilt_deg": 6.0, "freq_mhz": 2100, "model_type": "UMa", "r_max_m": 6500.0}
    lattice = HexLattice(100.0)
    others = [cell | {"azimuth": a} for a in (120.0, 240.0)]
    kernel = CellKernel(cell, others, Settings(38.6748, 39.2225), lattice)
    for d in (200, 500, 1000, 2000, 3000, 4000, 5000, 6000):
        ta = int(timing.from_distance(np.array([float(d)]), "LTE")[0])
        mass, used = kernel.mass(ta)
        q, r = (int(v) for v in lattice.at(0.0, float(d)))
        at = np.nonzero((kernel.q == q) & (kernel.r == r))[0]
        assert used and abs(mass.sum() - 1) < 1e-9 and mass[at[0]] > 0
        regions = [set(kernel.contour(mass, level).tolist()) for level in (0.5, 0.9, 0.95)]
        assert regions[0] <= regions[1] <= regions[2]
    mass, used = kernel.mass(10_000)  # a ring that the sector doesn't reach is ignored
    assert not used and np.allclose(mass, kernel.mass(None)[0])
    rows = estimation.shapes_of(kernel, None, PLANE)
    assert [(r[0], r[1]) for r in rows] == [("B0", -1.0), ("B1", -1.0), ("M", 0.5), ("M", 0.9), ("M", 0.95)]
    area = [r[5] for r in rows]
    assert area[1] <= area[0] and area[2] <= area[3] <= area[4] and all(g.is_valid(g.from_wkb(r[2])) for r in rows)
    assert abs(area[0] / (np.pi * 6.5**2) - 1) < 0.01


def test_neighbours_like_brute_force(spark, made):
    cells = estimation.on_plane(made["cells"], PLANE).toPandas()
    got = {r.cell_id: r.neighbours for r in estimation.with_neighbours(made["cells"], SETTINGS).collect()}
    for _, c in cells.sample(12, random_state=1).iterrows():
        cx, cy = g.Sector(c.x, c.y, c.azimuth, c.beam_width, c.r_max_m).centroid()
        near = [(-float(estimation._cell_power(o, cx, cy, 1.5)), o.cell_id, o.x) for _, o in cells.iterrows() if o.cell_id != c.cell_id and np.hypot(cx - o.x, cy - o.y) <= o.r_max_m]
        best = sorted(near)[:8]
        assert [round(n.power, 6) for n in got[c.cell_id]] == [round(-b[0], 6) for b in best]


def test_estimates(spark, made):
    records = made["records"].orderBy("event_id").limit(60)
    out = estimation.estimates(records, made["cells"], SETTINGS).persist()
    known = records.join(made["cells"].select("cell_id"), "cell_id", "left_semi").count()
    assert out.count() == 5 * known and known + estimation.rejected(records, made["cells"]).count() == 60
    stats = {r.method: r for r in estimation.geometry_stats(out).collect()}
    assert stats["B0"].avg_corners == 361 and stats["M"].repaired == 0
    check = estimation.area_check(out).first()
    assert check.max_difference < 1e-9
    some = estimation.shapes(records.withColumn("ta_value", F.lit(None).cast("int")), made["cells"], SETTINGS)
    assert some.filter("ta_used").count() == 0
    assert estimation.estimates(records.limit(0), made["cells"], SETTINGS).count() == 0


def test_covers_counts_the_boundary(spark):
    square = [[np.array([[0.0, 0], [1, 0], [1, 1], [0, 1], [0, 0]])]]
    rows = [(bytes(g.to_wkb(square)), y, x) for y, x in ((0.5, 0.5), (0.0, 0.5), (1.0, 1.0), (2.0, 0.5))] + [(None, 0.5, 0.5)]
    got = estimation.covers(spark.createDataFrame(rows, "geometry binary, lat double, lon double"), "lat", "lon")
    assert [r.inside for r in got.collect()] == [True, True, True, False, None]


def test_sampling(spark, made):
    total = made["records"].count()
    parts = {m: sampling.sampled(made["records"], m, 42, wanted=100, expected_total=total) for m in ("validation", "calibration")}
    for part in parts.values():
        assert 40 < part.count() < 200
    assert parts["validation"].join(parts["calibration"], "event_id").count() == 0
    one = sampling.exact_sample(made["records"], 50, 42)
    assert one.count() == 50
    assert {r.event_id for r in one.collect()} == {r.event_id for r in sampling.exact_sample(made["records"].repartition(7), 50, 42).collect()}
    for bad in (("some", 1, 1), ("calibration", 0, 10), ("validation", 5, 0)):
        with pytest.raises(ValueError):
            sampling.keep_ratio(bad[0], 0.8, bad[1], bad[2])


def test_bisection():
    found = calibration.bisect(lambda x: min(1.0, x / 2), 0.5, 3.0, 0.9)
    assert found.converged and abs(found.lambda_ - 1.8) < 0.05
    stuck = calibration.bisect(lambda x: 0.5, 0.5, 3.0, 0.9, steps=5)
    assert not stuck.converged and len(stuck.trace) == 5
    with pytest.raises(ValueError):
        calibration.bisect(lambda x: x, 3.0, 1.0)


def test_calibration_like_counting(spark, made):
    samples = calibration.calibration_set(made["records"], made["truth"], 40, 42).persist()
    s = dataclasses.replace(SETTINGS, grid_m=200.0)
    got = {r["lambda"]: r for r in calibration.coverage_at(samples, made["cells"], s, [0.7, 2.0]).collect()}
    lattice = HexLattice(200.0)
    cells = {r.cell_id: r for r in estimation.with_neighbours(made["cells"], s).collect()}
    for lam, row in got.items():
        hit = total = 0
        for r in samples.collect():
            if r.cell_id in cells:
                kernel = CellKernel(cells[r.cell_id], cells[r.cell_id].neighbours, dataclasses.replace(s, lambda_=lam), lattice)
                mass, _ = kernel.mass(r.ta_value)
                top = kernel.contour(mass, 0.9)
                q, x = (int(v) for v in lattice.at(PLANE.x(r.lon), PLANE.y(r.lat)))
                hit += (q, x) in set(zip(kernel.q[top].tolist(), kernel.r[top].tolist(), strict=True))
                total += 1
        assert (row.covered, row.evaluated) == (hit, total)
    d = calibration.diagnostics(samples, made["cells"], s).first()
    assert d.samples == total and 0 <= d.in_wedge <= d.samples and d.off_axis_median_deg >= 0


def test_whole_run(spark, made, tmp_path):
    spec = queries.demo_spec()
    store = Store(spark, str(tmp_path / "db"))
    run = spark.createDataFrame([(spec.run_id, "A", "urban", 42, 1.0, spec.start_us, None, "{}", None, None, None)], TABLES["runs"].schema)
    store.insert_run(run, made["cells"])
    messages = made["records"].select("*")
    jobs.write_messages(messages.join(wire.encode_records(messages).select(F.get_json_object("value", "$.event_id").alias("event_id"), "key", "value"), "event_id").select("key", "value", "seq"), str(tmp_path / "topic"))
    jobs.write_messages(spark.createDataFrame([("k", "not json", 10**12)], "key string, value string, seq long"), str(tmp_path / "topic"))
    query = jobs.persist(jobs.message_stream(spark, str(tmp_path / "topic")), jobs.stored_records, store, "records", str(tmp_path / "cp1"), spec.run_id)
    query.awaitTermination()
    assert jobs.Progress(query).rows() == made["records"].count() + 1
    store.append("truth", made["truth"])
    n = made["records"].count()
    assert store.count("records", spec.run_id) == n
    with pytest.raises(runs.NotReady):
        runs.require_ready(store, spec.run_id)
    with pytest.raises(runs.NotReady):
        runs.batch_phase(store, spec.run_id, PLANE)

    cells = made["cells"].select("run_id", "cell_id")
    jobs.detect_stream(jobs.message_stream(spark, str(tmp_path / "topic"), files=2), store, cells, spec.run_id, str(tmp_path / "cp2")).awaitTermination()
    batch = integrity.resolve(integrity.unknown_cells(made["records"], made["cells"]).unionByName(integrity.time_backsteps(made["records"])))
    columns = ["event_id", "rule_id", "margin", "evidence", "suppressed_by"]
    streamed = store.read("findings").select(columns)
    assert streamed.count() > 0 and streamed.exceptAll(batch.select(columns)).count() == 0 and batch.select(columns).exceptAll(streamed).count() == 0
    injected = {r.event_id for r in made["truth"].filter("injected_rule = 3").collect()}
    assert {r.event_id for r in streamed.filter("rule_id = 3").collect()} <= injected

    store.update_run(spec.run_id, inspected_records=n, published_events=n, finished_us=spec.start_us + 1)
    runs.batch_phase(store, spec.run_id, PLANE)
    first = store.read("findings").count()
    runs.batch_phase(store, spec.run_id, PLANE)
    runs.stream_phase(store, spec.run_id, PLANE)
    assert store.read("findings").count() == first
    assert store.read("findings").filter("suppressed_by is null").groupBy("event_id").count().filter("count > 1").count() == 0

    part = sampling.sampled(store.read("records"), "validation", 42).limit(40)
    runs.analysis(store, spec.run_id, SETTINGS, part)
    report = runs.validation(store, spec.run_id, with_calibration_part=False)
    assert report.equal_sets and report.reductions["reduction_vs_b0"] > 0.75
    rows = store.read("metrics").collect()
    assert len(rows) == 5 and all(r.p95_part_count >= 1 and 0 <= r.coverage_rate <= 1 for r in rows)
    runs.validation(store, spec.run_id)
    assert store.read("metrics").count() == 5 and store.read("integrity_metrics").count() == 5
    status = {r.check_name: r.status for r in measurement.verify_integrity(*(store.read(t) for t in ("runs", "records", "truth", "estimates")), exempt_uncovered=True).collect()}
    assert set(status.values()) == {"OK"}
    assert runs.compare_runs(store).count() == 5


def test_stages_see_no_truth():
    """Detection and estimation take no ground truth."""
    for module in (integrity, estimation):
        for _, f in inspect.getmembers(module, inspect.isfunction):
            assert "truth" not in inspect.signature(f).parameters
        assert "operators.measurement" not in inspect.getsource(module) and "from .generator" not in inspect.getsource(module)
