"""Whole runs: integrity phases, analysis, validation, with the conditions between them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Plane
from ..operators import estimation, integrity, measurement
from ..operators.estimation import Settings
from ..operators.integrity import Rules
from ..sources.store import Store


class NotReady(RuntimeError):
    """A run isn't far enough for a step."""


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    detail: str


def preconditions(store: Store, run_id: str) -> list[Check]:
    """What validation needs: a finished run, all records, truth for them, and five rows an analysed event."""
    run = store.status(run_id)
    records, truths, made = (store.count(t, run_id) for t in ("records", "truth", "estimates"))
    published, analyzed = run["published_events"], run["analyzed_events"]
    return [
        Check("finished", run["finished_us"] is not None, f"finished_us {run['finished_us']}"),
        Check("records_stored", published is not None and records == published, f"published {published}, stored {records}"),
        Check("truth_stored", truths >= records, f"{truths} truths, {records} records"),
        Check("analysed", analyzed is not None and made == 5 * analyzed, f"{made} estimates of {analyzed} events"),
    ]


def require_ready(store: Store, run_id: str) -> list[Check]:
    checks = preconditions(store, run_id)
    if failed := [c for c in checks if not c.passed]:
        raise NotReady(f"run {run_id}: " + "; ".join(f"{c.name} ({c.detail})" for c in failed))
    return checks


def _placed(store: Store, run_id: str, plane: Plane) -> DataFrame:
    return estimation.on_plane(store.inventory(run_id), plane)


def stream_phase(store: Store, run_id: str, plane: Plane, rules: Rules = Rules()) -> None:
    """Rules 1 and 3 over the stored records in arrival order (the streaming job gives the same rows)."""
    cells = _placed(store, run_id, plane)
    integrity.require_inventory(cells, run_id)
    records = store.read("records").filter(F.col("run_id") == run_id)
    store.append("findings", integrity.resolve(integrity.phase_hits(integrity.STREAM, records, cells, rules)))
    store.update_run(run_id, inspected_records=records.count())


def batch_phase(store: Store, run_id: str, plane: Plane, rules: Rules = Rules()) -> None:
    """Rules 5 and 2, after the stream phase saw all published records; repeating it adds nothing."""
    run = store.status(run_id)
    if run["inspected_records"] is None or run["inspected_records"] != run["published_events"]:
        raise NotReady(f"run {run_id}: the stream phase saw {run['inspected_records']} of {run['published_events']} records")
    if store.count("records", run_id) != run["published_events"]:
        raise NotReady(f"run {run_id}: records are missing")
    records = store.read("records").filter(F.col("run_id") == run_id)
    hits = integrity.phase_hits(integrity.BATCH, records, _placed(store, run_id, plane), rules)
    store.append("findings", integrity.resolve(hits, store.canonical_claims(run_id)))


def analysis(store: Store, run_id: str, settings: Settings, records: DataFrame | None = None) -> None:
    """Estimate the (sampled) records of a run and note how many events were analysed."""
    chosen = store.read("records").filter(F.col("run_id") == run_id) if records is None else records
    inventory = store.inventory(run_id)
    store.append("estimates", estimation.with_valid_geometry(estimation.estimates(chosen, inventory, settings)))
    # from the records, so that the check of five estimates an event can fail
    store.update_run(run_id, analyzed_events=chosen.count() - estimation.unexplained(chosen, inventory, settings).count())


def replay(store: Store, run_id: str, settings: Settings, lambda_: float | None = None, records: DataFrame | None = None) -> DataFrame:
    """A run's estimates made again from its stored records, with another spread factor if given: the factor stored
    with the run counts if none is. Nothing is written."""
    stored = store.status(run_id)["lambda"]
    factor = lambda_ if lambda_ is not None else stored if stored is not None else settings.lambda_
    chosen = store.read("records").filter(F.col("run_id") == run_id) if records is None else records
    return estimation.estimates(chosen, store.inventory(run_id), replace(settings, lambda_=factor))


@dataclass(frozen=True)
class Report:
    checks: list
    equal_sets: bool
    reductions: dict


def validation(store: Store, run_id: str, with_calibration_part: bool = False, with_integrity: bool = True) -> Report:
    """Measure a run and store the rows: they replace the run's old ones."""
    checks = require_ready(store, run_id)
    made = store.read("estimates").filter(F.col("run_id") == run_id)
    truth = store.read("truth").filter(F.col("run_id") == run_id)
    run = store.status(run_id)
    equal = measurement.equal_event_sets(made).first()
    less = measurement.reductions(made, truth).first()
    if less is None or not (less["b0_area_km2"] and less["b1_area_km2"]) or less["m_area_km2"] is None:
        raise NotReady(f"run {run_id}: the validation part lacks a method")
    rows = None
    for key in ("V", "C") if with_calibration_part else ("V",):
        covered = estimation.covers(made.join(truth.select("run_id", "event_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), ["run_id", "event_id"]), "t_lat", "t_lon").drop("t_lat", "t_lon")
        part = measurement.metric_rows(covered, truth, F.col("inside"), key)
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("scenario", F.lit(run["scenario"])).withColumn("reduction_vs_b0", F.lit(less["reduction_vs_b0"])).withColumn("reduction_vs_b1", F.lit(less["reduction_vs_b1"]))
    store.overwrite_run("metrics", rows)
    if with_integrity:
        findings = store.read("findings").filter(F.col("run_id") == run_id)
        runs = store.read("runs").filter(F.col("run_id") == run_id)
        store.overwrite_run("integrity_metrics", measurement.precision_recall(findings, truth, runs))
    return Report(checks, bool(equal and equal["equal"]), less.asDict())


def compare_runs(store: Store) -> DataFrame:
    """Each run's metrics beside its scenario, and how many rows its tables hold."""
    counts = None
    for name in ("records", "truth", "estimates", "findings"):
        n = store.read(name).groupBy("run_id").agg(F.count("*").alias(f"n_{name}"))
        counts = n if counts is None else counts.join(n, "run_id", "full")
    runs = store.read("runs").select("run_id", "morphology", "seed", "lambda")
    return store.read("metrics").join(runs, "run_id").join(counts, "run_id", "left")
