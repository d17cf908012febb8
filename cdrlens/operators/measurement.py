"""How good estimates and findings are, against ground truth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.mathops import COL
from .integrity import EVENT_ANCHORED, NAMES
from .quantiles import quantiles

CALIBRATION, VALIDATION = "C", "V"
#: The 97.5 % point of the normal distribution, and what a verdict needs.
Z95 = 1.959963984540054
PRECISION_THRESHOLD, MIN_FINDINGS = 0.90, 30
MODEL_CONFIDENCE = 0.90
KEY = ["run_id", "event_id"]


def partition(key: str) -> str:
    """A partition key, checked: only C and V are ones."""
    if key not in (CALIBRATION, VALIDATION):
        raise ValueError(f"partition must be C or V, not {key!r}")
    return key


def _measured(estimates: DataFrame, truth: DataFrame, key: str, covered: bool) -> DataFrame:
    """Estimates joined with truth by run and event; never by time, which an injection may shift."""
    t = truth.filter(F.col("partition_key") == partition(key))
    t = t.filter("covered") if covered else t
    return estimates.withColumn("method", F.rtrim("method")).join(t.select(*KEY, "lat", "lon"), KEY)


def coverage(estimates: DataFrame, truth: DataFrame, inside: Column, key: str = VALIDATION) -> DataFrame:
    """Per method and confidence: events, and the share whose true place is in the region (a place on the
    boundary is). ``inside`` is that predicate over the joined columns. Only covered events count."""
    rows = _measured(estimates, truth, key, True)
    return rows.groupBy("run_id", "method", "confidence").agg(F.count("*").alias("n_events"), F.avg(inside.cast("int")).alias("coverage_rate"))


def areas(estimates: DataFrame, truth: DataFrame, key: str = VALIDATION) -> DataFrame:
    """Median and 90th percentile of area, median and 95th of parts, share repaired; all events count."""
    rows = _measured(estimates, truth, key, False)
    by = ["run_id", "method", "confidence"]
    wanted = {"median_area_km2": ("area_km2", 0.5), "p90_area_km2": ("area_km2", 0.9), "median_part_count": ("part_count", 0.5), "p95_part_count": ("part_count", 0.95)}
    return quantiles(rows, by, wanted).join(rows.groupBy(*by).agg(F.avg(F.col("repaired").cast("int")).alias("repaired_ratio")), by)


def errors(estimates: DataFrame, truth: DataFrame, key: str = VALIDATION) -> DataFrame:
    """Percentiles of the distance between centroid and true place; the median goes by two names."""
    rows = _measured(estimates, truth, key, True)
    d = haversine_m(F.col("centroid_lat"), F.col("centroid_lon"), F.col("lat"), F.col("lon"), COL)
    out = quantiles(rows.withColumn("d", d), ["run_id", "method", "confidence"], {"r50_m": ("d", 0.5), "r95_m": ("d", 0.95)})
    return out.withColumn("median_haversine_m", F.col("r50_m"))


def reductions(estimates: DataFrame, truth: DataFrame, confidence: float = MODEL_CONFIDENCE) -> DataFrame:
    """Per run: median areas of both baselines and of the model, and by how much the model's is smaller;
    always over the validation part."""
    rows = _measured(estimates, truth, VALIDATION, False)
    model = (F.col("method") == "M") & (F.col("confidence") == confidence)
    for name, which in (("b0", F.col("method") == "B0"), ("b1", F.col("method") == "B1"), ("m", model)):
        rows = rows.withColumn(name, F.when(which, F.col("area_km2")))
    out = quantiles(rows, ["run_id"], {f"{n}_area_km2": (n, 0.5) for n in ("b0", "b1", "m")}).join(rows.groupBy("run_id").agg(F.count_if(model).alias("n_events")), "run_id")

    def less(base: str) -> Column:
        return 1 - F.try_divide("m_area_km2", base)

    return out.withColumn("reduction_vs_b0", less("b0_area_km2")).withColumn("reduction_vs_b1", less("b1_area_km2"))


def equal_event_sets(estimates: DataFrame) -> DataFrame:
    """Per run: distinct events of each method, and whether the three numbers agree."""

    def events(method: str) -> Column:
        return F.count_distinct(F.when(F.rtrim("method") == method, F.col("event_id")))

    out = estimates.groupBy("run_id").agg(events("B0").alias("b0"), events("B1").alias("b1"), events("M").alias("m"))
    return out.withColumn("equal", (F.col("b0") == F.col("b1")) & (F.col("b1") == F.col("m")))


def metric_rows(estimates: DataFrame, truth: DataFrame, inside: Column, key: str = VALIDATION) -> DataFrame:
    """The three measurements of each run, method and confidence in one row; a part without counterpart
    drops out, which :func:`incomplete_metrics` finds."""
    by = ["run_id", "method", "confidence"]
    out = coverage(estimates, truth, inside, key).join(areas(estimates, truth, key), by).join(errors(estimates, truth, key), by)
    parts = F.greatest(F.lit(1), F.round("p95_part_count").cast("int"))
    return out.withColumn("partition_key", F.lit(key)).withColumn("p95_part_count", parts).withColumn("median_part_count", F.greatest(F.lit(1), F.round("median_part_count").cast("int")))


def incomplete_metrics(estimates: DataFrame, truth: DataFrame, inside: Column, key: str = VALIDATION) -> DataFrame:
    """Method and confidence pairs that one of the measurements lacks."""
    by = ["run_id", "method", "confidence"]
    a, b = areas(estimates, truth, key).select(by), coverage(estimates, truth, inside, key).select(by)
    return a.join(b, by, "left_anti").unionByName(b.join(a, by, "left_anti"))


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """95 % interval of a share, within [0, 1]; (0, 0) without trials."""
    n, z2 = trials.cast("double"), Z95 * Z95
    p = F.try_divide(successes.cast("double"), n)
    middle = (p + F.try_divide(F.lit(z2), 2 * n)) / (1 + F.try_divide(F.lit(z2), n))
    half = Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)) / (1 + F.try_divide(F.lit(z2), n))
    none = trials == 0
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.when(none, 0.0).otherwise(low), F.when(none, 0.0).otherwise(high)


def wilson_value(successes: int, trials: int) -> tuple[float, float]:
    if trials == 0:
        return 0.0, 0.0
    p, z2 = successes / trials, Z95 * Z95
    middle, half = p + z2 / (2 * trials), Z95 * math.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials))
    return max(0.0, (middle - half) / (1 + z2 / trials)), min(1.0, (middle + half) / (1 + z2 / trials))


def precision_counts(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Per run and rule: canonical findings, and those that the truth confirms; a finding without truth is
    a false positive."""
    t = truth.select(*KEY, "injected_rule")
    rows = findings.filter("suppressed_by is null").join(t, KEY, "left")
    return rows.groupBy("run_id", "rule_id").agg(F.count("*").alias("findings"), F.count_if(F.col("injected_rule") == F.col("rule_id")).alias("true_positives"))


def recall_counts(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Per run and injected rule: injected events, and those that a canonical finding of the rule caught."""
    f = findings.filter("suppressed_by is null").select(*KEY, F.col("rule_id").alias("injected_rule"), F.lit(True).alias("hit"))
    rows = truth.filter("injected_rule is not null").select(*KEY, "injected_rule").join(f, [*KEY, "injected_rule"], "left")
    return rows.groupBy("run_id", F.col("injected_rule").alias("rule_id")).agg(F.count("*").alias("injected"), F.count_if("hit").alias("caught"))


def finding_counts(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """:func:`precision_counts` and :func:`recall_counts` in one row a run and rule, from one pass over the
    findings: an event's canonical rules meet its injected rule, and both sides count towards their rule."""
    own = findings.filter("suppressed_by is null").groupBy(*KEY).agg(F.collect_list("rule_id").alias("rules"))  # one a rule
    both = own.join(truth.filter("injected_rule is not null").select(*KEY, "injected_rule"), KEY, "full")
    none, one, rule = F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("injected_rule")

    def row(of: Column, found: Column, right: Column, injected: Column, caught: Column) -> Column:
        return F.struct(of.alias("rule_id"), found.alias("findings"), right.alias("true_positives"), injected.alias("injected"), caught.alias("caught"))

    rules = F.coalesce("rules", F.array().cast("array<int>"))
    found = F.transform(rules, lambda r: row(r, one, F.coalesce((r == rule).cast("long"), none), none, none))
    injected = F.array(row(rule, none, none, one, F.array_contains(rules, rule).cast("long")))
    each = both.select("run_id", F.explode(F.concat(found, F.when(rule.isNotNull(), injected).otherwise(F.filter(injected, lambda x: F.lit(False))))).alias("c"))
    return each.groupBy("run_id", F.col("c.rule_id").alias("rule_id")).agg(*[F.sum(f"c.{n}").alias(n) for n in ("findings", "true_positives", "injected", "caught")])


def confusion(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Per run, rule and injected rule: canonical and suppressed findings; a null injected rule first."""
    rows = findings.join(truth.select(*KEY, "injected_rule"), KEY, "left")
    out = rows.groupBy("run_id", "rule_id", "injected_rule").agg(F.count_if(F.col("suppressed_by").isNull()).alias("canonical"), F.count_if(F.col("suppressed_by").isNotNull()).alias("suppressed"))
    return out.orderBy("run_id", "rule_id", F.col("injected_rule").asc_nulls_first())


def precision_recall(findings: DataFrame, truth: DataFrame, runs: DataFrame, min_findings: int = MIN_FINDINGS) -> DataFrame:
    """Five rows a run: precision (null without findings, or for the rule that makes none) with its
    interval, recall, and whether there are enough findings to judge."""
    spark = findings.sparkSession
    rules = spark.createDataFrame([(r, n, r in EVENT_ANCHORED) for r, n in NAMES.items()], "rule_id int, rule_name string, anchored boolean")
    rows = runs.select("run_id", "scenario").crossJoin(F.broadcast(rules))
    rows = rows.join(finding_counts(findings, truth), ["run_id", "rule_id"], "left")
    rows = rows.fillna(0, ["findings", "true_positives", "injected", "caught"])
    judged = F.col("anchored") & (F.col("findings") > 0)
    low, high = wilson(F.col("true_positives"), F.col("findings"))
    return rows.select(
        "run_id", "scenario", "rule_id", "rule_name", "findings", "true_positives", "injected",
        F.when(judged, F.col("true_positives") / F.col("findings")).alias("precision"),
        F.when(F.col("injected") > 0, F.try_divide("caught", "injected")).otherwise(F.lit(0.0)).alias("recall"),
        F.when(judged, low).alias("precision_lo"), F.when(judged, high).alias("precision_hi"),
        (judged & (F.col("findings") >= min_findings)).alias("sufficient"),
    )


def verdict(threshold: float = PRECISION_THRESHOLD) -> Column:
    """Label of a precision row."""
    return (
        F.when(~F.col("rule_id").isin(*EVENT_ANCHORED), "out of scope")
        .when(F.col("precision").isNull(), "not measurable")
        .when(~F.col("sufficient"), F.concat(F.lit("insufficient ("), F.col("findings").cast("string"), F.lit(" findings)")))
        .when(F.col("precision") >= threshold, "passed")
        .otherwise("failed")
    )


def verify_integrity(runs: DataFrame, records: DataFrame, truth: DataFrame, estimates: DataFrame, exempt_uncovered: bool = False) -> DataFrame:
    """Five checks of each run's tables: run_id, check_name, status (OK, FAIL or SKIP) and count.

    With ``exempt_uncovered``, truth of uncovered events, which never have a record, is no fault.
    """
    ids = runs.select("run_id")
    orphans = records.join(truth.select(*KEY), KEY, "left_anti").groupBy("run_id").agg(F.count("*").alias("n"))
    expected = truth.filter(~F.col("injected_rule").eqNullSafe(F.lit(4)))
    if exempt_uncovered:
        expected = expected.filter("covered")
    missing = expected.join(records.select(*KEY), KEY, "left_anti").groupBy("run_id").agg(F.count("*").alias("n"))
    stored = records.groupBy("run_id").agg(F.count("*").alias("n"))
    made = estimates.groupBy("run_id").agg(F.count("*").alias("n"))

    def row(df: DataFrame, name: str, status: Column, n: Column) -> DataFrame:
        return df.select("run_id", F.lit(name).alias("check_name"), status.alias("status"), n.cast("long").alias("count"))

    def counted(of: DataFrame) -> DataFrame:
        return runs.join(of, "run_id", "left").fillna(0, ["n"])

    n = F.col("n")
    zero = F.when(n == 0, "OK").otherwise("FAIL")
    published, analyzed, inspected = F.col("published_events"), F.col("analyzed_events"), F.col("inspected_records")
    parts = [
        row(ids.join(orphans, "run_id", "left").fillna(0), "records_without_truth", zero, n),
        row(ids.join(missing, "run_id", "left").fillna(0), "truth_without_records", zero, n),
        row(counted(stored), "published_vs_stored_records", F.when(published.isNull(), "SKIP").when(published == n, "OK").otherwise("FAIL"), n),
        row(counted(made), "estimates_per_analyzed_event", F.when(analyzed.isNull() | (analyzed == 0), "SKIP").when(n == 5 * analyzed, "OK").otherwise("FAIL"), n),
        row(runs, "inspected_vs_published_records", F.when(inspected.isNull() | published.isNull(), "SKIP").when(inspected == published, "OK").otherwise("FAIL"), F.coalesce(inspected, F.lit(0))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_difference(table: DataFrame, left: str, right: str, without: tuple = ("run_id", "event_id")) -> DataFrame:
    """Rows that one run has and the other hasn't (with multiplicity), apart from identifying columns."""
    kept = [c for c in table.columns if c not in without]
    a, b = (table.filter(F.col("run_id") == r).select(kept) for r in (left, right))
    return a.exceptAll(b).withColumn("only_in", F.lit(left)).unionByName(b.exceptAll(a).withColumn("only_in", F.lit(right)))


def modal_devices(records: DataFrame, rank: int = 1) -> DataFrame:
    """The shadow computation of the most frequent device: row_number over (count descending, device)."""
    n = records.filter(F.length("device") > 0).groupBy("run_id", "subscriber", "device").agg(F.count("*").alias("n"))
    order = Window.partitionBy("run_id", "subscriber").orderBy(F.desc("n"), "device")
    return n.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= rank)
