"""Integrity rules over call records, and the resolution of their hits to one claim an event.

Records: run_id, event_id, time_us (event time in microseconds), seq (arrival order), subscriber, device,
cell_id, scenario. Rules 1 and 3 look at records in arrival order (the stream phase), rules 5 and 2 at a
subscriber's stored records in event order (the batch phase); rule 4 makes no findings of single events.
Hits: run_id, event_id, time_us, scenario, rule_id, margin, evidence (JSON), phase.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from .quantiles import quantiles

INVENTORY, VELOCITY, TIME_ORDER, TRAJECTORY, ACTIVITY = 1, 2, 3, 4, 5
#: Rule names, which rules are about single events, and their precedence.
NAMES = {1: "inventory", 2: "velocity", 3: "time_order", 4: "trajectory_gap", 5: "activity"}
EVENT_ANCHORED = (1, 2, 3, 5)
PRECEDENCE = (1, 5, 3, 2, 4)
STREAM, BATCH = "stream", "batch"
PHASE = {1: STREAM, 3: STREAM, 5: BATCH, 2: BATCH}
MARGIN_CAP = 1e6
EVIDENCE_VERSION = 1
#: Parts of keys that evidence must not have, as they tell what only the ground truth knows, and keys
#: that every evidence has itself.
FORBIDDEN_KEYS = ("lat", "lon", "true_location", "location", "agent_id", "agent", "injected", "partition_key", "covered")
RESERVED_KEYS = ("v", "rule", "capped")
ZERO_DISTANCE_M = 1.0
#: Arrival numbers and microseconds of event time to a block: a subscriber's rows are worked on block by block, so that
#: one with a third of all records spreads over tasks.
ARRIVAL_BLOCK, TIME_BLOCK_US = 100_000, 86_400_000_000


@dataclass(frozen=True)
class Rules:
    """Detection parameters."""

    max_kmh: float = 300.0
    tick_s: float = 300.0
    tolerance_s: float = 0.0
    min_support: int = 2
    margin_cap: float = MARGIN_CAP

    def __post_init__(self):
        if not (self.max_kmh > 0 and self.tick_s > 0 and self.tolerance_s >= 0 and self.min_support >= 1 and self.margin_cap >= 1):
            raise ValueError("speed, tick and support must be positive, the tolerance not negative, the cap 1 or more")


def clamp(value: Column, cap: float = MARGIN_CAP) -> tuple[Column, Column]:
    """A finite value within [-cap, cap] (NaN counts as cap), and whether it was changed."""
    out = F.when(F.isnan(value) | (value > cap), F.lit(float(cap))).when(value < -cap, F.lit(-float(cap))).otherwise(value)
    return out, F.isnan(value) | (F.abs(value) > cap)


def clamp_margin(value: Column, cap: float = MARGIN_CAP) -> Column:
    return F.greatest(F.lit(1.0), clamp(value, cap)[0])


def evidence(rule: int, fields: dict[str, Column], floats: dict[str, Column] | None = None, cap: float = MARGIN_CAP) -> Column:
    """Versioned JSON of a finding; numbers in ``floats`` are clamped, which ``capped`` then tells."""
    for key in (*fields, *(floats or ())):
        low = key.lower()
        if not low or low in RESERVED_KEYS or any(f in low for f in FORBIDDEN_KEYS):
            raise ValueError(f"evidence can't have the key {key!r}")
    parts = [F.lit(EVIDENCE_VERSION).alias("v"), F.lit(rule).alias("rule"), *[c.alias(k) for k, c in fields.items()]]
    capped = F.lit(False)
    for key, c in (floats or {}).items():
        value, changed = clamp(c.cast("double"), cap)
        parts.append(value.alias(key))
        capped = capped | changed
    return F.to_json(F.struct(*parts, F.when(capped, F.lit(True)).alias("capped")))


def _hits(df: DataFrame, rule: int, margin: Column, proof: Column, cap: float) -> DataFrame:
    return df.select("run_id", "event_id", "time_us", "scenario", F.lit(rule).alias("rule_id"), clamp_margin(margin, cap).alias("margin"), proof.alias("evidence"), F.lit(PHASE[rule]).alias("phase"))


def unknown_cells(records: DataFrame, cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rule 1: the record's cell isn't in the run's inventory. Runs without any cell give no hits here;
    :func:`require_inventory` rejects them beforehand."""
    known = cells.select("run_id", "cell_id").distinct()
    size = known.groupBy("run_id").agg(F.count("*").alias("inventory_size"))
    bad = records.join(known, ["run_id", "cell_id"], "left_anti").join(size, "run_id")
    proof = evidence(INVENTORY, {"cell_id": F.col("cell_id").cast("string"), "inventory_size": F.col("inventory_size")})
    return _hits(bad, INVENTORY, F.lit(1.0), proof, rules.margin_cap)


def require_inventory(cells: DataFrame, run_id: str) -> None:
    if cells.filter(F.col("run_id") == run_id).limit(1).count() == 0:
        raise ValueError(f"run {run_id} has an empty cell inventory")


def around(rows: DataFrame, key: list[str], order: list[str], columns: list[str], later: int = 0, block_us: int = TIME_BLOCK_US) -> DataFrame:
    """``rows`` with ``before_<c>`` of the row before in the order (time first) and ``after<k>_<c>`` of the first
    ``later`` rows after it, for each of ``columns``; null where there is none.

    Rows are cut into blocks of event time. Windows run within a block; what lies over its ends comes from the
    last and the first rows of the blocks beside it, a row a block.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order[0]) / block_us))
    own = F.struct(*order, *[c for c in columns if c not in order])
    inside = Window.partitionBy(*key, "_block").orderBy(*order)
    along = Window.partitionBy(*key).orderBy("_block")
    ranked = rows.select(*key, "_block", own.alias("_row"), F.row_number().over(inside).alias("_n"))
    ends = ranked.groupBy(*key, "_block").agg(F.max("_row").alias("_last"), F.array_sort(F.collect_list(F.when(F.col("_n") <= max(later, 1), F.col("_row")))).alias("_first"))
    # the blocks after may hold fewer rows than are wanted
    follow = F.array(*[F.coalesce(F.lead("_first", k).over(along), F.array().cast(ends.schema["_first"].dataType)) for k in range(1, later + 1)]) if later else None
    ends = ends.select(*key, "_block", F.lag("_last").over(along).alias("_prior"), *([F.flatten(follow).alias("_next")] if later else []))
    rows = rows.withColumn("_lag", F.lag(own).over(inside))
    for k in range(1, later + 1):
        rows = rows.withColumn(f"_lead{k}", F.lead(own, k).over(inside))
    rows = rows.withColumn("_left", F.count("*").over(Window.partitionBy(*key, "_block")) - F.row_number().over(inside)) if later else rows
    out = rows.join(ends, [*key, "_block"])
    made = out.withColumn("_b", F.coalesce("_lag", "_prior"))
    for k in range(1, later + 1):
        made = made.withColumn(f"_a{k}", F.coalesce(f"_lead{k}", F.get("_next", (F.lit(k - 1) - F.col("_left")).cast("int"))))
    kept = [c for c in rows.columns if not c.startswith("_")]
    return made.select(*kept, *[F.col(f"_b.{c}").alias(f"before_{c}") for c in columns], *[F.col(f"_a{k}.{c}").alias(f"after{k}_{c}") for k in range(1, later + 1) for c in columns])


def before(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    return around(rows, key, order, columns)


def with_watermark_before(records: DataFrame, block: int | None = ARRIVAL_BLOCK) -> DataFrame:
    """``records`` with the largest earlier time of the same subscriber in arrival order, and its event.

    The frame ends one row before, so it is one pass over each subscriber's rows. Unless ``block`` is null, a
    subscriber's rows are cut into runs of that many arrival numbers: each run's maximum is found apart,
    maxima are carried over runs, and rows look only at their own run, so that a hot subscriber spreads.
    """
    mark = F.struct(F.col("time_us").alias("t"), (-F.col("seq")).alias("s"), F.col("event_id").alias("e"))
    key = ["run_id", "subscriber"]
    before = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    if not block:
        return records.withColumn("_w", F.max(mark).over(before.partitionBy(*key)))
    runs = records.withColumn("_b", F.floor(F.col("seq") / block))
    tops = runs.groupBy(*key, "_b").agg(F.max(mark).alias("_top"))
    order = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_carried", F.max("_top").over(order)).drop("_top")
    out = runs.withColumn("_w", F.max(mark).over(before.partitionBy(*key, "_b"))).join(tops, [*key, "_b"])
    return out.withColumn("_w", F.greatest("_w", "_carried")).drop("_b", "_carried")


def time_backsteps(records: DataFrame, rules: Rules = Rules(), block: int | None = ARRIVAL_BLOCK) -> DataFrame:
    """Rule 3: the record is earlier than one of its subscriber that arrived before it. Equal times are
    no violation, and a violating record doesn't lower the mark; records without subscriber are passed over."""
    marked = with_watermark_before(records.filter(F.length("subscriber") > 0), block)
    back = (F.col("_w.t") - F.col("time_us")) / F.lit(1e6)
    bad = marked.withColumn("_back", back).filter(F.col("_back") > rules.tolerance_s)
    proof = evidence(
        TIME_ORDER,
        {"record_time": clock.text("time_us"), "watermark": clock.text("_w.t"), "prev_event_id": F.col("_w.e").cast("string")},
        {"backstep_s": F.col("_back"), "tolerance_s": F.lit(rules.tolerance_s)},
        rules.margin_cap,
    )
    return _hits(bad, TIME_ORDER, F.col("_back") / rules.tick_s, proof, rules.margin_cap)


def device_changes(records: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rule 5: the record's device isn't the subscriber's most frequent one (of equals the smallest), if
    that has ``min_support`` records and there are two devices at least. Empty devices don't count."""
    used = records.filter(F.length("device") > 0)
    key = ["run_id", "subscriber"]
    counts = used.groupBy(*key, "device").agg(F.count("*").alias("n"))
    # the mode as the smallest of (-n, device): an aggregate that combines before the shuffle
    best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("device").alias("d"))).alias("mode"), F.count("*").alias("devices"))
    best = best.filter((F.col("devices") >= 2) & (-F.col("mode.m") >= rules.min_support))
    odd = counts.join(best, key).filter(F.col("device") != F.col("mode.d"))
    bad = used.join(odd, [*key, "device"])
    proof = evidence(ACTIVITY, {"imei": F.col("device"), "modal_imei": F.col("mode.d"), "imei_count": F.col("devices"), "support": -F.col("mode.m"), "deviating_records": F.col("n")})
    return _hits(bad, ACTIVITY, F.col("devices").cast("double"), proof, rules.margin_cap)


def implied_speeds(records: DataFrame, cells: DataFrame) -> DataFrame:
    """Each record of a known cell with its successor and the speed that the two imply.

    cells: run_id, cell_id, x, y. Columns of the pair: d (metres), dt (seconds), kmh (infinite as 1e308,
    0 for no move in no time) and who is to blame: the later record if the one before the pair says so,
    else the earlier one if the one after the pair says so, else nobody.
    """
    at = records.join(cells.select("run_id", "cell_id", "x", "y"), ["run_id", "cell_id"])
    own = ["run_id", "subscriber", "event_id", "time_us", "scenario", "cell_id", "x", "y"]
    rows = around(at.select(*own), ["run_id", "subscriber"], ["time_us", "event_id"], ["event_id", "time_us", "scenario", "cell_id", "x", "y"], later=2)
    after = [F.col(f"after1_{c}").alias(f"b_{n}") for c, n in (("event_id", "event"), ("time_us", "time_us"), ("scenario", "scenario"), ("cell_id", "cell"), ("x", "x"), ("y", "y"))]
    rows = rows.select(*own, *after, *[F.col(f"before_{c}").alias(f"prev_{c}") for c in ("x", "y")], *[F.col(f"after2_{c}").alias(f"next_{c}") for c in ("x", "y")]).filter("b_event is not null")

    def apart(u: str, v: str) -> Column:
        dx, dy = F.col(f"{u}x") - F.col(f"{v}x"), F.col(f"{u}y") - F.col(f"{v}y")
        return F.sqrt(dx * dx + dy * dy)

    rows = rows.withColumn("d", apart("", "b_")).withColumn("dt", (F.col("b_time_us") - F.col("time_us")) / F.lit(1e6))
    moved = F.when(F.col("d") > ZERO_DISTANCE_M, F.lit(1e308)).otherwise(F.lit(0.0))
    kmh = F.when(F.col("dt") <= 0, moved).otherwise((F.col("d") / 1000.0) / F.nullif(F.col("dt") / 3600.0, F.lit(0.0)))
    later = F.col("prev_x").isNotNull() & (apart("b_", "prev_") > apart("", "prev_"))
    earlier = F.col("next_x").isNotNull() & (apart("", "next_") > apart("b_", "next_"))
    return rows.withColumn("kmh", kmh).withColumn("blame", F.when(later, F.lit("b")).when(earlier, F.lit("a")))


def impossible_speeds(records: DataFrame, cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rule 2: two consecutive records of known cells imply a speed over ``max_kmh``, and the positions
    around them tell which is wrong. An event blamed twice keeps its highest speed, the first of equals."""
    over = implied_speeds(records, cells).filter((F.col("kmh") > rules.max_kmh) & F.col("blame").isNotNull())
    is_b = F.col("blame") == "b"

    def blamed(b: str, a: str) -> Column:
        return F.when(is_b, F.col(b)).otherwise(F.col(a))

    over = over.select(
        "run_id", blamed("b_event", "event_id").alias("event_id"), blamed("b_time_us", "time_us").alias("time_us"), blamed("b_scenario", "scenario").alias("scenario"),
        blamed("b_cell", "cell_id").alias("cell_id"), blamed("event_id", "b_event").alias("peer"), "kmh", "d", "dt", F.col("time_us").alias("pair_time"), F.col("event_id").alias("pair"),
    )
    best = Window.partitionBy("run_id", "event_id").orderBy(F.desc("kmh"), "pair_time", "pair")
    bad = over.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    proof = evidence(
        VELOCITY,
        {"record_cell": F.col("cell_id").cast("string"), "peer_event_id": F.col("peer").cast("string"), "attribution": F.lit("local_support"), "zero_interval": F.col("dt") <= 0},
        {"distance_m": F.col("d"), "delta_s": F.col("dt"), "velocity_kmh": F.col("kmh"), "threshold_kmh": F.lit(rules.max_kmh)},
        rules.margin_cap,
    )
    return _hits(bad, VELOCITY, F.col("kmh") / rules.max_kmh, proof, rules.margin_cap)


def valid_hits(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits fit to be stored, and those that aren't: unknown or aggregate-only rule, no event or time, a
    scenario that isn't one letter, evidence without version, a margin outside [1, cap]."""
    ok = (
        F.col("rule_id").isin(*EVENT_ANCHORED) & F.col("event_id").isNotNull() & (F.coalesce("time_us", F.lit(0)) > 0)
        & F.col("scenario").isin("A", "B", "C", "D") & F.get_json_object("evidence", "$.v").isNotNull()
        & (F.col("margin") >= 1) & (F.col("margin") <= MARGIN_CAP)
    )
    ok = F.coalesce(ok, F.lit(False))
    return hits.filter(ok), hits.filter(~ok)


def _rank(rule: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRECEDENCE)), rule)


def resolve(hits: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Findings: each event's first claim is canonical, the rest say who suppressed them.

    The first claim is that of the earlier phase, within a phase that of the stronger rule. Earlier
    canonical ``claims`` (run_id, event_id, rule_id) win over all hits; a hit that repeats its own claim
    is left out, and so is a second hit of one rule on one event, so that a rerun adds nothing.
    """
    one = Window.partitionBy("run_id", "event_id", "rule_id").orderBy("phase", F.desc("margin"))
    hits = hits.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    order = F.struct(F.when(F.col("phase") == STREAM, 1).otherwise(2).alias("p"), _rank(F.col("rule_id")).alias("r"), F.col("rule_id").alias("rule"))
    first = F.min(order).over(Window.partitionBy("run_id", "event_id"))["rule"]
    if claims is not None:
        earlier = claims.select("run_id", "event_id", F.col("rule_id").alias("_claim"))
        hits = hits.join(earlier, ["run_id", "event_id"], "left").filter(F.col("_claim").isNull() | (F.col("_claim") != F.col("rule_id")))
        first = F.coalesce(F.col("_claim"), first)
    out = hits.withColumn("_winner", first)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("rule_id"))
    by = F.when(F.col("_winner") != F.col("rule_id"), F.col("_winner"))
    return out.select("run_id", "event_id", "time_us", "rule_id", name.alias("rule_name"), "margin", "evidence", "scenario", F.col("phase").alias("detected_in"), by.cast("int").alias("suppressed_by"))


#: Rule functions by number, and the phase that each belongs to; add to both to plug in a rule.
RULE_FUNCTIONS = {
    INVENTORY: lambda records, cells, rules, block: unknown_cells(records, cells, rules),
    TIME_ORDER: lambda records, cells, rules, block: time_backsteps(records, rules, block),
    ACTIVITY: lambda records, cells, rules, block: device_changes(records, rules),
    VELOCITY: lambda records, cells, rules, block: impossible_speeds(records, cells, rules),
}


def phase_hits(phase: str, records: DataFrame, cells: DataFrame, rules: Rules = Rules(), which: tuple[int, ...] | None = None, block: int | None = ARRIVAL_BLOCK) -> DataFrame:
    """Hits of a phase's rules, or of those in ``which``; a rule of the other phase is an error."""
    own = [r for r in PRECEDENCE if PHASE.get(r) == phase]
    if not own:
        raise ValueError(f"phase must be {STREAM} or {BATCH}")
    if which is not None and (wrong := [r for r in which if r not in own]):
        raise ValueError(f"rules {wrong} don't belong to the {phase} phase")
    hits = None
    for r in own if which is None else which:
        found = RULE_FUNCTIONS[r](records, cells, rules, block)
        hits = found if hits is None else hits.unionByName(found)
    return hits


def detect(records: DataFrame, cells: DataFrame, rules: Rules = Rules(), block: int | None = ARRIVAL_BLOCK) -> DataFrame:
    """Findings of both phases over stored records. cells: run_id, cell_id, x, y."""
    return resolve(phase_hits(STREAM, records, cells, rules, block=block).unionByName(phase_hits(BATCH, records, cells, rules)))


def consecutive_gaps(records: DataFrame) -> DataFrame:
    """Per run: number, median and 95th percentile of the seconds between a subscriber's records (an
    aggregate view of missing records; it makes no findings)."""
    rows = before(records, ["run_id", "subscriber"], ["time_us", "event_id"], ["time_us"]).withColumn("gap", (F.col("time_us") - F.col("before_time_us")) / F.lit(1e6)).filter("gap is not null")
    return quantiles(rows, ["run_id"], {"median_gap_s": ("gap", 0.5), "p95_gap_s": ("gap", 0.95)}).join(rows.groupBy("run_id").agg(F.count("*").alias("gaps")), "run_id")
