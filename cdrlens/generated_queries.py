"""Registered queries of hashes, samples and the generator, each with the same arithmetic in SQL.

64-bit products are taken in 128 bits there and cut down; a value that a formula needs twice is bound by a
list of one element.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import identity, radio
from .functions.geo import Plane
from .operators import generator, sampling
from .queries import _EVENT_ID, _RUN_UUID, DEMO, _ids, demo_spec, query
from .runtime import ship

SEED = 42
_M = "18446744073709551615::UHUGEINT"


def _times(a: str, b: int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * {b}::UHUGEINT) & {_M} AS UBIGINT)"


def _mix(x: str) -> str:
    first = f"list_transform([{x}], lambda a: {_times('xor(a, a >> 30)', 0xBF58476D1CE4E5B9)})[1]"
    second = f"list_transform([{first}], lambda b: {_times('xor(b, b >> 27)', 0x94D049BB133111EB)})[1]"
    return f"list_transform([{second}], lambda c: xor(c, c >> 31))[1]"


def _splitmix(x: str) -> str:
    return _mix(f"CAST((CAST({x} AS UHUGEINT) + {0x9E3779B97F4A7C15}::UHUGEINT) & {_M} AS UBIGINT)")


def _unsigned(x: str) -> str:
    """A whole number, negative ones as two's complement."""
    return f"CAST(CASE WHEN {x} < 0 THEN CAST({x} AS HUGEINT) + 18446744073709551616::HUGEINT ELSE CAST({x} AS HUGEINT) END AS UBIGINT)"


def _chain(start: str, *parts: str) -> str:
    for p in parts:
        start = _splitmix(f"xor({start}, {_splitmix(p)})")
    return start


def _unit(h: str) -> str:
    return f"((({h}) >> 12)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"


def _constant(*parts: int) -> str:
    return f"{int(identity.chain(*[np.uint64(p) for p in parts]))}::UBIGINT"


def _u(stream: str, purpose: int, a: str, b: str) -> str:
    return _unit(_chain(_constant(SEED, generator._STREAM[stream], purpose), _unsigned(a), _unsigned(b)))


def _normal(h: str) -> str:
    return f"list_transform([{h}], lambda h: sqrt(-2 * ln({_unit('h')})) * cos(2 * pi() * {_unit(_splitmix('h'))}))[1]"


@query("hash_uniforms", f"SELECT event_id, round({_u('place', 2, 'user_id', 'event_id')}, 12) AS u FROM events")
def _(a):
    ship(a.spark)
    return a.events.select("event_id", F.round(identity.uniform_column(SEED, generator._STREAM["place"], 2, F.col("user_id"), F.col("event_id")), 12).alias("u"))


@query("hash_normals", f"SELECT event_id, round({_normal(_chain('42::UBIGINT', _unsigned('user_id'), _unsigned('event_id')))}, 9) AS z FROM events")
def _(a):
    ship(a.spark)
    return a.events.select("event_id", F.round(identity.normal_column(SEED, F.col("user_id"), F.col("event_id")), 9).alias("z"))


_SEED_BYTES = ", ".join(f"{b}::UBIGINT" for b in SEED.to_bytes(8, "big"))
_FNV = f"list_reduce(list_concat([{_SEED_BYTES}], list_transform(generate_series(0, 15), lambda i: CAST(concat('0x', substr(replace(uid, '-', ''), 2 * i + 1, 2)) AS UBIGINT))), lambda h, b: {_times('xor(h, b)', 1099511628211)}, 14695981039346656037::UBIGINT)"
_THIN = f"(({_mix(_FNV)}) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE"


@query("thinning", f"{_EVENT_ID} SELECT event_id, round({_THIN}, 12) AS u FROM u")
def _(a):
    ship(a.spark)
    return _ids(a).select("event_id", F.round(identity.thinning(F.col("uid"), SEED), 12).alias("u"))


@query("exact_sample", f"{_EVENT_ID}, t AS (SELECT uid, {_THIN} AS k FROM u) SELECT uid AS event_id FROM t ORDER BY k, uid LIMIT 100")
def _(a):
    return sampling.exact_sample(_ids(a).select(F.col("uid").alias("event_id")), 100, SEED)


_SPLIT = "CAST(concat('0x', substr(sha256(unhex(concat(replace(uid, '-', ''), '000000000000002a'))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"


@query("sampled_records", f"{_EVENT_ID}, t AS (SELECT uid, {_SPLIT} AS part, {_THIN} AS k FROM u) SELECT uid AS event_id, 'validation' AS mode FROM t WHERE part >= 0.8 AND k < 0.5 UNION ALL SELECT uid, 'calibration' FROM t WHERE part < 0.8 AND k < 0.25 UNION ALL SELECT uid, 'full' FROM t")
def _(a):
    """What each mode analyses when 100 events of a half of the validation part, or 200 of a quarter of the other, are wanted."""
    ids = _ids(a).select(F.col("uid").alias("event_id"))
    out = sampling.sampled(ids, "validation", SEED, 0.8, 100, 1000).withColumn("mode", F.lit("validation"))
    out = out.unionByName(sampling.sampled(ids, "calibration", SEED, 0.8, 200, 1000).withColumn("mode", F.lit("calibration")))
    return out.unionByName(sampling.sampled(ids, "full", SEED).withColumn("mode", F.lit("full")))


_SALT = demo_spec().salt.ljust(64, b"\0")
_INNER, _OUTER = bytes(x ^ 0x36 for x in _SALT).hex(), bytes(x ^ 0x5C for x in _SALT).hex()


def _hmac(text: str) -> str:
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({text}))))"


def _uuid5(space: str, name: str) -> str:
    """Version 5 UUID of a blob ``name`` in the name space ``space``, 32 hexadecimal digits."""
    made = f"sha1(unhex({space}) || {name})"
    return f"list_transform([{made}], lambda s: concat(substr(s, 1, 8), '-', substr(s, 9, 4), '-5', substr(s, 14, 3), '-', substr('89ab', (strpos('0123456789abcdef', substr(s, 17, 1)) - 1) % 4 + 1, 1), substr(s, 18, 3), '-', substr(s, 21, 12)))[1]"


@query("pseudonyms", f"SELECT DISTINCT user_id, {_hmac('concat(9050, lpad(CAST(user_id AS VARCHAR), 8, 0::VARCHAR))')} AS pseudonym FROM events")
def _(a):
    return a.events.select("user_id", identity.pseudonym(identity.subscriber_number(F.col("user_id")), demo_spec().salt).alias("pseudonym")).distinct()


_FAKE_SPACE = uuid.uuid5(uuid.NAMESPACE_OID, "cdrlens/unknown-cell").hex
_FAKE = _uuid5(f"'{_FAKE_SPACE}'", "unhex(replace({}, '-', ''))")


@query("unknown_cells", f"{_EVENT_ID} SELECT event_id, {_FAKE.format('uid')} AS cell_id FROM u")
def _(a):
    return _ids(a).select("event_id", generator.unknown_cell(F.col("uid")).alias("cell_id"))


# ---- a generated day of as many agents as there are users
_RADIUS, _NEAR, _FAR, _KMH = 3000.0, 1000.0, 6000.0, 30
_SPEC_PLANE = Plane(DEMO["area"]["origin_lat"], DEMO["area"]["origin_lon"])
_AGENTS = f"""size_ AS (SELECT count(DISTINCT user_id) AS n FROM events),
agent AS (SELECT unnest(generate_series(0, n - 1)) AS a FROM size_),
home AS (SELECT a, {_RADIUS} * sqrt({_u('place', 2, 'a', '0')}) AS rho, 2 * pi() * {_u('place', 3, 'a', '0')} AS phi FROM agent),
homes AS (SELECT a, rho * cos(phi) AS hx, rho * sin(phi) AS hy FROM home),
tries AS (SELECT *, sqrt({_NEAR ** 2} + {_FAR ** 2 - _NEAR ** 2} * {_u('place', 4, 'a', 't')}) AS d, 2 * pi() * {_u('place', 5, 'a', 't')} AS turn FROM homes, (SELECT unnest(generate_series(0, 99)) AS t)),
found AS (SELECT a, min(t) AS t FROM tries WHERE sqrt(pow(hx + d * cos(turn), 2) + pow(hy + d * sin(turn), 2)) <= {_RADIUS} GROUP BY a),
works AS (SELECT h.a, h.hx, h.hy, coalesce(t.hx + t.d * cos(t.turn), h.hx) AS wx, coalesce(t.hy + t.d * sin(t.turn), h.hy) AS wy FROM homes h LEFT JOIN found f ON f.a = h.a LEFT JOIN tries t ON t.a = f.a AND t.t = f.t),
hours AS (SELECT *, greatest(10, round(sqrt(pow(wx - hx, 2) + pow(wy - hy, 2)) / 1000 / {_KMH} * 60))::BIGINT AS commute, least(greatest(480 + round((2 * {_u('place', 6, 'a', '0')} - 1) * 60), 0), 1439)::BIGINT AS out_, least(greatest(1080 + round((2 * {_u('place', 7, 'a', '0')} - 1) * 60), 0), 1439)::BIGINT AS back0 FROM works),
backs AS (SELECT *, greatest(back0, least(out_ + commute + 11, 1439)) AS back1 FROM hours),
agents AS (SELECT *, CASE WHEN back1 + commute >= 1440 THEN 1439 - commute ELSE back1 END AS back FROM backs)"""


def _spec(a):
    return demo_spec(a.events.select("user_id").distinct().count())


@query("generated_agents", f"WITH {_AGENTS} SELECT a AS agent_id, round(hx, 4) AS hx, round(hy, 4) AS hy, round(wx, 4) AS wx, round(wy, 4) AS wy, commute, out_ AS leaves, back AS returns FROM agents")
def _(a):
    made = a.spark.createDataFrame(generator.make_agents(_spec(a)))
    return made.select("agent_id", *[F.round(c, 4).alias(c) for c in ("hx", "hy", "wx", "wy")], "commute", F.col("out").alias("leaves"), F.col("back").alias("returns"))


_HOURLY = "[" + ", ".join(f"{x}::DOUBLE" for x in generator.DIURNAL) + "]"
_TICKS = f"""ticked AS (SELECT g.*, t AS tick, t * 5 % 1440 AS minute, t * 5 // 1440 % 7 >= 5 AS weekend FROM agents g, (SELECT unnest(generate_series(0, 287)) AS t)),
phase AS (SELECT *, NOT weekend AND minute >= out_ AND minute < out_ + commute AS going, NOT weekend AND minute >= out_ + commute AND minute < back AS working FROM ticked),
way AS (SELECT *, NOT weekend AND NOT going AND NOT working AND minute >= back AND minute < back + commute AS coming, 1 + (2 * {_u('move', 1, 'a', 'tick')} - 1) * 0.25::DOUBLE AS wander FROM phase),
part AS (SELECT *, CASE WHEN going OR coming THEN least(greatest(least(greatest((minute - CASE WHEN going THEN out_ ELSE back END) / commute, 0), 1) * wander, 0), 1) ELSE 0 END AS raw FROM way),
done AS (SELECT *, CASE WHEN working THEN 1 WHEN coming THEN 1 - raw ELSE raw END AS share FROM part),
noisy AS (SELECT *, CASE WHEN going OR coming THEN 240 * share * (1 - share) ELSE 25 END AS noise FROM done),
moved AS (SELECT a, tick, hx + (wx - hx) * share + (2 * {_u('move', 2, 'a', 'tick')} - 1) * noise AS x, hy + (wy - hy) * share + (2 * {_u('move', 3, 'a', 'tick')} - 1) * noise AS y, {_HOURLY}[minute // 60 + 1] * 5 / 60 AS lam, {_u('events', 1, 'a', 'tick')} AS u FROM noisy),
counted AS (SELECT a, tick, x, y, list_sum(list_transform(generate_series(0, 15), lambda n: CASE WHEN u > list_sum(list_transform(generate_series(0, n), lambda j: exp(-lam) * pow(lam, j) / CAST(factorial(CAST(j AS INT)) AS DOUBLE))) THEN 1 ELSE 0 END))::BIGINT AS k FROM moved)"""


@query("generated_positions", f"WITH {_AGENTS}, {_TICKS} SELECT a AS agent_id, tick, round(x, 4) AS x, round(y, 4) AS y, k AS events FROM counted")
def _(a):
    spec = _spec(a)
    return generator.trajectories(a.spark, spec, generator.make_agents(spec)).select("agent_id", "tick", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "events")


_RUN_HEX = _RUN_UUID.replace("-", "")
_SITE = _uuid5(f"'{_RUN_HEX}'", "encode(concat('site ', q, ' ', r))")
_CELL = _uuid5("replace(site_id, '-', '')", "encode(concat('sector ', k))")
_CELLS = f"""wanted AS (SELECT 20 + least(20, CAST(floor({_u('place', 1, '0', '0')} * 21) AS BIGINT)) AS w),
lattice AS (SELECT q, r, q * q + q * r + r * r AS far FROM (SELECT unnest(generate_series(-20, 20)) AS q), (SELECT unnest(generate_series(-20, 20)) AS r)),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY far, r, q) AS n FROM lattice) WHERE n <= (SELECT w FROM wanted)),
sites AS (SELECT row_number() OVER (ORDER BY r, q) - 1 AS i, q, r, {_RADIUS} / (SELECT sqrt(max(far)) FROM chosen) AS spacing, {_SITE} AS site_id FROM chosen),
banded AS (SELECT s.*, k.k, k.k * 120.0::DOUBLE AS azimuth, {_u('band', 1, 'i', 'k')} AS b FROM sites s, (SELECT unnest(generate_series(0, 2)) AS k) k),
cells_ AS (SELECT i, k, site_id, {_CELL} AS cell_id, azimuth, CASE WHEN b <= 0.3 THEN 1800 WHEN b <= 0.3::DOUBLE + 0.4::DOUBLE THEN 2100 ELSE 2600 END AS freq_mhz, spacing * (q + r / 2.0::DOUBLE) AS sx, 1.5::DOUBLE * spacing / sqrt(3) * r AS sy FROM banded)"""
_LON, _LAT = f"({DEMO['area']['origin_lon']} + {{}} / CAST({_SPEC_PLANE.per_lon!r} AS DOUBLE))", f"({DEMO['area']['origin_lat']} + {{}} / 110540.0::DOUBLE)"


@query("generated_cells", f"WITH {_CELLS} SELECT cell_id, site_id, azimuth, freq_mhz, round({_LAT.format('sy')}, 7) AS lat, round({_LON.format('sx')}, 7) AS lon, 5000.0::DOUBLE AS r_max_m FROM cells_")
def _(a):
    made = a.spark.createDataFrame(generator.make_cells(demo_spec()))
    return made.select("cell_id", "site_id", "azimuth", F.col("freq_mhz").cast("int").alias("freq_mhz"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "r_max_m")


_BANDS = "bands(mhz) AS (VALUES (1800.0::DOUBLE), (2100.0::DOUBLE), (2600.0::DOUBLE))"
_AXIS = "58 - 12 * pow((degrees(atan2(23.5::DOUBLE, d)) - 6) / 65, 2) - (p * los + (1 - p) * greatest(los, 13.54::DOUBLE + 39.08::DOUBLE * log10(sqrt(d * d + 23.5::DOUBLE * 23.5::DOUBLE)) + 20 * log10(mhz / 1000)))"


def _axis_power(d: str) -> str:
    bp = "(4 * 24 * 0.5::DOUBLE * mhz * 1e6 / 3e8)"
    los = f"CASE WHEN d <= {bp} THEN 28 + 20 * log10(mhz / 1000) + 22 * log10(sqrt(d * d + 23.5::DOUBLE * 23.5::DOUBLE)) ELSE 28 + 20 * log10(mhz / 1000) + 40 * log10(sqrt(d * d + 23.5::DOUBLE * 23.5::DOUBLE)) - 9 * log10({bp} * {bp} + 23.5::DOUBLE * 23.5::DOUBLE) END"
    share = "CASE WHEN d <= 18 THEN 1 ELSE 18 / d + exp(-d / 63) * (1 - 18 / d) END"
    return f"list_transform([{d}], lambda d: list_transform([{los}], lambda los: list_transform([{share}], lambda p: {_AXIS})[1])[1])[1]"


@query(
    "coverage_ranges",
    f"""WITH RECURSIVE {_BANDS}, start AS (SELECT mhz, 23.5::DOUBLE / tan(radians(6)) AS low, 200000.0::DOUBLE AS high, 0 AS n FROM bands),
half(mhz, low, high, n) AS (SELECT * FROM start UNION ALL SELECT mhz, CASE WHEN {_axis_power('(low + high) / 2')} >= -110 THEN (low + high) / 2 ELSE low END, CASE WHEN {_axis_power('(low + high) / 2')} >= -110 THEN high ELSE (low + high) / 2 END, n + 1 FROM half WHERE n < 60)
SELECT mhz::INT AS freq_mhz, round((low + high) / 2, 4) AS range_m FROM half WHERE n = 60""",
)
def _(a):
    """How far a cell's power stays over the sensitivity on its axis, band by band."""
    model = radio.model_named("UMa")
    return a.spark.createDataFrame([(f, round(radio.coverage_range_m(model, 58.0, -110.0, 25.0, f, 65.0, 6.0), 4)) for f in (1800, 2100, 2600)], "freq_mhz int, range_m double")


_SIDE = 50.0
_SERVED = f"""busy AS (SELECT * FROM counted WHERE k > 0),
links AS (SELECT b.a, b.tick, b.x, b.y, b.k AS n_events, c.i, c.k, c.cell_id, c.azimuth, c.freq_mhz / 1000.0::DOUBLE AS ghz, b.x - c.sx AS dx, b.y - c.sy AS dy, sqrt(pow(b.x - c.sx, 2) + pow(b.y - c.sy, 2)) AS d2 FROM busy b, cells_ c),
reached AS (SELECT * FROM links WHERE d2 <= 5000),
spots AS (SELECT DISTINCT a, tick, i, CAST(floor(x / {_SIDE}) AS BIGINT) AS gx, CAST(floor(y / {_SIDE}) AS BIGINT) AS gy FROM reached),
hashed AS (SELECT a, tick, i, {_chain(_constant(SEED, generator._STREAM["radio"]), _unsigned("i"), _unsigned("gx"), _unsigned("gy"))} AS h FROM spots),
drawn AS (SELECT a, tick, i, {_unit(_chain("h", "1::UBIGINT"))} AS u, least(greatest({_normal(_chain("h", "2::UBIGINT"))}, -8), 8) AS z FROM hashed),
shaded AS (SELECT r.*, u, z, greatest(d2, 10) AS d, sqrt(pow(greatest(d2, 10), 2) + pow(23.5::DOUBLE, 2)) AS d3, 4 * 24 * 0.5::DOUBLE * ghz * 1e9 / 3e8 AS bp FROM reached r JOIN drawn w ON w.a = r.a AND w.tick = r.tick AND w.i = r.i),
lossy AS (SELECT *, CASE WHEN d <= bp THEN 28 + 20 * log10(ghz) + 22 * log10(d3) ELSE 28 + 20 * log10(ghz) + 40 * log10(d3) - 9 * log10(bp * bp + pow(23.5::DOUBLE, 2)) END AS direct, u < CASE WHEN d <= 18 THEN 1 ELSE 18 / d + exp(-d / 63) * (1 - 18 / d) END AS los, fmod(degrees(atan2(dx, dy)) - azimuth, 360) AS turn, degrees(atan2(23.5::DOUBLE, d2)) AS tilt FROM shaded),
beamed AS (SELECT *, CASE WHEN los THEN direct ELSE greatest(direct, 13.54::DOUBLE + 39.08::DOUBLE * log10(d3) + 20 * log10(ghz)) END AS loss, CASE WHEN turn > 180 THEN turn - 360 WHEN turn <= -180 THEN turn + 360 ELSE turn END AS off_axis FROM lossy),
received AS (SELECT *, 58 - loss - least(least(12 * pow(off_axis / 65, 2), 30) + least(12 * pow((tilt - 6) / 65, 2), 30), 30) + CASE WHEN los THEN 4 ELSE 6 END * z AS power FROM beamed),
served AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, tick ORDER BY power DESC, i, k) AS place FROM received) WHERE place = 1),
events_ AS (SELECT *, tick * 16 + seq AS slot FROM (SELECT *, unnest(generate_series(0, n_events - 1)) AS seq FROM served)),
rolled AS (SELECT *, power >= -110 AS covered, {_u('events', 2, 'a', 'slot')} AS u_kind, {_u('faults', 1, 'a', 'slot')} AS u_hit, {_u('faults', 2, 'a', 'slot')} AS u_rule, {_u('faults', 3, 'a', 'slot')} AS u_other FROM events_),
faulty AS (SELECT *, CASE WHEN covered AND u_hit < 0.02 THEN least(CAST(floor(u_rule / 0.2) AS INT), 4) + 1 END AS fault, ['MOC', 'MTC', 'SMS', 'DATA'][least(CAST(floor(u_kind * 4) AS INT), 3) + 1] AS event_type, CASE WHEN covered THEN CAST(floor(d2 / 78.12) AS INT) END AS ta_value,
  {_uuid5(f"'{identity.EVENT_NAMESPACE.replace('-', '')}'", f"unhex(concat('{_RUN_HEX}', lpad(lower(to_hex(a)), 8, '0'), lpad(lower(to_hex(tick)), 16, '0'), lpad(lower(to_hex(seq)), 8, '0')))")} AS event_id, 1704067200000000 + tick * 300000000 AS t FROM rolled)"""
_ALL = f"{_AGENTS}, {_TICKS}, {_CELLS}, {_SERVED}"


def _generated(a) -> dict[str, DataFrame]:
    return generator.generate(a.spark, _spec(a))


@query("generated_truth", f"WITH {_ALL} SELECT event_id, t AS time_us, a::INT AS agent_id, round({_LAT.format('y')}, 7) AS lat, round({_LON.format('x')}, 7) AS lon, covered, CASE WHEN {_SPLIT.replace('uid', 'event_id')} < 0.8 THEN 'C' ELSE 'V' END AS partition_key, fault AS injected_rule FROM faulty")
def _(a):
    return _generated(a)["truth"].select("event_id", "time_us", "agent_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "covered", "partition_key", "injected_rule")


def _number(prefix: str, digits: int, agent: str) -> str:
    return f"concat('{prefix}', lpad(CAST({agent} AS VARCHAR), {digits}, '0'))"


@query(
    "generated_records",
    f"""WITH {_ALL} SELECT event_id, (tick * (SELECT n FROM size_) + a) * 16 + seq AS seq, CASE WHEN fault = 3 THEN t - 7200000000 ELSE t END AS time_us, {_hmac(_number('9050', 8, 'a'))} AS subscriber,
  {_hmac(_number('35', 13, 'CASE WHEN fault = 5 THEN a + 1 + CAST(floor(u_other * 999) AS BIGINT) ELSE a END'))} AS device, event_type, CASE WHEN fault = 1 THEN {_FAKE.format('event_id')} WHEN fault = 2 THEN 'far' ELSE cell_id END AS cell_id, ta_value
FROM faulty WHERE covered AND fault IS DISTINCT FROM 4""",
)
def _(a):
    """Records of a generated day; a farthest cell goes by that name, as several can be equally far."""
    made = _generated(a)
    far = made["events"].filter("fault = 2").select("event_id", F.lit("far").alias("far"))
    return made["records"].join(far, "event_id", "left").select("event_id", "seq", "time_us", "subscriber", "device", "event_type", F.coalesce("far", "cell_id").alias("cell_id"), "ta_value")


@query("uncovered_share", f"WITH {_ALL} SELECT round(avg(CASE WHEN covered THEN 0 ELSE 1 END), 9) AS uncovered_share, avg(CASE WHEN covered THEN 0 ELSE 1 END) > 0.05 AS warn FROM faulty")
def _(a):
    return generator.uncovered_share(_generated(a)["events"]).select(F.round("uncovered_share", 9).alias("uncovered_share"), "warn")


@query("farthest_cells", f"WITH {_CELLS}, d AS (SELECT a.cell_id, sqrt(pow(a.sx - b.sx, 2) + pow(a.sy - b.sy, 2)) AS d FROM cells_ a, cells_ b) SELECT count(*) AS moved, round(min(far), 3) AS least_off FROM (SELECT f.event_id, max(d.d) AS far FROM faulty f JOIN d ON d.cell_id = f.cell_id WHERE f.fault = 2 GROUP BY 1)".replace(f"WITH {_CELLS}", f"WITH {_ALL}"))
def _(a):
    """Events whose cell was put to the farthest one, and how far that is at least."""
    made = _generated(a)
    plane = _SPEC_PLANE
    cells = made["cells"].select("cell_id", plane.x(F.col("lon")).alias("cx"), plane.y(F.col("lat")).alias("cy"))
    moved = made["events"].filter("fault = 2").select("event_id", "cell_id", "wrong_cell")
    both = moved.join(cells, "cell_id").join(cells.select(F.col("cell_id").alias("wrong_cell"), F.col("cx").alias("fx"), F.col("cy").alias("fy")), "wrong_cell")
    return both.agg(F.count("*").alias("moved"), F.round(F.min(F.hypot(F.col("cx") - F.col("fx"), F.col("cy") - F.col("fy"))), 3).alias("least_off"))
