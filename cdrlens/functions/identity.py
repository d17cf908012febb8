"""Deterministic identifiers, splits and uniform numbers.

Names, digests and splits are Spark expressions; 64-bit mixing needs unsigned overflow, so it runs on
NumPy arrays (as pandas UDFs on columns).
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the name space of event ids.
EVENT_NAMESPACE = "29b15779-62b7-4b8d-889e-417227237e61"
#: An HMAC key's least length, and what a subscriber's and a device's numbers look like.
MIN_SALT_BYTES = 32
SUBSCRIBER_PREFIX, DEVICE_PREFIX = "9050", "35"


def _plain(u: Column) -> Column:
    return F.regexp_replace(u.cast("string"), "-", "")


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a binary name, in canonical lower case."""
    digest = F.sha1(F.concat(F.lit(uuid.UUID(namespace).bytes), name))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    part = F.concat(F.lit("5"), F.substring(digest, 14, 3), F.element_at(F.split(variant, ""), nibble + 1), F.substring(digest, 18, 15))
    hexed = F.concat(F.substring(digest, 1, 12), part)
    return F.lower(F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def event_id(run_id: Column, agent: Column, tick: Column, seq: Column) -> Column:
    """Id of the seq-th event of an agent in a tick of a run: its name is the four, big-endian."""
    name = F.concat(_plain(run_id), F.lpad(F.hex(agent.cast("long")), 8, "0"), F.lpad(F.hex(tick.cast("long")), 16, "0"), F.lpad(F.hex(seq.cast("long")), 8, "0"))
    return uuid5(EVENT_NAMESPACE, F.unhex(name))


def _seed_hex(seed: int) -> str:
    return f"{seed & 0xFFFFFFFFFFFFFFFF:016x}"


def split_uniform(event: Column, seed: int) -> Column:
    """Number in [0, 1) of an event: the first 52 bits of SHA-256 over the id and the seed."""
    digest = F.sha2(F.unhex(F.concat(_plain(event), F.lit(_seed_hex(seed)))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def partition_key(event: Column, seed: int, ratio: float = 0.8) -> Column:
    """'C' for a share of ``ratio`` of the events, 'V' for the rest."""
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must be in [0, 1]")
    return F.when(split_uniform(event, seed) < ratio, F.lit("C")).otherwise(F.lit("V"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def thinning_array(ids: pd.Series, seed: int) -> np.ndarray:
    """Number in [0, 1) of each UUID: FNV-1a over seed and id, mixed, its upper 53 bits."""
    if not len(ids):
        return np.zeros(0)
    raw = np.frombuffer(b"".join(uuid.UUID(i).bytes for i in ids), np.uint8).reshape(-1, 16)
    h = np.full(len(raw), 14695981039346656037, np.uint64)
    prime = np.uint64(1099511628211)
    for byte in bytes.fromhex(_seed_hex(seed)):
        h = (h ^ np.uint64(byte)) * prime
    for k in range(16):
        h = (h ^ raw[:, k].astype(np.uint64)) * prime
    return (_mix(h) >> np.uint64(11)).astype(float) / float(1 << 53)


def thinning(event: Column, seed: int) -> Column:
    @F.pandas_udf(T.DoubleType())
    def compute(ids: pd.Series) -> pd.Series:
        return pd.Series(thinning_array(ids, seed))

    return compute(event)


def _splitmix(x: np.ndarray) -> np.ndarray:
    return _mix(x + np.uint64(0x9E3779B97F4A7C15))


def chain(*parts) -> np.ndarray:
    """Fold whole numbers (scalars or arrays) into one 64-bit hash each."""
    arrays = np.broadcast_arrays(*[np.asarray(p).astype(np.int64).view(np.uint64) if np.asarray(p).dtype.kind == "i" else np.asarray(p, np.uint64) for p in parts])
    with np.errstate(over="ignore"):
        h = np.array(arrays[0], np.uint64)
        for p in arrays[1:]:
            h = _splitmix(h ^ _splitmix(np.array(p, np.uint64)))
    return h


def open_unit(h: np.ndarray) -> np.ndarray:
    """Number in (0, 1) of a 64-bit hash."""
    return ((h >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def uniform(seed: int, stream: int, purpose: int, agent, tick) -> np.ndarray:
    """Counter-based uniform number of an agent in a tick; no state, so any order and split agree."""
    return open_unit(chain(np.uint64(seed & 0xFFFFFFFFFFFFFFFF), np.uint64(stream), np.uint64(purpose), agent, tick))


def standard_normal(h: np.ndarray) -> np.ndarray:
    """Box-Muller from one 64-bit hash."""
    with np.errstate(over="ignore"):
        return np.sqrt(-2 * np.log(open_unit(h))) * np.cos(2 * np.pi * open_unit(_splitmix(h)))


def uniform_column(seed: int, stream: int, purpose: int, agent: Column, tick: Column) -> Column:
    """:func:`uniform` of two columns of whole numbers."""

    @F.pandas_udf(T.DoubleType())
    def compute(a: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(uniform(seed, stream, purpose, a.to_numpy(np.int64), t.to_numpy(np.int64)))

    return compute(agent, tick)


def normal_column(seed: int, agent: Column, tick: Column) -> Column:
    """:func:`standard_normal` of the hash of two columns of whole numbers."""

    @F.pandas_udf(T.DoubleType())
    def compute(a: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(standard_normal(chain(np.uint64(seed & 0xFFFFFFFFFFFFFFFF), a.to_numpy(np.int64), t.to_numpy(np.int64))))

    return compute(agent, tick)


def subscriber_number(agent: Column) -> Column:
    return F.concat(F.lit(SUBSCRIBER_PREFIX), F.lpad(agent.cast("string"), 8, "0"))


def device_number(agent: Column) -> Column:
    return F.concat(F.lit(DEVICE_PREFIX), F.lpad(agent.cast("string"), 13, "0"))


def pseudonym(value: Column, salt: bytes) -> Column:
    """HMAC-SHA256 in hex, as two nested digests over the padded key."""
    if len(salt) < MIN_SALT_BYTES:
        raise ValueError(f"the salt needs {MIN_SALT_BYTES} bytes at least")
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), value.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)
