"""Distances, the local plane, angles and the hexagonal lattice."""

from __future__ import annotations

import math

import numpy as np

from .mathops import NP

#: Mean Earth radius, and metres a degree in the local plane.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE_LAT = 110_540.0
METRES_PER_DEGREE_LON_EQUATOR = 111_320.0
MAX_ORIGIN_LAT = 85.0


def haversine_m(lat1, lon1, lat2, lon2, m=NP):
    """Great-circle distance in metres between points in degrees."""
    rad = math.pi / 180
    s1, s2 = m.sin((lat2 - lat1) * rad / 2), m.sin((lon2 - lon1) * rad / 2)
    a = s1 * s1 + m.cos(lat1 * rad) * m.cos(lat2 * rad) * s2 * s2
    return 2 * EARTH_RADIUS_M * m.arcsin(m.sqrt(m.least(1.0, a)))


class Plane:
    """Local equirectangular plane around an origin; x east and y north, in metres."""

    def __init__(self, origin_lat: float, origin_lon: float):
        if not (abs(origin_lat) <= MAX_ORIGIN_LAT and abs(origin_lon) <= 180):
            raise ValueError(f"origin ({origin_lat}, {origin_lon}) is outside the plane's range")
        self.lat, self.lon = origin_lat, origin_lon
        self.per_lon = math.cos(math.radians(origin_lat)) * METRES_PER_DEGREE_LON_EQUATOR

    def x(self, lon):
        return (lon - self.lon) * self.per_lon

    def y(self, lat):
        return (lat - self.lat) * METRES_PER_DEGREE_LAT

    def lonlat(self, x, y):
        return self.lon + x / self.per_lon, self.lat + y / METRES_PER_DEGREE_LAT


def distance(x1, y1, x2, y2, m=NP):
    return m.hypot(x1 - x2, y1 - y2)


def wrap_degrees(angle, m=NP):
    """The same angle in (-180, 180]."""
    r = m.remainder(angle, 360.0)
    return m.where(r > 180, r - 360, m.where(r <= -180, r + 360, r))


def bearing_degrees(dx, dy, m=NP):
    """Clockwise from north."""
    return m.arctan2(dx, dy) * (180 / math.pi)


def elevation_degrees(height, ground, m=NP):
    """Angle below the horizontal from an antenna ``height`` above a point ``ground`` metres away."""
    return m.where(ground <= 0, 90.0, m.arctan2(height + 0.0 * ground, ground) * (180 / math.pi))


class HexLattice:
    """Pointy-top hexagons in axial coordinates; ``pitch`` is the distance of neighbouring centres."""

    #: Steps to the six neighbours, anticlockwise from east.
    STEPS = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))

    def __init__(self, pitch: float):
        if not 0 < pitch < math.inf:
            raise ValueError("the lattice's pitch must be positive and finite")
        self.pitch, self.size = pitch, pitch / math.sqrt(3)

    @property
    def cell_area(self) -> float:
        return self.pitch * self.pitch * math.sqrt(3) / 2

    def centre(self, q, r):
        return self.pitch * (q + r / 2), 1.5 * self.size * r

    def at(self, x, y, m=NP):
        """Axial coordinates of the hexagon around a point, by rounding in cube coordinates."""
        q = (x * (math.sqrt(3) / 3) - y / 3) / self.size
        r = y * (2 / 3) / self.size
        rq, rr, rs = m.round_away(q), m.round_away(r), m.round_away(-q - r)
        dq, dr, ds = m.absolute(rq - q), m.absolute(rr - r), m.absolute(rs + q + r)
        fix_q = (dq > dr) & (dq > ds)
        return m.where(fix_q, -rr - rs, rq), m.where(~fix_q & (dr > ds), -rq - rs, rr)

    def corners(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Corner points (cells, 6, 2), anticlockwise from 30 degrees south of east."""
        cx, cy = self.centre(np.asarray(q, float), np.asarray(r, float))
        angle = np.radians(60.0 * np.arange(6) - 30.0)
        return np.stack([cx[:, None] + self.size * np.cos(angle), cy[:, None] + self.size * np.sin(angle)], axis=2)

    def box(self, x0: float, y0: float, x1: float, y1: float) -> tuple[np.ndarray, np.ndarray]:
        """All cells whose centres can lie in a rectangle, ordered by r, then q."""
        height = 1.5 * self.size
        r = np.arange(math.floor(y0 / height) - 1, math.ceil(y1 / height) + 2)
        first = np.floor(x0 / self.pitch - r / 2).astype(int) - 1
        last = np.ceil(x1 / self.pitch - r / 2).astype(int) + 1
        width = last - first + 1
        rows = np.repeat(r, width)
        q = np.arange(len(rows)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
        return q, rows

    def disk(self, x: float, y: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Cells with a centre at most ``radius`` away."""
        q, r = self.box(x - radius, y - radius, x + radius, y + radius)
        cx, cy = self.centre(q, r)
        inside = (cx - x) ** 2 + (cy - y) ** 2 <= radius * radius
        return q[inside], r[inside]


def hex_distance(q1, r1, q2, r2, m=NP):
    dq, dr = q1 - q2, r1 - r2
    return (m.absolute(dq) + m.absolute(dr) + m.absolute(dq + dr)) / 2
