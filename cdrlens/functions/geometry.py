"""Regions of the plane: sectors, rings, polygons of hexagons, and their forms as WKB and GeoJSON.

A multipolygon is a list of polygons, a polygon a list of closed rings (``(n, 2)`` arrays), the first of
which is its shell (anticlockwise), the others its holes.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np

from .geo import HexLattice, bearing_degrees, wrap_degrees
from .mathops import NP

#: Fixed value: radius of the sphere with the ellipsoid's area.
AUTHALIC_RADIUS_M = 6_371_007.2
#: Overlaps under this share of a hexagon are rounding noise.
LEAST_SHARE = 1e-12
ARC_STEP_DEGREES = 1.0
#: A place this near the apex of a sector is on it.
APEX_M = 1e-6


@dataclass(frozen=True)
class Sector:
    """The part of a disk that an antenna serves; the whole disk from 360 degrees on."""

    x: float
    y: float
    azimuth: float
    beam_width: float
    radius: float

    def __post_init__(self):
        if not (0 < self.beam_width <= 360 and 0 < self.radius < math.inf and math.isfinite(self.azimuth)):
            raise ValueError("a sector needs a beam in (0, 360], a positive finite radius and a finite azimuth")

    @property
    def axis(self) -> float:
        return float(wrap_degrees(self.azimuth))

    def off_axis(self, x, y):
        dx, dy = np.asarray(x, float) - self.x, np.asarray(y, float) - self.y
        return np.where((dx == 0) & (dy == 0), 0.0, wrap_degrees(bearing_degrees(dx, dy) - self.axis))

    def contains(self, x, y):
        near = np.hypot(np.asarray(x, float) - self.x, np.asarray(y, float) - self.y) <= self.radius
        return near if self.beam_width >= 360 else near & (np.abs(self.off_axis(x, y)) <= self.beam_width / 2)

    def centroid(self) -> tuple[float, float]:
        half = math.radians(self.beam_width / 2)
        if half >= math.pi:
            return self.x, self.y
        reach = 2 * self.radius * math.sin(half) / (3 * half)
        return self.x + reach * math.sin(math.radians(self.axis)), self.y + reach * math.cos(math.radians(self.axis))

    def box(self) -> tuple[float, float, float, float]:
        half = min(self.beam_width / 2, 180.0)
        turns = [a for a in range(-540, 541, 90) if self.axis - half <= a <= self.axis + half]
        angle = np.radians([self.axis - half, self.axis + half, *turns])
        xs, ys = np.append(self.radius * np.sin(angle), 0.0), np.append(self.radius * np.cos(angle), 0.0)
        return self.x + xs.min(), self.y + ys.min(), self.x + xs.max(), self.y + ys.max()

    def cells(self, lattice: HexLattice) -> tuple[np.ndarray, np.ndarray]:
        """Hexagons whose centres are inside, ordered by r, then q."""
        q, r = lattice.box(*self.box())
        inside = self.contains(*lattice.centre(q, r))
        return q[inside], r[inside]

    def outline(self) -> list:
        """The sector as a multipolygon with an arc point a degree."""
        return [[arc(self.x, self.y, self.radius, self.beam_width, self.axis, True)]] if self.beam_width < 360 else disk(self.x, self.y, self.radius)


def arc(x: float, y: float, radius: float, span: float, middle: float, apex: bool) -> np.ndarray:
    steps = max(3, math.ceil(span / ARC_STEP_DEGREES))
    angle = np.radians(middle + span / 2 - span * np.arange(steps + apex) / steps)
    points = np.stack([x + radius * np.sin(angle), y + radius * np.cos(angle)], axis=1)
    if apex:
        points = np.concatenate([[[x, y]], points])
    return np.concatenate([points, points[:1]])


def in_arc(dx, dy, radius, span, middle, m=NP):
    """Whether a place dx east and dy north of the centre is in the polygon that :func:`arc` draws, with the centre as
    its apex unless the span is 360, or on its outline: no further away than the chord in its direction."""
    steps = m.greatest(3.0, -m.floor(-span / ARC_STEP_DEGREES))
    step, far = span / steps, m.hypot(dx, dy)
    off = wrap_degrees(bearing_degrees(dx, dy, m) - middle, m)
    part = (span / 2 - off) / step
    half, rad = step / 2, math.pi / 180
    chord = radius * m.cos(half * rad) / m.cos(((part - m.floor(part)) * step - half) * rad)
    return (far < APEX_M) | ((m.absolute(off) <= span / 2) & (far <= chord))


def disk(x: float, y: float, radius: float) -> list:
    if not 0 < radius < math.inf:
        raise ValueError("a disk needs a positive finite radius")
    return [[arc(x, y, radius, 360.0, 0.0, False)]]


def disk_overlap(polygons: np.ndarray, x: float, y: float, radius: float) -> np.ndarray:
    """Exact areas that polygons (n, corners, 2) share with a disk.

    Each edge adds the signed area between it and the centre, cut off at the circle: the parts outside
    as circular sectors, the part inside as a triangle.
    """
    if not radius > 0:
        return np.zeros(len(polygons))
    a = polygons - np.array([x, y])
    d = np.roll(a, -1, axis=1) - a
    qa = (d * d).sum(axis=2)
    qb = 2 * (a * d).sum(axis=2)
    root = np.sqrt(np.maximum(qb * qb - 4 * qa * ((a * a).sum(axis=2) - radius * radius), 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        enter = np.where((root > 0) & (qa > 0), np.clip((-qb - root) / (2 * qa), 0, 1), 0.0)
        leave = np.where((root > 0) & (qa > 0), np.clip((-qb + root) / (2 * qa), 0, 1), 0.0)
    p, s, b = a + enter[..., None] * d, a + leave[..., None] * d, a + d

    def cross(u, v):
        return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]

    def turned(u, v):
        return 0.5 * radius * radius * np.arctan2(cross(u, v), (u * v).sum(axis=2))

    parts = turned(a, p) + cross(p, s) / 2 + turned(s, b)
    return np.abs(np.where(qa > 0, parts, 0.0).sum(axis=1))


def ring_shares(polygons: np.ndarray, x: float, y: float, inner: float, outer: float) -> np.ndarray:
    """Share of each polygon's area that lies between two circles."""
    nxt = np.roll(polygons, -1, axis=1)
    area = np.abs((polygons[..., 0] * nxt[..., 1] - nxt[..., 0] * polygons[..., 1]).sum(axis=1)) / 2
    between = np.maximum(disk_overlap(polygons, x, y, outer) - disk_overlap(polygons, x, y, inner), 0.0)
    share = np.where(area > 0, between / np.where(area > 0, area, 1.0), 0.0)
    return np.where(share < LEAST_SHARE, 0.0, np.minimum(share, 1.0))


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2) if len(ring) > 3 else 0.0


def in_ring(ring: np.ndarray, x, y) -> np.ndarray:
    """Whether points are inside a closed ring: an odd number of edges to their right."""
    x, y = np.atleast_1d(np.asarray(x, float))[:, None], np.atleast_1d(np.asarray(y, float))[:, None]
    x0, y0, x1, y1 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
    spans = (y0 > y) != (y1 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x0 + (y - y0) / (y1 - y0) * (x1 - x0)
    return (spans & (x < at)).sum(axis=1) % 2 == 1


def on_ring(ring: np.ndarray, x, y, slack: float = 1e-12) -> np.ndarray:
    x, y = np.atleast_1d(np.asarray(x, float))[:, None], np.atleast_1d(np.asarray(y, float))[:, None]
    a, d = ring[:-1], np.diff(ring, axis=0)
    t = (x - a[:, 0]) * d[:, 1] - (y - a[:, 1]) * d[:, 0]
    length = np.hypot(d[:, 0], d[:, 1])
    along = (x - a[:, 0]) * d[:, 0] + (y - a[:, 1]) * d[:, 1]
    return ((np.abs(t) <= slack * np.maximum(length, 1e-300)) & (along >= -slack) & (along <= length * length + slack)).any(axis=1)


def contains(shape: list, x, y, boundary: bool = False) -> np.ndarray:
    """Whether points are inside a multipolygon and none of its holes; on the boundary if asked for."""
    out = np.zeros(np.atleast_1d(np.asarray(x)).shape, bool)
    for shell, *holes in shape:
        inside = in_ring(shell, x, y)
        for h in holes:
            inside &= ~in_ring(h, x, y)
        out |= inside
        if boundary:
            for ring in (shell, *holes):
                out |= on_ring(ring, x, y)
    return out


def meets_box(shape: list, x0: float, y0: float, x1: float, y1: float) -> bool:
    """Whether a multipolygon and a rectangle share a point."""
    corners = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]])
    for polygon in shape:
        for ring in polygon:
            if ((ring[:, 0] >= x0) & (ring[:, 0] <= x1) & (ring[:, 1] >= y0) & (ring[:, 1] <= y1)).any():
                return True
            a, b = ring[:-1], ring[1:]
            for c, d in zip(corners, np.roll(corners, -1, axis=0), strict=True):
                def side(p, q, r):
                    return (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])

                if ((side(a, b, c) * side(a, b, d) <= 0) & (side(c, d, a) * side(c, d, b) <= 0)).any():
                    return True
    return bool(contains(shape, corners[:, 0], corners[:, 1]).any())


def hexagons_to_shape(q: np.ndarray, r: np.ndarray, lattice: HexLattice) -> list:
    """The union of hexagons as a multipolygon, largest part first.

    Corners are whole numbers on a grid of half widths and half sizes, so edges meet exactly. Edges with
    no hexagon on their far side, directed with the hexagon on the left, form the rings: a corner of
    this lattice is left by one of them at most.
    """
    cells = np.unique(np.stack([np.asarray(r, np.int64), np.asarray(q, np.int64)], axis=1), axis=0)
    if not len(cells):
        raise ValueError("no hexagons")
    r, q = cells[:, 0], cells[:, 1]
    span = np.int64(1) << 32
    own = r * span + q
    corner_x, corner_y = np.array([1, 1, 0, -1, -1, 0]), np.array([-1, 1, 2, 1, -1, -2])
    starts, ends = [], []
    for k, (dq, dr) in enumerate(HexLattice.STEPS):
        free = ~np.isin((r + dr) * span + q + dq, own, assume_unique=True)
        for out, at in ((starts, k), (ends, (k + 1) % 6)):
            out.append((3 * r[free] + corner_y[at]) * span + 2 * q[free] + r[free] + corner_x[at])
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(start)
    start, follow = start[order], np.searchsorted(start[order], end[order])
    y, x = (start + (span >> 1)) // span, 0
    x = start - y * span
    points = np.stack([x * (lattice.pitch / 2), y * (lattice.size / 2)], axis=1)
    left, rings = np.ones(len(start), bool), []
    step = follow.tolist()
    for k in range(len(start)):
        if left[k]:
            ring, at = [k], step[k]
            while at != k:
                ring.append(at)
                at = step[at]
            left[ring] = False
            rings.append(points[[*ring, k]])
    shells = sorted((s for s in rings if signed_area(s) > 0), key=lambda s: (-signed_area(s), s[0, 1], s[0, 0]))
    shape = [[s] for s in shells]
    for hole in (h for h in rings if signed_area(h) < 0):
        # a hole belongs to the smallest shell around it; its first corner may lie on no other ring
        around = [k for k, s in enumerate(shells) if in_ring(s, hole[0, 0], hole[0, 1])[0]]
        shape[max(around)].append(hole)
    return shape


def plane_centroid(shape: list) -> tuple[float, float]:
    sx = sy = area = 0.0
    for polygon in shape:
        for ring in polygon:
            x, y = ring[:, 0], ring[:, 1]
            c = x[:-1] * y[1:] - x[1:] * y[:-1]
            sx += float(((x[:-1] + x[1:]) * c).sum())
            sy += float(((y[:-1] + y[1:]) * c).sum())
            area += float(c.sum()) / 2
    if area == 0:
        corners = np.concatenate([p[0] for p in shape])
        return float(corners[:, 0].mean()), float(corners[:, 1].mean())
    return sx / (6 * area), sy / (6 * area)


def plane_area(shape: list) -> float:
    return sum(abs(signed_area(p[0])) - sum(abs(signed_area(h)) for h in p[1:]) for p in shape)


def to_lonlat(shape: list, plane) -> list:
    return [[np.stack(plane.lonlat(ring[:, 0], ring[:, 1]), axis=1) for ring in polygon] for polygon in shape]


def sphere_area_km2(shape: list) -> float:
    """Area of a multipolygon in longitude and latitude on the sphere."""

    def ring_area(ring):
        lon, lat = np.radians(ring[:, 0]), np.radians(ring[:, 1])
        step = np.fmod(np.diff(lon) + 3 * np.pi, 2 * np.pi) - np.pi
        return abs(float((step * (np.sin(lat[:-1]) + np.sin(lat[1:]))).sum())) * AUTHALIC_RADIUS_M**2 / 2

    return sum(ring_area(p[0]) - sum(ring_area(h) for h in p[1:]) for p in shape) / 1e6


def vertex_count(shape: list) -> int:
    return sum(len(ring) for polygon in shape for ring in polygon)


def to_wkb(shape: list) -> bytes:
    """Little-endian well-known binary of a multipolygon."""
    out = [struct.pack("<BII", 1, 6, len(shape))]
    for polygon in shape:
        out.append(struct.pack("<BII", 1, 3, len(polygon)))
        for ring in polygon:
            out += [struct.pack("<I", len(ring)), np.ascontiguousarray(ring, "<f8").tobytes()]
    return b"".join(out)


def from_wkb(data: bytes) -> list:
    order, kind, parts = struct.unpack_from("<BII", data, 0)
    if order != 1 or kind != 6:
        raise ValueError("a little-endian multipolygon is needed")
    at, shape = 9, []
    for _ in range(parts):
        (rings,) = struct.unpack_from("<I", data, at + 5)
        at, polygon = at + 9, []
        for _ in range(rings):
            (n,) = struct.unpack_from("<I", data, at)
            polygon.append(np.frombuffer(data, "<f8", 2 * n, at + 4).reshape(n, 2))
            at += 4 + 16 * n
        shape.append(polygon)
    return shape


def point_wkb(lon: float, lat: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, lon, lat)


def to_coordinates(shape: list) -> list:
    """Nested lists as GeoJSON has them."""
    return [[ring.tolist() for ring in polygon] for polygon in shape]


def is_valid(shape: list) -> bool:
    """Every ring is closed, has three corners or more and an area, and holes are in their shells."""
    for polygon in shape:
        for ring in polygon:
            if len(ring) < 4 or not np.array_equal(ring[0], ring[-1]) or not np.isfinite(ring).all() or signed_area(ring) == 0:
                return False
        for hole in polygon[1:]:
            if not contains([[polygon[0]]], hole[:-1, 0], hole[:-1, 1], boundary=True).all():
                return False
    return bool(shape)


def _crossed(ring: np.ndarray) -> list[tuple]:
    """An open ring with the points in it at which its own edges cross."""
    a, b = ring, np.roll(ring, -1, axis=0)
    d = b - a
    n = len(ring)
    extra: list[list[tuple[float, tuple]]] = [[] for _ in range(n)]
    for i in range(n - 2):
        j = np.arange(i + 2, n - (i == 0))
        if not len(j):
            continue
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        w = a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / cross
            u = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / cross
        for k in np.nonzero((cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1))[0].tolist():
            point = tuple((a[i] + t[k] * d[i]).tolist())
            extra[i].append((float(t[k]), point))
            extra[int(j[k])].append((float(u[k]), point))
    out = []
    for i in range(n):
        out += [tuple(a[i].tolist()), *[p for _, p in sorted(extra[i])]]
    return out


def _loops(ring: np.ndarray) -> list[np.ndarray]:
    """A ring cut where it meets or crosses itself, as closed rings that do neither and have an area."""
    ring = ring[np.isfinite(ring).all(axis=1)]
    if len(ring) > 1 and (ring[0] == ring[-1]).all():
        ring = ring[:-1]
    if len(ring):
        ring = ring[(ring != np.roll(ring, 1, axis=0)).any(axis=1)]
    if len(ring) < 3:
        return []
    path, at, loops = [], {}, []
    for p in [*(points := _crossed(ring)), points[0]]:
        if p in at:
            loops.append(np.array([*path[at[p] :], p]))
            for q in path[at[p] + 1 :]:
                at.pop(q, None)
            del path[at[p] + 1 :]
        else:
            at[p] = len(path)
            path.append(p)
    return [x for x in loops if len(x) > 3 and abs(signed_area(x)) > 0]


def repair(shape: list) -> tuple[list, bool]:
    """A valid multipolygon of the same rings, and whether it had to be changed: rings are closed, cut where they
    cross themselves, turned the right way, and dropped if they have no area; holes go to the smallest shell around."""
    if is_valid(shape) and all(len(_loops(ring)) == 1 and (signed_area(ring) > 0) == (k == 0) for polygon in shape for k, ring in enumerate(polygon)):
        return shape, False
    shells = [x if signed_area(x) > 0 else x[::-1] for polygon in shape for x in (_loops(polygon[0]) if polygon else [])]
    holes = [x if signed_area(x) < 0 else x[::-1] for polygon in shape for ring in polygon[1:] for x in _loops(ring)]
    shells.sort(key=lambda x: -signed_area(x))
    out = [[x] for x in shells]
    for hole in holes:
        around = [k for k, x in enumerate(shells) if contains([[x]], hole[:-1, 0], hole[:-1, 1], boundary=True).all()]
        if around:
            out[max(around)].append(hole)
    return out, True
