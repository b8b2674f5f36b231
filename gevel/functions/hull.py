"""Geometry that has no expression form, as small Arrow-batched helpers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))


def ring_points(ring) -> np.ndarray:
    return np.array([[p["x"], p["y"]] for p in ring], dtype=float)


def as_ring(points: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def hull_points(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without the closing point."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) >= 2:
                a, b = out[-2], out[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    pts = pts.tolist()
    return np.array(half(pts) + half(pts[::-1]))


def smallest_box(points: np.ndarray) -> np.ndarray:
    """Corners of the enclosing rectangle of least area, five points.

    The box lies along a hull edge. Among equals the smallest turn against the
    x axis wins.
    """
    hull = hull_points(points)
    if len(hull) < 3:
        lo, hi = hull.min(axis=0), hull.max(axis=0)
        if len(hull) == 2:
            return np.array([hull[0], hull[1], hull[1], hull[0], hull[0]])
        return np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]], lo])
    sides = np.roll(hull, -1, axis=0) - hull
    turns = np.unique(np.round(np.mod(np.arctan2(sides[:, 1], sides[:, 0]), np.pi / 2), 12))
    best = None
    for turn in turns:
        c, s = np.cos(turn), np.sin(turn)
        local = hull @ np.array([[c, -s], [s, c]])
        lo, hi = local.min(axis=0), local.max(axis=0)
        size = float(np.prod(hi - lo))
        if best is None or size < best[0] * (1 - 1e-9):
            best = (size, turn, lo, hi)
    _, turn, lo, hi = best
    c, s = np.cos(turn), np.sin(turn)
    corners = np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]], lo])
    return corners @ np.array([[c, s], [-s, c]])


@F.pandas_udf(RINGS)
def oriented_box(rings: pd.Series) -> pd.Series:
    return rings.map(lambda r: None if r is None else [as_ring(smallest_box(ring_points(r[0])))])


def box_sides(box: Column) -> tuple[Column, Column]:
    """True short and long side of an oriented box."""
    ring = box[0]
    one = F.hypot(ring[1]["x"] - ring[0]["x"], ring[1]["y"] - ring[0]["y"])
    two = F.hypot(ring[2]["x"] - ring[1]["x"], ring[2]["y"] - ring[1]["y"])
    return F.least(one, two), F.greatest(one, two)


def _turn(px, py, qx, qy, x, y):
    return (qx - px) * (y - py) - (qy - py) * (x - px)


def meets(p: np.ndarray, q: np.ndarray, segments: np.ndarray) -> bool:
    """Whether a segment from ``p`` to ``q`` crosses one of ``segments`` (x1, y1, x2, y2) or runs through an end of one.

    Ends that are ``p`` or ``q`` themselves do not count.
    """
    x1, y1, x2, y2 = segments.T
    lo, hi = np.minimum(p, q), np.maximum(p, q)
    near = (np.maximum(x1, x2) >= lo[0]) & (np.minimum(x1, x2) <= hi[0])
    near &= (np.maximum(y1, y2) >= lo[1]) & (np.minimum(y1, y2) <= hi[1])
    if not near.any():
        return False
    x1, y1, x2, y2 = x1[near], y1[near], x2[near], y2[near]
    a, b = _turn(*p, *q, x1, y1), _turn(*p, *q, x2, y2)
    c, d = _turn(x1, y1, x2, y2, *p), _turn(x1, y1, x2, y2, *q)
    if ((a * b < 0) & (c * d < 0)).any():
        return True
    for side, x, y in ((a, x1, y1), (b, x2, y2)):
        own = ((x == p[0]) & (y == p[1])) | ((x == q[0]) & (y == q[1]))
        between = (x >= lo[0]) & (x <= hi[0]) & (y >= lo[1]) & (y <= hi[1])
        if ((side == 0) & between & ~own).any():
            return True
    return False


def encloses(outline: np.ndarray, points: np.ndarray) -> bool:
    """Whether a point that is no corner of the closed ``outline`` lies within it."""
    lo, hi = outline.min(axis=0), outline.max(axis=0)
    points = points[((points >= lo) & (points <= hi)).all(axis=1)]
    points = points[~(points[:, None] == outline[None]).all(axis=2).any(axis=1)]
    if not len(points):
        return False
    (x1, y1), (x2, y2) = outline[:-1].T, outline[1:].T
    x, y = points[:, :1], points[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        right = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return bool((right.sum(axis=1) % 2 == 1).any())


def thin_rings(rings: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """Closed rings without the points nearer than ``tolerance`` to the line kept.

    What a run of points leaves is one segment in its place. It may not cross, touch or
    pass over any other part of any of the rings, as they are by then: where it would, the
    run is split at its farthest point instead, and that point stays. Of every ring three
    different points stay at least.
    """
    segments = [np.hstack([r[:-1], r[1:]]) for r in rings]
    alive = [np.ones(len(s), bool) for s in segments]
    chords: list[np.ndarray] = []
    every = np.concatenate(rings)
    out = []
    for k, points in enumerate(rings):
        n = len(points)
        if n <= 4:
            out.append(points)
            continue
        keep = np.zeros(n, bool)

        def farthest(i: int, j: int, points=points) -> tuple[float, int]:
            a, d = points[i], points[j] - points[i]
            rel, norm = points[i + 1 : j] - a, float(d @ d)
            t = np.clip(rel @ d / norm, 0, 1) if norm > 0 else np.zeros(len(rel))
            off = np.hypot(*(rel - t[:, None] * d).T)
            m = int(np.argmax(off))
            return float(off[m]), i + 1 + m

        # A closed ring has no two ends: start from its first point, the one farthest off, and a third.
        far = int(np.argmax(np.hypot(*(points - points[0]).T)))
        parts = [(i, j) for i, j in ((0, far), (far, n - 1)) if j - i > 1]
        third = max((farthest(i, j) for i, j in parts), default=(0.0, far))[1]
        fixed = sorted({0, far, third, n - 1})
        keep[fixed] = True
        todo = list(zip(fixed, fixed[1:]))
        while todo:
            i, j = todo.pop()
            if j - i < 2:
                continue
            off, m = farthest(i, j)
            if off <= tolerance:
                own = alive[k].copy()
                own[i:j] = False
                others = [s[a] for x, (s, a) in enumerate(zip(segments, alive)) if x != k]
                around = np.concatenate([segments[k][own], *others, *chords])
                free = not meets(points[i], points[j], around)
                if free and not encloses(np.vstack([points[i : j + 1], points[i : i + 1]]), every):
                    alive[k][i:j] = False
                    chords.append(np.concatenate([points[i], points[j]])[None])
                    continue
            keep[m] = True
            todo += [(i, m), (m, j)]
        out.append(points[keep])
    return out


def simplify(tolerance: float) -> Callable[[Column], Column]:
    """Rings thinned to ``tolerance`` without crossings, each with at least four points."""

    @F.pandas_udf(RINGS)
    def thinned(rings: pd.Series) -> pd.Series:
        return rings.map(
            lambda r: None if r is None else [as_ring(x) for x in thin_rings([ring_points(y) for y in r], tolerance)]
        )

    return thinned
