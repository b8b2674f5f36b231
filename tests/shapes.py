"""Plain numpy geometry to check the column expressions against."""

from __future__ import annotations

import math

import numpy as np

RINGS = "rings array<array<struct<x:double,y:double>>>"


def ring(points) -> list[dict]:
    pts = [tuple(map(float, p)) for p in points]
    if pts[0] != pts[-1]:
        pts.append(pts[0])
    return [{"x": x, "y": y} for x, y in pts]


def box(x0, y0, x1, y1) -> list:
    return [ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]


def random_polygon(rng, cx, cy, size) -> list:
    """A star-shaped polygon, often not convex."""
    n = int(rng.integers(3, 9))
    angles = np.sort(rng.uniform(0, 2 * math.pi, n)) + np.arange(n) * 1e-3
    radii = rng.uniform(0.4, 1.0, n) * size
    pts = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(angles, radii)]
    return [ring(pts if rng.random() < 0.5 else pts[::-1])]


def segments(rings):
    out = []
    for r in rings:
        for p, q in zip(r, r[1:]):
            out.append((p["x"], p["y"], q["x"], q["y"]))
    return out


def contains(rings, x, y) -> bool:
    hit = False
    for x1, y1, x2, y2 in segments(rings):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def point_segment(x, y, s) -> float:
    x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0 if n == 0 else min(1, max(0, ((x - x1) * dx + (y - y1) * dy) / n))
    return math.hypot(x - x1 - t * dx, y - y1 - t * dy)


def point_distance(rings, x, y) -> float:
    if contains(rings, x, y):
        return 0.0
    return min(point_segment(x, y, s) for s in segments(rings))


def distance(a, b) -> float:
    sa, sb = segments(a), segments(b)
    if contains(a, sb[0][0], sb[0][1]) or contains(b, sa[0][0], sa[0][1]):
        return 0.0

    def side(px, py, s):
        return (s[2] - s[0]) * (py - s[1]) - (s[3] - s[1]) * (px - s[0])

    best = math.inf
    for s in sa:
        for t in sb:
            if side(s[0], s[1], t) * side(s[2], s[3], t) < 0 and side(t[0], t[1], s) * side(t[2], t[3], s) < 0:
                return 0.0
            best = min(
                best,
                point_segment(s[0], s[1], t),
                point_segment(s[2], s[3], t),
                point_segment(t[0], t[1], s),
                point_segment(t[2], t[3], s),
            )
    return best


def area(rings) -> float:
    total = 0.0
    for i, r in enumerate(rings):
        a = sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in segments([r])) / 2
        total += abs(a) if i == 0 else -abs(a)
    return total


def centroid(rings):
    a = mx = my = 0.0
    for i, r in enumerate(rings):
        segs = segments([r])
        ra = sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in segs)
        k = 1 if (ra > 0) == (i == 0) else -1
        a += k * ra
        mx += k * sum((x1 + x2) * (x1 * y2 - x2 * y1) for x1, y1, x2, y2 in segs)
        my += k * sum((y1 + y2) * (x1 * y2 - x2 * y1) for x1, y1, x2, y2 in segs)
    return mx / (3 * a), my / (3 * a)
