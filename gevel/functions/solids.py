"""Measures of 3D surfaces and solids as column expressions.

A solid is ``faces: array<struct<surface:string, rings:array<array<struct<x,y,z>>>>>``:
per face its kind and its closed rings, the outline first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Surface kinds of a building.
GROUND = "GroundSurface"
WALL = "WallSurface"
ROOF = "RoofSurface"
FACES_TYPE = "array<struct<surface:string,rings:array<array<struct<x:double,y:double,z:double>>>>>"


def _zero() -> Column:
    return F.struct(*[F.lit(0.0).alias(a) for a in "xyz"])


def _plus(a: Column, b: Column, sign: Column | float = 1.0) -> Column:
    return F.struct(*[(a[k] + sign * b[k]).alias(k) for k in "xyz"])


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def _minus(a: Column, b: Column) -> Column:
    return _plus(a, b, -1.0)


def ring_vector(ring: Column) -> Column:
    """Normal of a closed ring, twice as long as its area (Newell)."""
    count = F.greatest(F.size(ring) - 1, F.lit(0))
    origin = ring[0]
    crosses = F.zip_with(
        F.transform(F.slice(ring, F.lit(1), count), lambda p: _minus(p, origin)),
        F.transform(F.slice(ring, F.lit(2), count), lambda p: _minus(p, origin)),
        lambda p, q: F.struct(
            (p["y"] * q["z"] - p["z"] * q["y"]).alias("x"),
            (p["z"] * q["x"] - p["x"] * q["z"]).alias("y"),
            (p["x"] * q["y"] - p["y"] * q["x"]).alias("z"),
        ),
    )
    return F.aggregate(crosses, _zero(), lambda acc, v: _plus(acc, v))


def _face_vector(rings: Column) -> Column:
    """Outline normal less the holes, whichever way those turn."""
    # The one-element transform evaluates the vectors once.
    return F.transform(
        F.array(F.transform(rings, ring_vector)),
        lambda v: F.aggregate(
            F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))),
            v[0],
            lambda acc, hole: _plus(acc, hole, F.when(_dot(v[0], hole) > 0, -1.0).otherwise(1.0)),
        ),
    )[0]


def surface_area(rings: Column) -> Column:
    """Area of a planar face in space, holes taken off."""
    # The one-element transform evaluates the vector once, not for each factor.
    return F.transform(F.array(_face_vector(rings)), _norm)[0] / 2.0


def volume(faces: Column) -> Column:
    """Volume of a closed solid, from signed cones over its faces."""
    origin = faces[0]["rings"][0][0]
    cones = F.transform(
        faces,
        lambda f: F.transform(
            F.array(_face_vector(f["rings"])), lambda v: _dot(_minus(f["rings"][0][0], origin), v)
        )[0],
    )
    return F.abs(F.aggregate(cones, F.lit(0.0), lambda acc, c: acc + c)) / 6.0


def _of_kind(faces: Column, kind: str) -> Column:
    return F.filter(faces, lambda f: f["surface"] == kind)


def area_of(faces: Column, kind: str) -> Column:
    return F.aggregate(
        _of_kind(faces, kind), F.lit(0.0), lambda acc, f: acc + surface_area(f["rings"])
    )


def points_of(faces: Column, kind: str | None = None) -> Column:
    kept = faces if kind is None else _of_kind(faces, kind)
    return F.flatten(F.flatten(F.transform(kept, lambda f: f["rings"])))


def flat_rings(faces: Column, kind: str) -> Column:
    """Outlines of the faces of one kind seen from above."""
    return F.transform(
        _of_kind(faces, kind),
        lambda f: F.transform(
            f["rings"][0], lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
        ),
    )


def all_flat_rings(faces: Column, kind: str) -> Column:
    """All rings of the faces of one kind seen from above, holes included."""
    return F.flatten(
        F.transform(
            _of_kind(faces, kind),
            lambda f: F.transform(
                f["rings"],
                lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))),
            ),
        )
    )


def outline_length(faces: Column, kind: str) -> Column:
    """Length, seen from above, of the edges that only one face of a kind has.

    An edge between two faces is not part of their common outline; the two run along
    it in opposite directions, so edges are compared with sorted ends.
    """

    def sides(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        pairs = F.arrays_zip(
            F.slice(ring, F.lit(1), n).alias("p"), F.slice(ring, F.lit(2), n).alias("q")
        )
        return F.transform(
            pairs,
            lambda e: F.struct(F.least(e["p"], e["q"]).alias("p"), F.greatest(e["p"], e["q"]).alias("q")),
        )

    edges = F.sort_array(F.flatten(F.transform(all_flat_rings(faces, kind), sides)))
    # The one-element transform sorts once.
    single = F.transform(
        F.array(edges),
        lambda all_: F.filter(
            all_,
            lambda e, i: ~e.eqNullSafe(F.get(all_, i - 1)) & ~e.eqNullSafe(F.get(all_, i + 1)),
        ),
    )[0]
    return F.aggregate(
        single,
        F.lit(0.0),
        lambda acc, e: acc + F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]),
    )


def highest(points: Column) -> Column:
    return F.array_max(F.transform(points, lambda p: p["z"]))


def lowest(points: Column) -> Column:
    return F.array_min(F.transform(points, lambda p: p["z"]))


def _hull_of(points: list[tuple[float, float, float]]) -> float:
    """Volume of the convex hull by adding points to a tetrahedron; plain numbers, as solids have few points."""
    found = sorted(set(points))
    n = len(found)
    if n < 4:
        return 0.0
    mx, my, mz = (sum(axis) / n for axis in zip(*found))
    if not all(map(math.isfinite, (mx, my, mz))):
        return math.nan
    pts = [(x - mx, y - my, z - mz) for x, y, z in found]
    scale = max(max(map(abs, p)) for p in pts) or 1.0
    eps = 1e-10 * scale

    def cross(p, q, r):
        ux, uy, uz = q[0] - p[0], q[1] - p[1], q[2] - p[2]
        vx, vy, vz = r[0] - p[0], r[1] - p[1], r[2] - p[2]
        return uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx

    def above(normal, p, q):
        return normal[0] * (q[0] - p[0]) + normal[1] * (q[1] - p[1]) + normal[2] * (q[2] - p[2])

    a = pts[0]
    b = max(pts, key=lambda p: math.dist(p, a))
    c = max(pts, key=lambda p: math.hypot(*cross(a, p, b)))
    normal = cross(a, b, c)
    d = max(pts, key=lambda p: abs(above(normal, a, p)))
    if abs(above(normal, a, d)) <= eps * max(math.hypot(*normal), eps):
        return 0.0
    centre = tuple(sum(axis) / 4 for axis in zip(a, b, c, d))

    def facing(p, q, r):
        n = cross(p, q, r)
        return p, q, r, n, eps * max(math.hypot(*n), eps)

    def outward(p, q, r):
        return facing(p, r, q) if above(cross(p, q, r), centre, p) < 0 else facing(p, q, r)

    tris = [outward(*t) for t in ((a, b, c), (a, b, d), (a, c, d), (b, c, d))]
    for p in pts:
        seen = [t for t in tris if above(t[3], t[0], p) > t[4]]
        if not seen:
            continue
        lit = set(map(id, seen))
        sides = {}
        for q, r, s, *_ in seen:
            for side in ((q, r), (r, s), (s, q)):
                if side[::-1] in sides:
                    del sides[side[::-1]]
                else:
                    sides[side] = True
        tris = [t for t in tris if id(t) not in lit] + [facing(q, r, p) for q, r in sides]
    zero = (0.0, 0.0, 0.0)
    return abs(sum(above(cross(zero, t[1], t[2]), zero, t[0]) for t in tris)) / 6.0


def _hull_volume(pts: np.ndarray) -> float:
    return _hull_of([tuple(p) for p in np.round(pts, 9).tolist()])


@F.arrow_udf(T.DoubleType())
def hull_volume(points: pa.Array) -> pa.Array:
    """Volume of the convex hull of the points of a solid; null where a coordinate is missing."""
    axes = [np.round(c.to_numpy(zero_copy_only=False).astype(float), 9).tolist() for c in points.values.flatten()]
    every, ends, known = list(zip(*axes)), points.offsets.to_pylist(), points.is_valid().to_pylist()
    found = [_hull_of(every[i:j]) if k else None for i, j, k in zip(ends, ends[1:], known)]
    return pa.array(found, pa.float64(), from_pandas=True)  # NaN as null


def open_edges(faces: Column) -> Column:
    """Edges that belong to one face only, ``array<struct<p,q>>``, coordinates rounded to micrometres."""

    def sides(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        near = F.transform(ring, lambda p: F.struct(*[F.round(p[a], 6).alias(a) for a in "xyz"]))
        # The one-element transform rounds once.
        pairs = F.transform(
            F.array(near),
            lambda r: F.arrays_zip(F.slice(r, F.lit(1), n).alias("p"), F.slice(r, F.lit(2), n).alias("q")),
        )[0]
        return F.transform(
            F.filter(pairs, lambda e: e["p"] != e["q"]),
            lambda e: F.struct(F.least(e["p"], e["q"]).alias("p"), F.greatest(e["p"], e["q"]).alias("q")),
        )

    rings = F.flatten(F.transform(faces, lambda f: f["rings"]))
    # The one-element transform sorts once.
    return F.transform(
        F.array(F.sort_array(F.flatten(F.transform(rings, sides)))),
        lambda all_: F.filter(
            all_,
            lambda e, i: ~e.eqNullSafe(F.get(all_, i - 1)) & ~e.eqNullSafe(F.get(all_, i + 1)),
        ),
    )[0]


def _loops(edges) -> int:
    """Connected groups of edges."""
    parent: dict = {}

    def root(p):
        while parent.setdefault(p, p) != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    for e in edges:
        p, q = (tuple(e[k][a] for a in "xyz") for k in "pq")
        parent[root(p)] = root(q)
    return len({root(p) for p in parent})


@F.pandas_udf(T.IntegerType())
def _loop_count(edges: pd.Series) -> pd.Series:
    return edges.map(lambda es: 0 if es is None else _loops(es))


def hole_count(edges: str) -> Column:
    """Number of holes in the hull of a solid, from a column of its :func:`open_edges`; 0 when it is closed.

    Only the open edges of solids that have any leave the JVM. They must be a column,
    computed a select before: Spark loses sight of a Python call over such lambdas.
    """
    return F.when(F.col(edges).isNotNull(), _loop_count(F.when(F.size(edges) > 0, F.col(edges))))
