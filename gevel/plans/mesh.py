"""Metrics of building solids per level of detail."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gevel.functions import hull, solids
from gevel.operators import grid
from gevel.plans.extraction import _per_shape
from gevel.session import materialize
from gevel.sources.metrics_csv import METRICS


def solid_metrics(objects: DataFrame) -> DataFrame:
    """Measures that need one solid only: ``objects(id, faces)``."""
    faces = F.col("faces")
    ground = solids.points_of(faces, solids.GROUND)
    roof = solids.points_of(faces, solids.ROOF)
    flat = solids.flat_rings(faces, solids.GROUND)
    prepared = objects.select(
        "id",
        "faces",
        solids.points_of(faces).alias("points"),
        flat.alias("ground_rings"),
        F.array_distinct(ground).alias("ground_points"),
        roof.alias("roof_points"),
        solids.open_edges(faces).alias("open"),
    )
    all_ground = F.array(F.flatten("ground_rings"))
    measured = prepared.select(
        "id",
        solids.volume(faces).alias("actual_volume"),
        solids.hull_volume("points").alias("convex_hull_volume"),
        solids.outline_length(faces, solids.GROUND).alias("footprint_perimeter"),
        F.when(F.size("ground_rings") > 0, hull.oriented_box(all_ground)).alias("box"),
        solids.area_of(faces, solids.GROUND).alias("ground_area"),
        solids.area_of(faces, solids.WALL).alias("wall_area"),
        solids.area_of(faces, solids.ROOF).alias("roof_area"),
        F.size("ground_points").alias("ground_point_count"),
        solids.highest(F.col("roof_points")).alias("max_Z"),
        solids.lowest(F.col("roof_points")).alias("min_Z"),
        solids.lowest(F.col("ground_points")).alias("ground_Z"),
        solids.hole_count("open").alias("hole_count"),
    )
    short, long = hull.box_sides(F.col("box"))
    return measured.select("*", short.alias("obb_width"), long.alias("obb_length")).drop("box")


def _clip(subject: list, clip: list) -> list:
    """Part of a polygon inside a counter-clockwise triangle."""
    out = subject
    for k, (bx, by) in enumerate(clip):
        if not out:
            break
        ax, ay = clip[k - 1]
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        kept = []
        for p, q, s, t in zip(out, out[1:] + out[:1], side, side[1:] + side[:1]):
            if s >= 0:
                kept.append(p)
            if (s > 0 > t) or (s < 0 < t):
                f = s / (s - t)
                kept.append((p[0] + (q[0] - p[0]) * f, p[1] + (q[1] - p[1]) * f))
        out = kept
    return out


def _area(p: list) -> float:
    return sum(x * v - y * u for (x, y), (u, v) in zip(p, p[1:] + p[:1])) / 2


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Common area of two simple polygons, over signed fans of triangles; plain numbers, as walls have few corners."""
    if ((a.max(axis=0) <= b.min(axis=0)) | (b.max(axis=0) <= a.min(axis=0))).any():
        return 0.0

    def fan(p):
        for i in range(1, len(p) - 1):
            t = [p[0], p[i], p[i + 1]]
            s = _area(t)
            if s:
                yield (1 if s > 0 else -1), (t if s > 0 else t[::-1])

    total = 0.0
    others = list(fan(b.tolist()))
    for s, t in fan(a.tolist()):
        for r, u in others:
            common = _clip(t, u)
            if len(common) > 2:
                total += s * r * _area(common)
    return abs(total)


@F.pandas_udf(T.DoubleType())
def wall_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(p, q) -> float:
        p, q = (np.array([[v["u"], v["z"]] for v in w[:-1]], dtype=float) for w in (p, q))
        origin = p.min(axis=0)
        return overlap_area(p - origin, q - origin)

    return pd.Series([one(p, q) for p, q in zip(a, b)])


def walls(objects: DataFrame) -> DataFrame:
    """Vertical faces with their line seen from above and their outline in that plane."""
    face = objects.select("id", F.posexplode("faces").alias("face_no", "f")).filter(
        F.col("f.surface") == solids.WALL
    )
    ring = F.col("f.rings")[0]
    n = face.select("id", "face_no", ring.alias("ring"), solids.ring_vector(ring).alias("n"))
    n = n.withColumn("flat", F.hypot("n.x", "n.y")).filter(
        (F.col("flat") > 1e-9) & (F.abs("n.z") <= 1e-6 * F.col("flat"))
    )
    nx, ny = F.col("n.x") / F.col("flat"), F.col("n.y") / F.col("flat")
    xs = F.transform("ring", lambda p: p["x"])
    ys = F.transform("ring", lambda p: p["y"])
    return n.select(
        "id",
        "face_no",
        nx.alias("nx"),
        ny.alias("ny"),
        "ring",
        F.array_min(xs).alias("minx"),
        F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"),
        F.array_max(ys).alias("maxy"),
    )


def shared_walls(objects: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """``(id, shared_walls_area)``: wall area covered by facing walls of other objects.

    Equal walls are joined once, with their number of copies as a weight; what
    an object's own walls contribute that way is taken off again.
    """
    rows = materialize(walls(objects), "walls")
    place = ["nx", "ny", *grid.BOX]
    shapes = rows.groupBy("ring").agg(
        F.min(F.struct("id", "face_no")).alias("wall"),
        F.count(F.lit(1)).alias("copies"),
        *[F.first(c).alias(c) for c in place],
    )
    shapes = materialize(shapes, "wall_shapes")
    pairs = grid.box_pairs(shapes, shapes, tolerance, cell=25.0)
    # Facing each other, in one plane up to the tolerance.
    facing = F.col("a_nx") * F.col("b_nx") + F.col("a_ny") * F.col("b_ny") <= -1.0 + 1e-6
    pa, pb = F.col("a_ring")[0], F.col("b_ring")[0]
    offset = (pb["x"] - pa["x"]) * F.col("a_nx") + (pb["y"] - pa["y"]) * F.col("a_ny")
    pairs = pairs.filter(facing & (F.abs(offset) <= tolerance))

    def in_plane(ring: str):
        # Both outlines in coordinates along the first wall.
        return F.transform(
            ring,
            lambda p: F.struct(
                (
                    (p["y"] - F.col("a_miny")) * F.col("a_nx")
                    - (p["x"] - F.col("a_minx")) * F.col("a_ny")
                ).alias("u"),
                p["z"].alias("z"),
            ),
        )

    area = wall_overlap(in_plane("a_ring"), in_plane("b_ring"))
    pairs = materialize(pairs.select("a_wall", "b_wall", "b_copies", area.alias("area")), "facing")
    held = rows.join(shapes.select("ring", "wall"), "ring").select("id", "wall")
    seen = pairs.groupBy(F.col("a_wall").alias("wall")).agg(
        F.sum(F.col("area") * F.col("b_copies")).alias("area")
    )
    own = (
        pairs.join(held.withColumnRenamed("wall", "a_wall"), "a_wall")
        .join(held.withColumnRenamed("wall", "b_wall"), ["id", "b_wall"])
        .select("id", (-F.col("area")).alias("area"))
    )
    parts = held.join(seen, "wall").select("id", "area").unionByName(own)
    return parts.groupBy("id").agg(F.sum("area").alias("shared_walls_area"))


def closest(footprints: DataFrame) -> DataFrame:
    """Add ``closest_distance``: to the nearest other footprint."""
    shapes = materialize(grid.distinct_shapes(footprints), "shapes")
    return _per_shape(footprints, shapes, grid.nearest_distance(shapes)).drop("copies")


def mesh_metrics(objects: DataFrame) -> DataFrame:
    """All metrics of the solids of one level of detail, ready for the CSV sink."""
    objects = materialize(objects.select("id", "faces"), "solids")
    base = solid_metrics(objects)
    outlines = objects.select(
        F.col("id").alias("bag_id"),
        solids.all_flat_rings(F.col("faces"), solids.GROUND).alias("rings"),
    ).filter("size(rings) > 0")
    near = closest(outlines).select(F.col("bag_id").alias("id"), "closest_distance")
    out = base.join(shared_walls(objects), "id", "left").join(near, "id", "left")
    return out.withColumn(
        "shared_walls_area", F.coalesce("shared_walls_area", F.lit(0.0))
    ).select(*METRICS)
