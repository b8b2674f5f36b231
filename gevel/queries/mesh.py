"""City model tiles and solid metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gevel.functions import solids
from gevel.plans import mesh
from gevel.queries.registry import query
from gevel.queries.solidstand import box_solids, write_tiles
from gevel.session import scratch_dir
from gevel.sources import cityjson, metrics_csv, tables


def objects(spark, d, lod: str | None = None):
    tiles = cityjson.read_tiles(spark, write_tiles(spark, d))
    return cityjson.tile_objects(tiles, None if lod is None else [lod])


@query(
    "io4_tile_scan",
    """select bag_id || '-0' as object_id, 'BuildingPart' as type, lod, cast(6 as bigint) as faces
       from boxes, (values ('1.2'), ('2.2')) t(lod)""",
)
def _(spark, d):
    return objects(spark, d).select(
        "object_id", "type", "lod", F.size("faces").cast("bigint").alias("faces")
    )


@query(
    "io4_dereferenced_points",
    """select bag_id || '-0' as id, minx, maxx, miny, maxy, round((p_size % 3) / 2.0 + height + (p_size % 4) / 2.0, 6) as top
       from boxes""",
)
def _(spark, d):
    points = solids.points_of(F.col("faces"))
    t = objects(spark, d, "2.2").select(F.col("object_id").alias("id"), points.alias("p"))
    axis = lambda a: F.transform("p", lambda p: p[a])
    return t.select(
        "id",
        *[
            F.round(fn(axis(a)), 6).alias(f"{name}{a}")
            for a in "xy"
            for name, fn in (("min", F.array_min), ("max", F.array_max))
        ],
        F.round(F.array_max(axis("z")), 6).alias("top"),
    )


@query(
    "u1_merge_tiles",
    "select bag_id || '-0' as object_id, count(*) as solids from boxes, (values ('1.2'), ('2.2')) t(lod) group by 1",
)
def _(spark, d):
    # The same tiles twice, as where two tiles overlap.
    path = write_tiles(spark, d)
    twice = cityjson.read_tiles(spark, path).unionByName(cityjson.read_tiles(spark, path))
    merged = cityjson.merge_tiles(cityjson.tile_objects(twice))
    return merged.groupBy("object_id").agg(F.count(F.lit(1)).alias("solids"))


def differing(spark, d):
    """Tiles and the same tiles a metre higher, under paths that sort behind, read first."""
    tiles = cityjson.read_tiles(spark, write_tiles(spark, d))
    moved = F.transform("transform.translate", lambda v, i: v + F.when(i == 2, 1.0).otherwise(0.0))
    higher = tiles.withColumn("transform", F.struct("transform.scale", moved.alias("translate")))
    higher = higher.withColumn("tile", F.concat(F.lit("~"), "tile"))
    return cityjson.tile_objects(higher.unionByName(tiles))


@query(
    "u1_differing_tiles",
    """select bag_id || '-0' as object_id, lod, cast(6 as bigint) as faces,
              round((p_size % 3) / 2.0 + height + if(lod = '2.2', (p_size % 4) / 2.0, 0), 6) as top
       from boxes, (values ('1.2'), ('2.2')) t(lod)""",
)
def _(spark, d):
    merged = cityjson.merge_tiles(differing(spark, d))
    z = F.transform(solids.points_of(F.col("faces")), lambda p: p["z"])
    return merged.select(
        "object_id", "lod", F.size("faces").cast("bigint").alias("faces"), F.round(F.array_max(z), 6).alias("top")
    )


@query(
    "u1_tile_conflicts",
    """select bag_id || '-0' as object_id, cast(2 as bigint) as tiles, cast(2 as bigint) as versions,
              true as kept_first from boxes""",
)
def _(spark, d):
    found = cityjson.tile_conflicts(differing(spark, d))
    return found.select("object_id", "tiles", "versions", (~F.col("kept_tile").startswith("~")).alias("kept_first"))


@query("d1_lod_filter", "select bag_id || '-0' as object_id, '1.2' as lod from boxes")
def _(spark, d):
    return objects(spark, d, "1.2").select("object_id", "lod")


# The shed of the stand-in: height z along the lower side, z + r along the upper.
SHED = """(select bag_id || '-0' as id, maxx - minx as w, maxy - miny as h, height as z,
                 (p_size % 4) / 2.0 as r, (p_size % 3) / 2.0 as g from boxes)"""


def doubled(spark, d):
    """Every solid once more as a set of surfaces of the same level of detail, listed first."""
    own = objects(spark, d, "2.2")
    again = own.withColumns({"geometry_type": F.lit("MultiSurface"), "geometry_no": F.lit(-1)})
    return again.unionByName(own)


@query(
    "d2_solid_before_surfaces",
    f"""select id, round(w * h * (z + r / 2), 6) as actual_volume, round(w * h, 6) as ground_area,
               round(2 * (w + h), 6) as footprint_perimeter, round(w * sqrt(h * h + r * r), 6) as roof_area,
               round(w * z + w * (z + r) + h * (2 * z + r), 6) as wall_area, cast(0 as bigint) as hole_count from {SHED}""",
)
def _(spark, d):
    one = cityjson.one_per_object(doubled(spark, d)).select(F.col("object_id").alias("id"), "faces")
    t = mesh.solid_metrics(one)
    sizes = ["actual_volume", "ground_area", "footprint_perimeter", "roof_area", "wall_area"]
    return t.select("id", *[F.round(c, 6).alias(c) for c in sizes], F.col("hole_count").cast("bigint").alias("hole_count"))


@query(
    "d2_set_aside",
    "select bag_id || '-0' as object_id, '2.2' as lod, 'MultiSurface' as geometry_type, -1 as geometry_no from boxes",
)
def _(spark, d):
    return cityjson.set_aside(doubled(spark, d))


@query("d2_actual_volume", f"select id, round(w * h * (z + r / 2), 6) as actual_volume from {SHED}")
def _(spark, d):
    t = box_solids(spark, d, sloped=True)
    return t.select("id", F.round(solids.volume(F.col("faces")), 6).alias("actual_volume"))


@query("d3_convex_hull_volume", f"select id, round(w * h * (z + r / 2), 5) as convex_hull_volume from {SHED}")
def _(spark, d):
    t = box_solids(spark, d, sloped=True)
    return t.select(
        "id",
        F.round(solids.hull_volume(solids.points_of(F.col("faces"))), 5).alias("convex_hull_volume"),
    )


def measured(spark, d):
    return mesh.solid_metrics(box_solids(spark, d, sloped=True))


@query(
    "d4_ground_metrics",
    f"""select id, round(2 * (w + h), 6) as footprint_perimeter, round(w * h, 6) as ground_area,
               cast(4 as bigint) as ground_point_count from {SHED}""",
)
def _(spark, d):
    return measured(spark, d).select(
        "id",
        F.round("footprint_perimeter", 6).alias("footprint_perimeter"),
        F.round("ground_area", 6).alias("ground_area"),
        F.col("ground_point_count").cast("bigint").alias("ground_point_count"),
    )


@query(
    "d5_wall_roof_area",
    f"""select id, round(w * z + w * (z + r) + 2 * h * (z + r / 2), 6) as wall_area,
               round(w * sqrt(h * h + r * r), 6) as roof_area from {SHED}""",
)
def _(spark, d):
    return measured(spark, d).select(
        "id", F.round("wall_area", 6).alias("wall_area"), F.round("roof_area", 6).alias("roof_area")
    )


@query("d6_oriented_box", f"select id, round(least(w, h), 6) as obb_width, round(greatest(w, h), 6) as obb_length from {SHED}")
def _(spark, d):
    return measured(spark, d).select(
        "id", F.round("obb_width", 6).alias("obb_width"), F.round("obb_length", 6).alias("obb_length")
    )


@query("d7_heights", f'select id, g + z + r as "max_Z", g + z as "min_Z", cast(g as double) as "ground_Z" from {SHED}')
def _(spark, d):
    return measured(spark, d).select("id", "max_Z", "min_Z", "ground_Z")


@query(
    "d8_hole_count",
    """select bag_id || '-0' as id, cast(case when p_size % 5 = 0 then 1 else 0 end as bigint) as hole_count from boxes""",
)
def _(spark, d):
    # Every fifth size loses its roof.
    t = box_solids(spark, d)
    open_top = F.filter("faces", lambda f: f["surface"] != solids.ROOF)
    faces = F.when(F.col("p_size") % 5 == 0, open_top).otherwise(F.col("faces"))
    t = t.select("id", solids.open_edges(faces).alias("open"))
    return t.select("id", solids.hole_count("open").cast("bigint").alias("hole_count"))


@query(
    "d9_shared_walls_area",
    """select a_id || '-0' as id, round(sum(len * greatest(least(za1, zb1) - greatest(za0, zb0), 0)), 6) as shared_walls_area
       from (select a.bag_id as a_id, greatest(least(a.maxy, b.maxy) - greatest(a.miny, b.miny), 0) as len,
                    a.z0 as za0, a.z0 + a.height as za1, b.z0 as zb0, b.z0 + b.height as zb1
             from solid a join solid b on a.bag_id <> b.bag_id
              and (abs(a.maxx - b.minx) <= 0.1 or abs(a.minx - b.maxx) <= 0.1)
              and a.miny - 0.1 <= b.maxy and b.miny <= a.maxy + 0.1
             union all
             select a.bag_id, greatest(least(a.maxx, b.maxx) - greatest(a.minx, b.minx), 0),
                    a.z0, a.z0 + a.height, b.z0, b.z0 + b.height
             from solid a join solid b on a.bag_id <> b.bag_id
              and (abs(a.maxy - b.miny) <= 0.1 or abs(a.miny - b.maxy) <= 0.1)
              and a.minx - 0.1 <= b.maxx and b.minx <= a.maxx + 0.1)
       group by 1""",
)
def _(spark, d):
    shared = mesh.shared_walls(box_solids(spark, d))
    return shared.select("id", F.round("shared_walls_area", 6).alias("shared_walls_area"))


@query(
    "mesh_metrics_to_csv",
    """select bag_id || '-0' as id, round((maxx - minx) * (maxy - miny) * height, 3) as actual_volume,
              cast(4 as bigint) as ground_point_count, cast(0 as bigint) as hole_count from boxes""",
)
def _(spark, d):
    # The whole stage: tiles, one level of detail, metrics, CSV and back.
    solids_read = objects(spark, d, "1.2").select(F.col("object_id").alias("id"), "faces")
    path = scratch_dir(spark, "merged")
    tables.write_csv(mesh.mesh_metrics(solids_read), path)
    t = metrics_csv.read_metrics(spark, path)
    return t.select(
        "id",
        F.round("actual_volume", 3).alias("actual_volume"),
        F.col("ground_point_count").cast("bigint").alias("ground_point_count"),
        F.col("hole_count").cast("bigint").alias("hole_count"),
    )
