"""Geometry measures and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gevel.functions import hull, labels, planar, solids
from gevel.operators import grid
from gevel.operators.lookup import shuffled
from gevel.plans import extraction, validation
from gevel.queries import standins as S
from gevel.queries.registry import query
from gevel.queries.solidstand import box_solids
from gevel.session import scratch_dir
from gevel.sources import tables, wkb


def with_function(spark, d):
    return extraction.building_function(S.buildings(spark, d), S.units(spark, d))


@query("io3_footprint_scan", "select bag_id, (maxx - minx) * (maxy - miny) as fp_area from boxes")
def _(spark, d):
    path = scratch_dir(spark, "wkb")
    stored = S.buildings(spark, d).select(
        "bag_id", wkb.encode_footprint(F.col("rings")).alias("wkb_geometry")
    )
    tables.write_table(stored, path)
    read = wkb.decode_footprints(tables.read_table(spark, path, stored.schema))
    return read.select("bag_id", planar.area("rings").alias("fp_area"))


@query("g1_area", "select bag_id, round((maxx - minx) * (maxy - miny), 6) as fp_area from boxes")
def _(spark, d):
    return S.buildings(spark, d).select("bag_id", F.round(planar.area("rings"), 6).alias("fp_area"))


@query("g2_perimeter", "select bag_id, round(2 * (maxx - minx + maxy - miny), 6) as fp_perimeter from boxes")
def _(spark, d):
    return S.buildings(spark, d).select(
        "bag_id", F.round(planar.perimeter("rings"), 6).alias("fp_perimeter")
    )


@query("g3_point_count", "select bag_id, cast(5 as bigint) as fp_no_vertices from boxes")
def _(spark, d):
    return S.buildings(spark, d).select(
        "bag_id", planar.point_count("rings").cast("bigint").alias("fp_no_vertices")
    )


@query("g4_simplified_count", "select bag_id, cast(5 as bigint) as fp_no_vertices_simple from boxes")
def _(spark, d):
    # A point near the middle of the lower side, off the line by less than the tolerance.
    ring = F.col("rings")[0]
    extra = F.struct(
        ((ring[0]["x"] + ring[1]["x"]) / 2).alias("x"), (ring[0]["y"] - 0.05).alias("y")
    )
    dented = F.array(F.concat(F.slice(ring, 1, 1), F.array(extra), F.slice(ring, 2, 4)))
    thinned = S.buildings(spark, d).select(
        "bag_id", hull.simplify(0.1)(dented).alias("rings")
    )
    return thinned.select(
        "bag_id", planar.point_count("rings").cast("bigint").alias("fp_no_vertices_simple")
    )


@query("g5_centroid", "select bag_id, round((minx + maxx) / 2, 6) as x, round((miny + maxy) / 2, 6) as y from boxes")
def _(spark, d):
    c = planar.centroid("rings").alias("c")
    return S.buildings(spark, d).select("bag_id", c).select(
        "bag_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y")
    )


@query(
    "g8_point_distance",
    """select bag_id, round(sqrt(pow(greatest(minx - 300.0, 0, 300.0 - maxx), 2)
                     + pow(greatest(miny - 150.0, 0, 150.0 - maxy), 2)), 6) as d from boxes""",
)
def _(spark, d):
    gap = planar.point_distance("300D", "150D", planar.edges_sql("rings"))
    return S.buildings(spark, d).select("bag_id", F.round(gap, 6).alias("d"))


@query(
    "g9_oriented_box",
    """select bag_id, round((maxx - minx) * (maxy - miny), 6) as area,
              round(least(maxx - minx, maxy - miny), 6) as short, round(greatest(maxx - minx, maxy - miny), 6) as long
       from boxes""",
)
def _(spark, d):
    boxed = S.buildings(spark, d).select("bag_id", hull.oriented_box(F.col("rings")).alias("box"))
    short, long = hull.box_sides(F.col("box"))
    return boxed.select(
        "bag_id",
        F.round(planar.area("box"), 6).alias("area"),
        F.round(short, 6).alias("short"),
        F.round(long, 6).alias("long"),
    )


@query(
    "g10_box_extent",
    """select bag_id, round(greatest(maxx - minx, maxy - miny), 6) as fp_length,
              round(least(maxx - minx, maxy - miny), 6) as fp_width from boxes""",
)
def _(spark, d):
    t = extraction.length_width(S.buildings(spark, d))
    return t.select(
        "bag_id", F.round("fp_length", 6).alias("fp_length"), F.round("fp_width", 6).alias("fp_width")
    )


@query(
    "g11_surface_area",
    """select bag_id || '-0' as id, round(2 * (maxx - minx + maxy - miny) * height, 6) as wall_area from boxes""",
)
def _(spark, d):
    t = box_solids(spark, d)
    return t.select("id", F.round(solids.area_of(F.col("faces"), solids.WALL), 6).alias("wall_area"))


@query(
    "g12_solid_volume",
    "select bag_id || '-0' as id, round((maxx - minx) * (maxy - miny) * height, 6) as volume from boxes",
)
def _(spark, d):
    return box_solids(spark, d).select(
        "id", F.round(solids.volume(F.col("faces")), 6).alias("volume")
    )


@query(
    "j9_intersects_join",
    """select a_id, b_id from near
       join functions fa on fa.bag_id = a_id join functions fb on fb.bag_id = b_id
       where dx <= 0.1 and dy <= 0.1 and fa.bag_function not in ('Others', 'Unknown')
         and fb.bag_function not in ('Others', 'Unknown')""",
)
def _(spark, d):
    t = with_function(spark, d)
    shapes = grid.distinct_shapes(t.filter(labels.counts_for_adjacency(F.col("bag_function"))))
    return grid.touching_shapes(shapes, [0.1]).filter("touch_0").select("a_id", "b_id")


@query("j10_intersects_join_all", "select a_id, b_id from near where dx <= 0.1 and dy <= 0.1")
def _(spark, d):
    shapes = grid.distinct_shapes(S.buildings(spark, d))
    return grid.touching_shapes(shapes, [0.1]).filter("touch_0").select("a_id", "b_id")


@query("j11_within_distance_join", "select bag_id, n25 as within_25, n100 as within_100 from neighbours")
def _(spark, d):
    shapes = grid.distinct_shapes(S.buildings(spark, d))
    within = grid.shapes_within(shapes, [25.0, 100.0])
    # Every rectangle holds its own centroid.
    return within.select(
        F.col("shape_id").alias("bag_id"),
        (F.col("within_0") - 1).alias("within_25"),
        (F.col("within_1") - 1).alias("within_100"),
    )


@query(
    "p19_around_one_building",
    """select b_id as bag_id from near
       join functions fa on fa.bag_id = a_id join functions fb on fb.bag_id = b_id
       where dx <= 0.1 and dy <= 0.1 and fa.bag_function not in ('Others', 'Unknown')
         and fb.bag_function not in ('Others', 'Unknown') and a_id = 'NL.IMBAG.Pand.0000000000000007'""",
)
def _(spark, d):
    return validation.adjacent_ids(with_function(spark, d), "NL.IMBAG.Pand.0000000000000007")


@query(
    "p19_within_of_one_building",
    """select b.bag_id from boxes a join boxes b on a.bag_id <> b.bag_id
       where a.bag_id = 'NL.IMBAG.Pand.0000000000000060'
         and pow(greatest(b.minx - (a.minx + a.maxx) / 2, 0, (a.minx + a.maxx) / 2 - b.maxx), 2)
           + pow(greatest(b.miny - (a.miny + a.maxy) / 2, 0, (a.miny + a.maxy) / 2 - b.maxy), 2) <= 625""",
)
def _(spark, d):
    return validation.ids_within(S.buildings(spark, d), "NL.IMBAG.Pand.0000000000000060", 25.0)


@query("x4_adjacency", """select bag_id, bag_function, n as no_adjacent_bldg from adjacency
       where bag_function in ('Residential', 'Mixed-residential')""")
def _(spark, d):
    t = extraction.adjacency(with_function(spark, d), [0.1])
    return extraction.residential_only(t).select("bag_id", "bag_function", "no_adjacent_bldg")


@query(
    "x5_second_order_adjacency",
    "select bag_id, n as no_adjacent_bldg, nn as no_adjacent_of_adja_bldg from adjacency2",
)
def _(spark, d):
    t = extraction.adjacency(with_function(spark, d), [0.1])
    return t.select("bag_id", "no_adjacent_bldg", "no_adjacent_of_adja_bldg")


@query(
    "a3_max_over_neighbours",
    """select a_id, max(k) as most from near join (select bag_id, p_size as k from boxes) on bag_id = b_id
       where dx <= 0.1 and dy <= 0.1 group by a_id""",
)
def _(spark, d):
    shapes = grid.distinct_shapes(S.buildings(spark, d))
    pairs = grid.touching_shapes(shapes, [0.1]).filter("touch_0")
    sizes = S.boxes(spark, d).select(F.col("bag_id").alias("b_id"), "p_size")
    return pairs.join(shuffled(sizes), "b_id").groupBy("a_id").agg(F.max("p_size").alias("most"))


@query(
    "x6_neighbours",
    """select bag_id, n25 as no_neighbours_25m, n50 as no_neighbours_50m, n75 as no_neighbours_75m,
              n100 as no_neighbours_100m from neighbours""",
)
def _(spark, d):
    return extraction.neighbours(S.buildings(spark, d)).drop("rings")


@query(
    "x17_buffer_sensitivity",
    """select a.bag_id, a.n as no_adjacent_bldg, a.nn as no_adjacent_of_adja_bldg,
              a.n as no_adjacent_bldg030, case when t.a_id is not null then a.nn end as no_adjacent_of_adja_bldg030
       from adjacency2 a left join (select distinct a_id from near where dx <= 0.3 and dy <= 0.3) t
       on t.a_id = a.bag_id""",
)
def _(spark, d):
    # Distances on the lattice are whole metres: both buffers meet the same buildings.
    t = S.buildings(spark, d).select("bag_id")
    registry = S.buildings(spark, d).select(
        F.col("bag_id").alias("identificatie"), F.lit(None).cast("timestamp_ntz").alias("eindgeldigheid"), "rings"
    )
    checked = validation.adjacency_check(t, S.units(spark, d), registry, compat=True)
    return checked.drop("rings", "bag_function")


@query(
    "d10_closest_distance",
    """select a.bag_id, round(min(sqrt(pow(greatest(a.minx - b.maxx, b.minx - a.maxx, 0), 2)
                             + pow(greatest(a.miny - b.maxy, b.miny - a.maxy, 0), 2))), 6) as closest_distance
       from boxes a join boxes b on a.bag_id <> b.bag_id group by 1""",
)
def _(spark, d):
    from gevel.plans.mesh import closest

    near = closest(S.buildings(spark, d))
    return near.select("bag_id", F.round("closest_distance", 6).alias("closest_distance"))
