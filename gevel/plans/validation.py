"""Features checked against other sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.functions import hull, planar, scalars, solids
from gevel.operators.lookup import assign_from, one_per_key, shuffled
from gevel.plans import extraction
from gevel.sources.attributes import attribute, attributes_wide, by_object

# Classes of roof and wall surfaces, the text of an empty error list.
ROOF_CLASS, WALL_CLASS = 33, 34
NO_ERRORS = "[]"


def adjacency_check(
    table: DataFrame, units: DataFrame, pand: DataFrame, sizes: tuple = (0.1, 0.3), compat: bool = False
) -> DataFrame:
    """Adjacency under two buffer sizes, ``..._bldg`` and ``..._bldg030``.

    ``compat`` ranks the second-order value of the wider buffer by the narrow
    buffer's counts and leaves it null without neighbours.
    """
    t = extraction.footprint(extraction.building_function(table, units), pand)
    return extraction.adjacency(t, list(sizes), ["", "030"], compat=compat)


def single_solids(parts: DataFrame, building: DataFrame, geometry: DataFrame) -> DataFrame:
    """``(bag_id, faces)`` of buildings with exactly one solid."""
    held = (
        building.filter("lod1_solid_id is not null")
        .select(F.col("lod1_solid_id").alias("solid_id"))
        .join(geometry.filter("faces is not null"), F.col("solid_id") == F.col("id"))
        .select("cityobject_id", "faces")
        .join(parts.select(F.col("id").alias("cityobject_id"), "gmlid"), "cityobject_id")
        .select(scalars.drop_trailing(F.col("gmlid"), 2).alias("bag_id"), "faces")
    )
    # The count goes first; only single solids carry their geometry further.
    single = held.groupBy("bag_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("bag_id")
    return held.join(single, "bag_id")


def volume_check(
    table: DataFrame,
    parts: DataFrame,
    building: DataFrame,
    geometry: DataFrame,
    objects: DataFrame,
    rows: DataFrame,
    listed: DataFrame,
) -> DataFrame:
    """Volumes of valid solids of ``listed(bag_id)``, and the volume attribute.

    Other ids keep null for the computed volume.
    """
    valid = (
        by_object(objects, attribute(rows, "val3dity_codes_lod12"))
        .filter(F.col("val3dity_codes_lod12") == NO_ERRORS)
        .select("bag_id")
    )
    shapes = single_solids(parts, building, geometry).join(valid, "bag_id", "right")
    computed = shapes.join(listed.select("bag_id"), "bag_id", "left_semi").select(
        "bag_id", solids.volume(F.col("faces")).alias("actual_volume_lod1_postgis")
    )
    out = assign_from(table, computed, "bag_id", order=[F.col("actual_volume_lod1_postgis")])
    stated = by_object(objects, attribute(rows, "lod2_volume")).select(
        "bag_id", scalars.parse_double(F.col("lod2_volume")).alias("actual_volume_lod2_rh")
    )
    return assign_from(out, stated, "bag_id", order=[F.col("actual_volume_lod2_rh")])


def oriented_box_check(table: DataFrame, pand: DataFrame, features: DataFrame) -> DataFrame:
    """Area of the oriented box against the product of its stored sides."""
    t = extraction.footprint(table, pand).withColumn("bbox", hull.oriented_box(F.col("rings")))
    lifted = F.transform(
        "bbox",
        lambda ring: F.transform(
            ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("z"))
        ),
    )
    t = t.withColumn("area_from_bbox", solids.surface_area(lifted))
    product = features.select(
        "bag_id", (F.col("obb_width_lod1") * F.col("obb_length_lod1")).alias("area_check")
    )
    return assign_from(t, product, "bag_id", order=[F.col("area_check")])


def roof_area_from_model(objects: DataFrame, thematic: DataFrame, geometry: DataFrame) -> DataFrame:
    """Summed area, seen from above, of the roof faces per building."""
    roofs = thematic.filter(F.col("objectclass_id") == ROOF_CLASS)
    faces = geometry.select(F.col("root_id").alias("lod2_multi_surface_id"), "rings")
    return (
        objects.select("id", F.col("gmlid").alias("bag_id"))
        .join(shuffled(roofs), F.col("id") == F.col("building_id"))
        .join(shuffled(faces), "lod2_multi_surface_id")
        .groupBy("bag_id")
        .agg(F.sum(planar.area("rings")).alias("roof_area_lod1_postgis"))
    )


def stated_surface_areas(
    objects: DataFrame, thematic: DataFrame, geometry: DataFrame, rows: DataFrame
) -> DataFrame:
    """Roof and wall areas from the attribute of each surface, summed per building in one pass."""
    areas = attribute(rows, "lod2_area")
    faces = geometry.select(F.col("parent_id").alias("lod2_multi_surface_id"), "cityobject_id")
    held = (
        objects.select("id", F.col("gmlid").alias("bag_id"))
        .join(
            shuffled(thematic.filter(F.col("objectclass_id").isin(ROOF_CLASS, WALL_CLASS))),
            F.col("id") == F.col("building_id"),
        )
        .join(shuffled(faces), "lod2_multi_surface_id")
        .join(shuffled(areas), "cityobject_id")
    )
    value = scalars.parse_double(F.col("lod2_area"))
    return held.groupBy("bag_id").agg(
        F.sum(F.when(F.col("objectclass_id") == ROOF_CLASS, value)).alias("roof_area_lod2_rh"),
        F.sum(F.when(F.col("objectclass_id") == WALL_CLASS, value)).alias("wall_area_lod2_rh"),
    )


def surface_area_check(
    table: DataFrame, objects: DataFrame, thematic: DataFrame, geometry: DataFrame, rows: DataFrame
) -> DataFrame:
    t = assign_from(table, roof_area_from_model(objects, thematic, geometry), "bag_id")
    return assign_from(t, stated_surface_areas(objects, thematic, geometry, rows), "bag_id")


# Height attributes.
HEIGHTS = ["h_dak_max", "h_dak_min", "h_maaiveld", "h_dak_70p"]


def height_check(
    table: DataFrame,
    metrics_lod1: DataFrame,
    metrics_lod2: DataFrame,
    objects: DataFrame,
    rows: DataFrame,
) -> DataFrame:
    """Raw heights of the solids next to the height attributes."""
    t = table
    for lod, metrics in (("lod1", metrics_lod1), ("lod2", metrics_lod2)):
        raw = metrics.select(
            scalars.drop_trailing(F.col("id"), 2).alias("bag_id"),
            "id",
            *[F.col(f"{c}_{lod}").alias(f"{c.lower()}_{lod}") for c in ("max_Z", "min_Z", "ground_Z")],
        )
        t = assign_from(t, one_per_key(raw, ["bag_id"], [F.col("id")]).drop("id"), "bag_id")
    stated = by_object(objects, attributes_wide(rows, HEIGHTS))
    return assign_from(t, stated, "bag_id", order=[F.col(HEIGHTS[0])])


# Columns that each report puts side by side.
REPORTS = {
    "adjacency": (["bag_function", "no_adjacent_bldg", "no_adjacent_of_adja_bldg"], []),
    "neighbours": ([f"no_neighbours_{r}m" for r in (25, 50, 75, 100)], []),
    "volume": (
        [
            "actual_volume_lod1_postgis", "actual_volume_lod1", "convex_hull_volume_lod1",
            "actual_volume_lod2_rh", "actual_volume_lod2", "convex_hull_volume_lod2",
        ],
        [("actual_volume_lod1_postgis", "actual_volume_lod1"), ("actual_volume_lod2_rh", "actual_volume_lod2")],
    ),
    "length_width": (
        ["obb_width_lod1", "obb_length_lod1", "area_from_bbox", "area_check"],
        [("area_from_bbox", "area_check")],
    ),
    "surfaces": (
        [
            "wall_area_lod1", "roof_area_lod1", "roof_area_lod1_postgis", "wall_area_lod2",
            "wall_area_lod2_rh", "roof_area_lod2", "roof_area_lod2_rh",
        ],
        [("wall_area_lod2", "wall_area_lod2_rh"), ("roof_area_lod2", "roof_area_lod2_rh")],
    ),
    "heights": (
        [
            "h_dak_max", "max_z_lod2", "h_dak_min", "min_z_lod2", "h_maaiveld", "ground_z_lod1",
            "ground_z_lod2", "h_dak_70p", "max_z_lod1", "min_z_lod1",
        ],
        [("h_dak_max", "max_z_lod2"), ("h_dak_min", "min_z_lod2"), ("h_maaiveld", "ground_z_lod1")],
    ),
}


def report(name: str, checked: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """A comparison table with absolute differences, sorted by building."""
    columns, pairs = REPORTS[name]
    t = checked
    if features is not None:
        more = [c for c in columns if c not in checked.columns]
        t = checked.join(features.select("bag_id", *more), "bag_id")
    if name == "volume":
        t = t.filter("actual_volume_lod1_postgis is not null")
    diffs = [scalars.distance_between(F.col(a), F.col(b)).alias(f"diff_{a}") for a, b in pairs]
    return t.select("bag_id", *columns, *diffs).orderBy("bag_id")


def adjacent_ids(table: DataFrame, bag_id: str, size: float = 0.1) -> DataFrame:
    """Which buildings a single building is adjacent to."""
    from gevel.functions import labels

    known = table.filter(labels.counts_for_adjacency(F.col("bag_function")) & F.col("rings").isNotNull())
    return _around(known, bag_id, 5 * size, lambda p: planar.touches_mitre_buffer(
        "a_rings", size, "b_edges"
    ))


def ids_within(table: DataFrame, bag_id: str, radius: float) -> DataFrame:
    """Which buildings lie within a radius of the centroid of a single building."""
    known = table.filter(F.col("rings").isNotNull())
    near = planar.let(
        planar.centroid_sql("a_rings"),
        lambda c: f"{planar.point_distance_sql(f'{c}.x', f'{c}.y', 'b_edges')} <= {float(radius)}D",
    )
    return _around(known, bag_id, radius, lambda p: F.expr(near))


def _around(known: DataFrame, bag_id: str, reach: float, test) -> DataFrame:
    from gevel.operators import grid

    boxed = planar.with_box(known.select("bag_id", "rings"))
    build = boxed.select("bag_id", planar.edges("rings").alias("edges"), *grid.BOX)
    pairs = grid.box_pairs(boxed.filter(F.col("bag_id") == bag_id), build, reach)
    found = pairs.filter("a_bag_id != b_bag_id").filter(test(pairs))
    return found.select(F.col("b_bag_id").alias("bag_id"))
