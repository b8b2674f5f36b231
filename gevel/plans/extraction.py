"""Features per building, in the order their meaning depends on.

Neighbour counts see every building, adjacency all but odd and unknown
functions, the second-order adjacency again every building; only then are
non-residential buildings removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.functions import hull, labels, planar, scalars
from gevel.operators import grid
from gevel.operators.lookup import assign_from, drop_incomplete, flatten, one_per_key
from gevel.session import materialize

# Radii in metres, sentinel year, column lists.
RADII = [25, 50, 75, 100]
UNKNOWN_YEAR = 1005
REDUNDANT = [
    "ground_area_lod1", "ground_area_lod2", "footprint_perimeter_lod1", "footprint_perimeter_lod2",
    "fp_no_vertices_simple", "ground_point_count_lod1", "ground_point_count_lod2",
    "fp_length", "fp_width", "obb_width_lod2", "obb_length_lod2", "bag_function", "footprint_geom",
    "height_min_roof_lod1", "shared_walls_area_lod1", "shared_walls_area_lod2",
    "closest_distance_lod1", "closest_distance_lod2", "roof_type",
]
REQUIRED = [
    "building_type", "actual_volume_lod1", "convex_hull_volume_lod1", "obb_width_lod1",
    "obb_length_lod1", "wall_area_lod1", "roof_area_lod1", "height_max_lod1", "actual_volume_lod2",
    "convex_hull_volume_lod2", "wall_area_lod2", "roof_area_lod2", "height_max_lod2",
    "height_min_roof_lod2", "bag_construction_year",
]
METRIC_COLUMNS = [
    "actual_volume", "convex_hull_volume", "footprint_perimeter", "obb_width", "obb_length",
    "ground_area", "wall_area", "roof_area", "ground_point_count",
]


def units_in_use(units: DataFrame) -> DataFrame:
    return units.filter(
        F.col("status").startswith(labels.UNIT_IN_USE) & F.col("eindgeldigheid").isNull()
    )


def purposes(units: DataFrame) -> DataFrame:
    """Distinct purposes per building, ``(bag_id, uses)``."""
    pairs = flatten(flatten(units_in_use(units), "pandref", "bag_id"), "gebruiksdoel", "use")
    return pairs.groupBy("bag_id").agg(F.sort_array(F.collect_set("use")).alias("uses"))


def building_function(table: DataFrame, units: DataFrame) -> DataFrame:
    """Add ``bag_function``."""
    with_uses = assign_from(table, purposes(units), "bag_id")
    return with_uses.withColumn("bag_function", labels.function_class(F.col("uses"))).drop("uses")


def construction_year(table: DataFrame, pand: DataFrame) -> DataFrame:
    """Add ``bag_construction_year`` from the current registry version."""
    source = pand.select(
        F.col("identificatie").alias("bag_id"),
        "eindgeldigheid",
        F.col("oorspronkelijkbouwjaar").alias("bag_construction_year"),
    )
    current = [F.col("eindgeldigheid").isNull(), F.col("eindgeldigheid")]
    picked = one_per_key(source, ["bag_id"], current).drop("eindgeldigheid")
    return assign_from(table, picked, "bag_id").withColumn(
        "bag_construction_year",
        scalars.sentinel_to_null(F.col("bag_construction_year"), UNKNOWN_YEAR),
    )


def dwellings(table: DataFrame, units: DataFrame) -> DataFrame:
    """Add ``bag_no_dwellings``; buildings without units stay null."""
    counts = (
        flatten(units_in_use(units), "pandref", "bag_id")
        .groupBy("bag_id")
        .agg(F.count_distinct("identificatie").alias("bag_no_dwellings"))
    )
    return assign_from(table, counts, "bag_id")


def footprint(table: DataFrame, pand: DataFrame) -> DataFrame:
    """Add the footprint ``rings`` of the current registry version."""
    source = pand.select(F.col("identificatie").alias("bag_id"), "eindgeldigheid", "rings")
    current = [F.col("eindgeldigheid").isNull(), F.col("eindgeldigheid")]
    return assign_from(
        table, one_per_key(source, ["bag_id"], current).drop("eindgeldigheid"), "bag_id"
    )


def registry(table: DataFrame, pand: DataFrame) -> DataFrame:
    """Add ``rings`` and ``bag_construction_year`` of the current registry version, in one pass over it."""
    source = pand.select(
        F.col("identificatie").alias("bag_id"),
        "eindgeldigheid",
        F.col("oorspronkelijkbouwjaar").alias("bag_construction_year"),
        "rings",
    )
    current = [F.col("eindgeldigheid").isNull(), F.col("eindgeldigheid")]
    picked = one_per_key(source, ["bag_id"], current).drop("eindgeldigheid")
    return assign_from(table, picked, "bag_id").withColumn(
        "bag_construction_year",
        scalars.sentinel_to_null(F.col("bag_construction_year"), UNKNOWN_YEAR),
    )


def _per_shape(table: DataFrame, shapes: DataFrame, values: DataFrame) -> DataFrame:
    """Bring values per ``shape_id`` back to the rows with that footprint."""
    keyed = shapes.select("shape_id", "shape_key", "copies").join(values, "shape_id", "left")
    # Rows without a footprint get a key of their own, not all the same null.
    own = F.coalesce(grid.shape_key(F.col("rings")), F.concat(F.lit("none-"), F.col("bag_id")))
    joined = table.withColumn("shape_key", own).join(keyed.drop("shape_id"), "shape_key", "left")
    return joined.drop("shape_key")


def footprint_shapes(table: DataFrame) -> DataFrame:
    """Distinct footprints with the number of buildings, and of those that count for adjacency.

    Written once: the spatial joins read it several times, and whatever led to
    ``table`` need not run again for each.
    """
    eligible = F.lit(False)
    if "bag_function" in table.columns:
        eligible = labels.counts_for_adjacency(F.col("bag_function"))
    return materialize(grid.distinct_shapes(table, eligible=eligible), "shapes")


def adjacency(
    table: DataFrame,
    sizes: list[float],
    names: list[str] | None = None,
    compat: bool = False,
    shapes: DataFrame | None = None,
) -> DataFrame:
    """Add first and second-order adjacency for one or more buffer sizes.

    For each size two columns: the number of adjacent buildings (both ends of a
    known function), and the highest such number among all adjacent buildings.
    With ``compat`` the second-order values of all sizes use the counts of the
    first size, and those of further sizes stay null without neighbours.
    """
    names = names or ["" if i == 0 else f"_{i}" for i in range(len(sizes))]
    eligible = labels.counts_for_adjacency(F.col("bag_function"))
    shapes = footprint_shapes(table) if shapes is None else shapes
    # Used twice below; the outlines are the costly part, so measure them once.
    pairs = materialize(grid.touching_shapes(shapes, sizes), "adjacent")
    n = range(len(sizes))
    weight = shapes.select(F.col("shape_id").alias("b_id"), F.col("eligible").alias("w"))
    seen = (
        pairs.join(weight, "b_id")
        .groupBy(F.col("a_id").alias("shape_id"))
        .agg(*[F.sum(F.when(F.col(f"touch_{i}"), F.col("w"))).alias(f"others_{i}") for i in n])
    )
    # What an eligible building with this footprint counts: others, and its own copies.
    degree = [
        F.when(F.col("eligible") > 0, F.coalesce(f"others_{i}", F.lit(0)) + F.col("eligible") - 1)
        .otherwise(0)
        .alias(f"degree_{i}")
        for i in n
    ]
    first = (
        shapes.select("shape_id", "eligible").join(seen, "shape_id", "left").select(
            "shape_id", "eligible", *degree
        )
    )
    ranked_by = [0 if compat else i for i in n]
    far = first.select(F.col("shape_id").alias("b_id"), *[f"degree_{i}" for i in n])
    around = (
        pairs.join(far, "b_id")
        .groupBy(F.col("a_id").alias("shape_id"))
        .agg(
            *[
                F.max(F.when(F.col(f"touch_{i}"), F.col(f"degree_{ranked_by[i]}"))).alias(f"around_{i}")
                for i in n
            ]
        )
    )
    rows = _per_shape(table, shapes.drop("eligible"), first.join(around, "shape_id", "left"))
    # Copies of the same footprint are adjacent too: a twin that counts, or one that does not.
    twin_counts = F.col("eligible") - eligible.cast("int") > 0
    has_twin = F.col("copies") > 1
    added = []
    for i, name in enumerate(names):
        twin = F.when(has_twin, F.when(twin_counts, F.col(f"degree_{ranked_by[i]}")).otherwise(0))
        one = scalars.zero_if_present(F.when(eligible, F.col(f"degree_{i}")), F.col("rings"))
        two = F.greatest(F.col(f"around_{i}"), twin)
        if not (compat and i > 0):
            two = scalars.zero_if_present(two, F.col("rings"))
        added += [one.alias(f"no_adjacent_bldg{name}"), two.alias(f"no_adjacent_of_adja_bldg{name}")]
    return rows.select(*table.columns, *added)


def neighbours(
    table: DataFrame, radii: list[int] = RADII, shapes: DataFrame | None = None
) -> DataFrame:
    """Add ``no_neighbours_<r>m``: other footprints within reach of the centroid."""
    shapes = footprint_shapes(table) if shapes is None else shapes
    within = grid.shapes_within(shapes, [float(r) for r in radii])
    names = [f"no_neighbours_{r}m" for r in radii]
    centre = planar.centroid("rings")
    own = shapes.select("shape_id", centre.alias("c"), planar.edges("rings").alias("e")).select(
        "shape_id", planar.point_distance("c.x", "c.y", "e").alias("own")
    )
    values = within.join(own, "shape_id").select(
        "shape_id",
        *[
            (F.col(f"within_{i}") - (F.col("own") <= r).cast("int")).alias(n)
            for i, (r, n) in enumerate(zip(radii, names))
        ],
    )
    rows = _per_shape(table, shapes.drop("eligible"), values).drop("copies")
    for n in names:
        rows = rows.withColumn(n, scalars.zero_if_present(F.col(n), F.col("rings")))
    return rows


def residential_only(table: DataFrame) -> DataFrame:
    return table.filter(labels.is_kept_residential(F.col("bag_function")))


def outline(table: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Add area, perimeter and vertex counts of the footprint."""
    thinned = table.withColumn("__thin", hull.simplify(tolerance)(F.col("rings")))
    return thinned.select(
        *table.columns,
        planar.area("rings").alias("fp_area"),
        planar.perimeter("rings").alias("fp_perimeter"),
        planar.point_count("rings").alias("fp_no_vertices"),
        planar.point_count("__thin").alias("fp_no_vertices_simple"),
    )


def length_width(table: DataFrame) -> DataFrame:
    """Add ``fp_length`` and ``fp_width``: the extent of the oriented box.

    The extent is axis-aligned, so both exceed the true sides of a turned
    building; ``obb_length`` and ``obb_width`` give those.
    """
    boxed = table.withColumn("__box", hull.oriented_box(F.col("rings")))
    x1, y1, x2, y2 = planar.box_of("__box")
    one, two = y2 - y1, x2 - x1
    return boxed.select(
        *table.columns,
        F.greatest(one, two).alias("fp_length"),
        F.least(one, two).alias("fp_width"),
    )


def storeys(table: DataFrame, objects: DataFrame, building: DataFrame) -> DataFrame:
    """Add ``no_storeys`` from the object tables."""
    known = building.filter("storeys_above_ground is not null")
    source = objects.join(known, "id").select(
        F.col("gmlid").alias("bag_id"), F.col("storeys_above_ground").alias("no_storeys")
    )
    return assign_from(table, source, "bag_id", order=[F.col("no_storeys")])


def metric_features(
    table: DataFrame, metrics: DataFrame, lod: str, strict_ids: bool = False
) -> DataFrame:
    """Add the 3D features of one level of detail.

    A part id is the building id and two characters; ``strict_ids`` drops a
    dashed number of any length instead. Of several parts the highest id counts.
    """
    key = scalars.part_suffix(F.col("id")) if strict_ids else scalars.drop_trailing(F.col("id"), 2)
    m = lambda name: F.col(f"{name}_{lod}")
    source = metrics.select(
        key.alias("bag_id"),
        "id",
        *[m(c) for c in METRIC_COLUMNS],
        (m("max_Z") - m("ground_Z")).alias(f"height_max_{lod}"),
        (m("min_Z") - m("ground_Z")).alias(f"height_min_roof_{lod}"),
        m("shared_walls_area"),
        m("closest_distance"),
    )
    picked = one_per_key(source, ["bag_id"], [F.col("id")]).drop("id")
    return assign_from(table, picked, "bag_id")


def remove_redundant(table: DataFrame) -> DataFrame:
    return table.drop(*REDUNDANT, "rings")


def remove_incomplete(table: DataFrame) -> DataFrame:
    return drop_incomplete(table, REQUIRED)


def extract_features(
    table: DataFrame,
    units: DataFrame,
    pand: DataFrame,
    metrics_lod1: DataFrame,
    metrics_lod2: DataFrame,
    objects: DataFrame | None = None,
    building: DataFrame | None = None,
    buffer_size: float = 0.1,
    radii: list[int] = RADII,
) -> DataFrame:
    """The whole stage: ``table`` holds ``bag_id`` and ``building_type``."""
    t = building_function(table, units)
    t = registry(t, pand)
    # Registry joins end here; everything spatial starts from this table.
    t = materialize(t, "located")
    shapes = footprint_shapes(t)
    t = adjacency(t, [buffer_size], shapes=shapes)
    t = neighbours(t, radii, shapes=shapes)
    t = residential_only(t)
    t = dwellings(t, units)
    t = outline(t)
    t = length_width(t)
    t = metric_features(t, metrics_lod1, "lod1")
    t = metric_features(t, metrics_lod2, "lod2")
    if objects is not None and building is not None:
        t = storeys(t, objects, building)
    return remove_incomplete(remove_redundant(t))
