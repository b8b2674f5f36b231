"""Features, labels and validation, stage by stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from gevel.functions import labels, scalars, solids
from gevel.operators import lookup
from gevel.plans import cleaning, extraction, groundtruth, validation
from gevel.queries import standins as S
from gevel.queries.registry import query
from gevel.queries.solidstand import box_solids
from gevel.sources.metrics_csv import import_metrics


def ids(spark, d):
    return S.buildings(spark, d).select("bag_id")


def labelled(spark, d):
    """Buildings with counted labels and the features the cleaning looks at."""
    held = groundtruth.register_labels(S.energy(spark, d), S.units(spark, d), S.pand(spark, d))
    area = groundtruth.area_labels(S.cityobject(spark, d), held)
    t = area.join(S.buildings(spark, d), "bag_id", "left")
    t = extraction.building_function(t, S.units(spark, d))
    t = extraction.adjacency(t, [0.1])
    return extraction.dwellings(t, S.units(spark, d)).drop("rings", "bag_function")


# Labels of an area with their counts, and the features beside them.
LABELLED = """
    counted as (
        select bag_id, cast(sum(n) as bigint) as total, min(label) as label,
               coalesce(sum(n) filter (where label = 'Appartement'), 0) as a,
               coalesce(sum(n) filter (where label = 'Maisonnette'), 0) as m,
               coalesce(sum(n) filter (where label = 'Galerijwoning'), 0) as g,
               coalesce(sum(n) filter (where label = 'Portiekwoning'), 0) as p,
               coalesce(sum(n) filter (where label = 'Flatwoning (overig)'), 0) as f
        from labels_ep group by bag_id),
    held as (
        select o.gmlid as bag_id, total, label, a, m, g, p, f, n, nn, bag_no_dwellings as dw
        from cityobject o left join counted c on c.bag_id = o.gmlid
        left join area_adjacency2 x on x.bag_id = o.gmlid left join dwellings w on w.pandid = o.gmlid
        where objectclass_id = 26),
    voted as (
        select *, case when total <> 1 then
            case when a > m and a > g and a > p and a > f then 'Flatwoning (overig)'
                 when m >= a and m > g and m > p and m >= f then 'Maisonette'
                 when g >= a and g > m and g > p and g >= f then 'Galerijwoning'
                 when p >= a and p > m and p > g and p >= f then 'Portiekwoning'
                 when f >= a and f > m and f > g and f > p then 'Flatwoning (overig)' end
            when total = 1 and label like '%/%' and dw = 1 and n = 1 and nn = 1 then 'Twee-onder-één-kap'
            when total = 1 and label like '%/%' and dw = 1 and n = 1 and nn > 1 then 'Rijwoning hoek'
            when total = 1 and label like '%/%' and dw = 1 and n > 1 then 'Rijwoning tussen'
            when total = 1 and label not like '%/%' then label end as l1
        from held),
    settled as (
        select *, case when l1 is null and n = 0 and dw = 1 then 'Vrijstaande Woning' else l1 end as l2
        from voted)"""


@query("x1_building_function", "select bag_id, bag_function from functions")
def _(spark, d):
    return extraction.building_function(ids(spark, d), S.units(spark, d))


@query(
    "x2_construction_year",
    "select b.bag_id, bag_construction_year from boxes b left join years on identificatie = b.bag_id",
)
def _(spark, d):
    return extraction.construction_year(ids(spark, d), S.pand(spark, d))


@query(
    "x3_dwellings",
    "select b.bag_id, bag_no_dwellings from boxes b left join dwellings on pandid = b.bag_id",
)
def _(spark, d):
    return extraction.dwellings(ids(spark, d), S.units(spark, d))


@query(
    "x7_outline",
    """select identificatie as bag_id, round((maxx - minx) * (maxy - miny), 6) as fp_area,
              round(2 * (maxx - minx + maxy - miny), 6) as fp_perimeter, cast(5 as bigint) as fp_no_vertices,
              cast(5 as bigint) as fp_no_vertices_simple from current_fp""",
)
def _(spark, d):
    t = extraction.outline(extraction.footprint(ids(spark, d), S.pand(spark, d)))
    return t.select(
        "bag_id",
        F.round("fp_area", 6).alias("fp_area"),
        F.round("fp_perimeter", 6).alias("fp_perimeter"),
        F.col("fp_no_vertices").cast("bigint").alias("fp_no_vertices"),
        F.col("fp_no_vertices_simple").cast("bigint").alias("fp_no_vertices_simple"),
    )


@query(
    "x8_length_width",
    """select identificatie as bag_id, round(greatest(maxx - minx, maxy - miny), 6) as fp_length,
              round(least(maxx - minx, maxy - miny), 6) as fp_width from current_fp""",
)
def _(spark, d):
    t = extraction.length_width(extraction.footprint(ids(spark, d), S.pand(spark, d)))
    return t.select(
        "bag_id", F.round("fp_length", 6).alias("fp_length"), F.round("fp_width", 6).alias("fp_width")
    )


@query(
    "x9_storeys",
    """select b.bag_id, cast(storeys_above_ground as bigint) as no_storeys from boxes b
       join building u on u.id = b.p_partkey""",
)
def _(spark, d):
    t = extraction.storeys(ids(spark, d), S.cityobject(spark, d), S.building(spark, d))
    return t.select("bag_id", F.col("no_storeys").cast("bigint").alias("no_storeys"))


@query(
    "x10_metric_features",
    """select b.bag_id, actual_volume as actual_volume_lod1, wall_area as wall_area_lod1,
              "max_Z" - "ground_Z" as height_max_lod1, "min_Z" - "ground_Z" as height_min_roof_lod1,
              closest_distance as closest_distance_lod1
       from boxes b left join (select * from metrics where hole_count = 0) m on left(m.id, -2) = b.bag_id""",
)
def _(spark, d):
    m = import_metrics(S.metrics(spark, d), "lod1")
    return extraction.metric_features(ids(spark, d), m, "lod1").select(
        "bag_id",
        "actual_volume_lod1",
        "wall_area_lod1",
        "height_max_lod1",
        "height_min_roof_lod1",
        "closest_distance_lod1",
    )


def raw_features(spark, d):
    m = S.metrics(spark, d)
    t = groundtruth.attribute_labels(S.cityobject(spark, d), S.attributes(spark, d))
    for lod in ("lod1", "lod2"):
        t = extraction.metric_features(t, import_metrics(m, lod), lod)
    return extraction.construction_year(t, S.pand(spark, d))


@query(
    "x12_remove_redundant",
    """select o.gmlid as bag_id, roof_area as roof_area_lod1, "min_Z" - "ground_Z" as height_min_roof_lod2
       from cityobject o left join (select * from metrics where hole_count = 0) m on left(m.id, -2) = o.gmlid
       where objectclass_id = 26 and name is not null""",
)
def _(spark, d):
    t = extraction.remove_redundant(raw_features(spark, d))
    assert "height_min_roof_lod1" not in t.columns and "obb_width_lod2" not in t.columns
    return t.select("bag_id", "roof_area_lod1", "height_min_roof_lod2")


@query(
    "x13_remove_incomplete",
    """select o.gmlid as bag_id, wall_area as wall_area_lod1, bag_construction_year
       from cityobject o join metrics m on left(m.id, -2) = o.gmlid
       join years on identificatie = o.gmlid
       where objectclass_id = 26 and name is not null and hole_count = 0 and wall_area is not null
         and bag_construction_year is not null""",
)
def _(spark, d):
    t = extraction.remove_incomplete(raw_features(spark, d))
    return t.select("bag_id", "wall_area_lod1", "bag_construction_year")


@query(
    "x14_register_labels",
    """select bag_id, cast(sum(n) as bigint) as size,
              count(*) as kinds, cast(coalesce(sum(n) filter (where label is null), 0) as bigint) as missing,
              max(n) as most
       from labels_ep group by bag_id""",
)
def _(spark, d):
    held = groundtruth.register_labels(S.energy(spark, d), S.units(spark, d), S.pand(spark, d))
    t = F.col("building_type")
    return held.select(
        "bag_id",
        lookup.counted_size(t).alias("size"),
        F.size(t).cast("bigint").alias("kinds"),
        lookup.counted_size(F.filter(t, lambda e: e["value"].isNull())).alias("missing"),
        F.array_max(F.transform(t, lambda e: e["n"])).alias("most"),
    )


@query(
    "x15_attribute_labels",
    """select gmlid as bag_id, strval as building_type from cityobject o
       left join (select * from attributes where attrname = 'dutch_building_type') a on a.cityobject_id = o.id
       where objectclass_id = 26 and name is not null""",
)
def _(spark, d):
    return groundtruth.attribute_labels(S.cityobject(spark, d), S.attributes(spark, d))


@query(
    "x15_area_labels",
    """select gmlid as bag_id, cast(total as bigint) as labels from cityobject o
       left join (select bag_id, sum(n) as total from labels_ep group by 1) l on l.bag_id = o.gmlid
       where objectclass_id = 26""",
)
def _(spark, d):
    held = groundtruth.register_labels(S.energy(spark, d), S.units(spark, d), S.pand(spark, d))
    t = groundtruth.area_labels(S.cityobject(spark, d), held)
    return t.select("bag_id", lookup.counted_size(F.col("building_type")).alias("labels"))


@query(
    "f7_majority_label",
    f"with {LABELLED.strip()} select bag_id, l1 as label from voted where total <> 1",
)
def _(spark, d):
    held = groundtruth.register_labels(S.energy(spark, d), S.units(spark, d), S.pand(spark, d))
    t = groundtruth.area_labels(S.cityobject(spark, d), held)
    many = cleaning.vote(t).filter(lookup.counted_size(F.col("building_type")) != 1)
    return many.select("bag_id", F.col("building_type2").alias("label"))


@query("p16_conditional_labels", f"with {LABELLED.strip()} select bag_id, l2 as label from settled")
def _(spark, d):
    t = labelled(spark, d)
    t = cleaning.detached_rest(
        cleaning.take_single_label(cleaning.split_shared_label(cleaning.vote(t)))
    )
    return t.select("bag_id", F.col("building_type2").alias("label"))


@query(
    "p17_override",
    """select gmlid as bag_id, case when p_size = 3 then 'Flatwoning' else name end as building_type2
       from cityobject join (select bag_id, p_size from boxes) on bag_id = gmlid""",
)
def _(spark, d):
    t = S.cityobject(spark, d).select(
        F.col("gmlid").alias("bag_id"), F.col("name").alias("building_type2")
    )
    decisions = S.boxes(spark, d).filter("p_size = 3").select(
        "bag_id", F.lit("Flatwoning").alias("label")
    )
    return cleaning.override(t, decisions)


@query(
    "x16_label_cleaning",
    f"""with {LABELLED.strip()} select bag_id,
        case l2 when 'Flatwoning (overig)' then 'Flatwoning' when 'Rijwoning hoek' then 'Hoekwoning'
                when 'Maisonette' then 'Maisonnettewoning' when 'Maisonnette' then 'Maisonnettewoning'
                when 'Rijwoning tussen' then 'Tussenwoning' when 'Twee-onder-één-kap' then 'Twee-onder-een-kapwoning'
                else l2 end as building_type from settled""",
)
def _(spark, d):
    return cleaning.clean_labels(labelled(spark, d)).select("bag_id", "building_type")


_VIEW = {
    "multiple": "total <> 1",
    "shared": "total = 1 and label like '%/%'",
    "single": "total = 1 and label not like '%/%'",
    "apartment": "total = 1 and label = 'Appartement'",
    "missing": "total = 1 and label is null",
}

for _kind, _cond in _VIEW.items():

    @query(
        f"x24_labels_{_kind}",
        f"with {LABELLED.strip()} select bag_id, n as no_adjacent_bldg, dw as bag_no_dwellings from held where {_cond}",
    )
    def _(spark, d, kind=_kind):
        return cleaning.label_view(labelled(spark, d), kind).select(
            "bag_id", "no_adjacent_bldg", "bag_no_dwellings"
        )


def city_parts(spark, d):
    """Building parts with their own ids; some buildings have two."""
    k = F.col("p_partkey")
    return S.boxes(spark, d).select(
        F.explode(
            F.when(
                F.col("p_size") % 15 == 0,
                F.array(
                    F.struct((k + 5_000_000_000).alias("id"), F.concat("bag_id", F.lit("-0")).alias("gmlid")),
                    F.struct((k + 6_000_000_000).alias("id"), F.concat("bag_id", F.lit("-1")).alias("gmlid")),
                ),
            ).otherwise(
                F.array(
                    F.struct((k + 5_000_000_000).alias("id"), F.concat("bag_id", F.lit("-0")).alias("gmlid"))
                )
            )
        ).alias("p")
    ).select("p.*")


def solid_rows(spark, d):
    """One solid row per part, under the solid id of its building."""
    parts = city_parts(spark, d).withColumnRenamed("id", "cityobject_id")
    held = box_solids(spark, d).select("bag_id", (F.col("p_partkey") * 10).alias("id"), "faces")
    keyed = parts.withColumn("bag_id", scalars.drop_trailing(F.col("gmlid"), 2))
    return keyed.join(held, "bag_id").select("id", "cityobject_id", "faces")


@query(
    "a7_single_solids",
    """select b.bag_id, round((maxx - minx) * (maxy - miny) * height, 6) as volume
       from boxes b where p_size % 8 <> 0 and p_size % 15 <> 0""",
)
def _(spark, d):
    t = validation.single_solids(
        city_parts(spark, d), S.building(spark, d), solid_rows(spark, d)
    )
    return t.select("bag_id", F.round(solids.volume(F.col("faces")), 6).alias("volume"))


@query(
    "x18_volume_check",
    """select gmlid as bag_id,
              case when b.p_size % 8 <> 0 and b.p_size % 15 <> 0 and b.p_size % 12 <> 0 and b.p_size <= 10
                   then round((maxx - minx) * (maxy - miny) * height, 6) end as actual_volume_lod1_postgis,
              cast(a.strval as double) as actual_volume_lod2_rh
       from cityobject o join boxes b on b.bag_id = o.gmlid
       left join attributes a on a.cityobject_id = o.id and a.attrname = 'lod2_volume'
       where objectclass_id = 26 and name is not null""",
)
def _(spark, d):
    objects = S.cityobject(spark, d)
    listed = S.boxes(spark, d).filter("p_size <= 10").select("bag_id")
    t = validation.volume_check(
        groundtruth.study_buildings(objects),
        city_parts(spark, d),
        S.building(spark, d),
        solid_rows(spark, d),
        objects,
        S.attributes(spark, d),
        listed,
    )
    return t.select(
        "bag_id",
        F.round("actual_volume_lod1_postgis", 6).alias("actual_volume_lod1_postgis"),
        "actual_volume_lod2_rh",
    )


def obb_features(spark, d):
    m = import_metrics(S.metrics(spark, d), "lod1")
    return m.select(
        scalars.drop_trailing(F.col("id"), 2).alias("bag_id"), "obb_width_lod1", "obb_length_lod1"
    )


@query(
    "x19_oriented_box_check",
    """select o.gmlid as bag_id, round((maxx - minx) * (maxy - miny), 6) as area_from_bbox,
              round(obb_width * obb_length, 6) as area_check
       from cityobject o join current_fp c on c.identificatie = o.gmlid
       left join (select * from metrics where hole_count = 0) m on left(m.id, -2) = o.gmlid
       where objectclass_id = 26 and name is not null""",
)
def _(spark, d):
    t = validation.oriented_box_check(
        groundtruth.study_buildings(S.cityobject(spark, d)), S.pand(spark, d), obb_features(spark, d)
    )
    return t.select(
        "bag_id",
        F.round("area_from_bbox", 6).alias("area_from_bbox"),
        F.round("area_check", 6).alias("area_check"),
    )


AREAS = """
    select o.gmlid as bag_id, round(r.roof, 6) as roof_area_lod1_postgis, s.roof as roof_area_lod2_rh,
           s.wall as wall_area_lod2_rh
    from cityobject o
    left join (select building_id, sum((maxx - minx) * (maxy - miny)) as roof
               from thematic_surface t join surface_geometry g on g.root_id = t.lod2_multi_surface_id
               where t.objectclass_id = 33 group by 1) r on r.building_id = o.id
    left join (select building_id, sum(cast(strval as double)) filter (where t.objectclass_id = 33) as roof,
                      sum(cast(strval as double)) filter (where t.objectclass_id = 34) as wall
               from thematic_surface t join surface_geometry g on g.parent_id = t.lod2_multi_surface_id
               join attributes a on a.cityobject_id = g.cityobject_id and a.attrname = 'lod2_area'
               group by 1) s on s.building_id = o.id
    where o.objectclass_id = 26 and o.name is not null"""


@query("x20_surface_area_check", AREAS)
def _(spark, d):
    objects = S.cityobject(spark, d)
    t = validation.surface_area_check(
        groundtruth.study_buildings(objects),
        objects,
        S.thematic_surface(spark, d),
        S.surface_geometry(spark, d),
        S.attributes(spark, d),
    )
    return t.withColumn("roof_area_lod1_postgis", F.round("roof_area_lod1_postgis", 6))


def heights(spark, d):
    objects, m = S.cityobject(spark, d), S.metrics(spark, d)
    return validation.height_check(
        groundtruth.study_buildings(objects),
        import_metrics(m, "lod1"),
        import_metrics(m, "lod2"),
        objects,
        S.attributes(spark, d),
    )


HEIGHTS = """
    select o.gmlid as bag_id, h_dak_max, "max_Z" as max_z_lod2, h_dak_min, "min_Z" as min_z_lod2, h_maaiveld,
           "ground_Z" as ground_z_lod1, "ground_Z" as ground_z_lod2, h_dak_70p, "max_Z" as max_z_lod1,
           "min_Z" as min_z_lod1
    from cityobject o left join (select * from metrics where hole_count = 0) m on left(m.id, -2) = o.gmlid
    left join (select cityobject_id, max(realval) filter (where attrname = 'h_dak_max') as h_dak_max,
                      max(realval) filter (where attrname = 'h_dak_min') as h_dak_min,
                      max(realval) filter (where attrname = 'h_maaiveld') as h_maaiveld,
                      max(realval) filter (where attrname = 'h_dak_70p') as h_dak_70p
               from attributes group by 1) a on a.cityobject_id = o.id
    where objectclass_id = 26 and name is not null"""


@query("x21_height_check", HEIGHTS)
def _(spark, d):
    return heights(spark, d)


@query(
    "x22_height_report",
    f"""select *, abs(h_dak_max - max_z_lod2) as diff_h_dak_max, abs(h_dak_min - min_z_lod2) as diff_h_dak_min,
               abs(h_maaiveld - ground_z_lod1) as diff_h_maaiveld from ({HEIGHTS}) order by bag_id""",
)
def _(spark, d):
    return validation.report("heights", heights(spark, d))


@query(
    "x22_surface_report",
    f"""select bag_id, wall_area as wall_area_lod1, roof_area as roof_area_lod1, roof_area_lod1_postgis,
               wall_area as wall_area_lod2, wall_area_lod2_rh, roof_area as roof_area_lod2, roof_area_lod2_rh,
               abs(wall_area - wall_area_lod2_rh) as diff_wall_area_lod2,
               abs(roof_area - roof_area_lod2_rh) as diff_roof_area_lod2
        from ({AREAS}) join metrics on left(id, -2) = bag_id where hole_count = 0 order by bag_id""",
)
def _(spark, d):
    objects, m = S.cityobject(spark, d), S.metrics(spark, d)
    checked = validation.surface_area_check(
        groundtruth.study_buildings(objects),
        objects,
        S.thematic_surface(spark, d),
        S.surface_geometry(spark, d),
        S.attributes(spark, d),
    ).withColumn("roof_area_lod1_postgis", F.round("roof_area_lod1_postgis", 6))
    features = import_metrics(m, "lod1").join(lookup.shuffled(import_metrics(m, "lod2")), "id")
    keyed = features.withColumn("bag_id", scalars.drop_trailing(F.col("id"), 2))
    return validation.report("surfaces", checked, keyed)


@query(
    "x22_neighbour_report",
    """select bag_id, n25 as no_neighbours_25m, n50 as no_neighbours_50m, n75 as no_neighbours_75m,
              n100 as no_neighbours_100m from neighbours order by bag_id""",
)
def _(spark, d):
    return validation.report("neighbours", extraction.neighbours(S.buildings(spark, d)))


@query(
    "x22_adjacency_report",
    """select bag_id, bag_function, n as no_adjacent_bldg, nn as no_adjacent_of_adja_bldg
       from adjacency2 order by bag_id""",
)
def _(spark, d):
    t = extraction.building_function(S.buildings(spark, d), S.units(spark, d))
    return validation.report("adjacency", extraction.adjacency(t, [0.1]))


@query(
    "x22_length_width_report",
    """select o.gmlid as bag_id, obb_width as obb_width_lod1, obb_length as obb_length_lod1,
              round((maxx - minx) * (maxy - miny), 6) as area_from_bbox, round(obb_width * obb_length, 6) as area_check,
              round(abs(round((maxx - minx) * (maxy - miny), 6) - round(obb_width * obb_length, 6)), 6) as diff_area_from_bbox
       from cityobject o join current_fp c on c.identificatie = o.gmlid
       join (select * from metrics where hole_count = 0) m on left(m.id, -2) = o.gmlid
       where objectclass_id = 26 and name is not null order by 1""",
)
def _(spark, d):
    features = obb_features(spark, d)
    checked = validation.oriented_box_check(
        groundtruth.study_buildings(S.cityobject(spark, d)), S.pand(spark, d), features
    )
    for c in ("area_from_bbox", "area_check"):
        checked = checked.withColumn(c, F.round(c, 6))
    out = validation.report("length_width", checked, features)
    return out.withColumn("diff_area_from_bbox", F.round("diff_area_from_bbox", 6))


@query(
    "x22_volume_report",
    """select o.gmlid as bag_id, round((maxx - minx) * (maxy - miny) * height, 6) as actual_volume_lod1_postgis,
              round(actual_volume, 6) as actual_volume_lod1, convex_hull_volume as convex_hull_volume_lod1,
              cast(a.strval as double) as actual_volume_lod2_rh, round(actual_volume, 6) as actual_volume_lod2,
              convex_hull_volume as convex_hull_volume_lod2
       from cityobject o join boxes b on b.bag_id = o.gmlid
       join metrics m on left(m.id, -2) = o.gmlid
       left join attributes a on a.cityobject_id = o.id and a.attrname = 'lod2_volume'
       where objectclass_id = 26 and name is not null and hole_count = 0 and b.p_size <= 10
         and b.p_size % 8 <> 0 order by 1""",
)
def _(spark, d):
    objects, m = S.cityobject(spark, d), S.metrics(spark, d)
    checked = validation.volume_check(
        groundtruth.study_buildings(objects),
        city_parts(spark, d),
        S.building(spark, d),
        solid_rows(spark, d),
        objects,
        S.attributes(spark, d),
        S.boxes(spark, d).filter("p_size <= 10").select("bag_id"),
    )
    features = import_metrics(m, "lod1").join(import_metrics(m, "lod2"), "id")
    keyed = features.withColumn("bag_id", scalars.drop_trailing(F.col("id"), 2))
    out = validation.report("volume", checked, keyed)
    for c in ("actual_volume_lod1_postgis", "actual_volume_lod1", "actual_volume_lod2"):
        out = out.withColumn(c, F.round(c, 6))
    return out.drop("diff_actual_volume_lod1_postgis", "diff_actual_volume_lod2_rh")


@query(
    "x23_validation_population",
    "select gmlid as bag_id from cityobject where objectclass_id = 26 and name is not null",
)
def _(spark, d):
    return lookup.require_unique(groundtruth.study_buildings(S.cityobject(spark, d)), "bag_id")


def all_features(spark, d):
    """The whole feature table of the study buildings."""
    objects, m = S.cityobject(spark, d), S.metrics(spark, d)
    return extraction.extract_features(
        groundtruth.attribute_labels(objects, S.attributes(spark, d)),
        S.units(spark, d),
        S.pand(spark, d),
        import_metrics(m, "lod1"),
        import_metrics(m, "lod2"),
        objects,
        S.building(spark, d),
    )


FEATURES_SQL = """select a.gmlid as bag_id, l.strval as building_type, n as no_adjacent_bldg, nn as no_adjacent_of_adja_bldg,
              n25 as no_neighbours_25m, n100 as no_neighbours_100m, bag_construction_year, bag_no_dwellings,
              round((c.maxx - c.minx) * (c.maxy - c.miny), 6) as fp_area,
              cast(storeys_above_ground as bigint) as no_storeys,
              wall_area as wall_area_lod1, "max_Z" - "ground_Z" as height_max_lod2
       from cityobject a join functions f on f.bag_id = a.gmlid
       join attributes l on l.cityobject_id = a.id and l.attrname = 'dutch_building_type'
       join study_adjacency2 x on x.bag_id = a.gmlid join study_neighbours k on k.bag_id = a.gmlid
       join years y on y.identificatie = a.gmlid join current_fp c on c.identificatie = a.gmlid
       join metrics m on left(m.id, -2) = a.gmlid
       join building u on u.id = a.id
       left join dwellings w on w.pandid = a.gmlid
       where a.objectclass_id = 26 and a.name is not null and hole_count = 0 and wall_area is not null
         and bag_construction_year is not null and f.bag_function in ('Residential', 'Mixed-residential')"""


@query("features_all", FEATURES_SQL)
def _(spark, d):
    t = all_features(spark, d)
    return t.select(
        "bag_id",
        "building_type",
        "no_adjacent_bldg",
        "no_adjacent_of_adja_bldg",
        "no_neighbours_25m",
        "no_neighbours_100m",
        "bag_construction_year",
        "bag_no_dwellings",
        F.round("fp_area", 6).alias("fp_area"),
        F.col("no_storeys").cast("bigint").alias("no_storeys"),
        "wall_area_lod1",
        "height_max_lod2",
    )
