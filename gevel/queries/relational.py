"""Scans, filters, joins, arrays and scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.functions import labels, scalars
from gevel.operators import lookup
from gevel.plans import extraction, groundtruth
from gevel.queries import standins as S
from gevel.queries.registry import query
from gevel.session import scratch_dir
from gevel.sources import attributes as eav
from gevel.sources import metrics_csv, tables

LONG = "bigint"


def joined(values: str) -> F.Column:
    """An array of strings as one comparable text."""
    return F.concat_ws(",", values)


def metrics_file(spark, d) -> DataFrame:
    """Stand-in metrics, written to a wider CSV in another column order and read back."""
    path = scratch_dir(spark, "metrics")
    t = S.metrics(spark, d)
    more = [F.lit("2.2").alias("lod"), *[F.col(c) for c in reversed(t.columns)], F.lit(1.5).alias("unknown")]
    tables.write_csv(t.select(*more), path)
    return metrics_csv.read_metrics(spark, path)


@query(
    "io1_metrics_csv",
    "select id, round(actual_volume, 6) as actual_volume, wall_area, cast(hole_count as bigint) as hole_count from metrics",
)
def _(spark, d):
    return metrics_file(spark, d).select(
        "id",
        F.round("actual_volume", 6).alias("actual_volume"),
        "wall_area",
        F.col("hole_count").cast(LONG).alias("hole_count"),
    )


@query("io2_table_scan", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def _(spark, d):
    return S.table(spark, d, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )


@query(
    "io5_attribute_scan",
    "select cityobject_id, strval as dutch_building_type from attributes where attrname = 'dutch_building_type'",
)
def _(spark, d):
    return eav.attribute(S.attributes(spark, d), "dutch_building_type")


@query(
    "io5_attributes_wide",
    """select cityobject_id, max(realval) filter (where attrname = 'h_dak_max') as h_dak_max,
              max(realval) filter (where attrname = 'h_dak_min') as h_dak_min,
              max(realval) filter (where attrname = 'h_maaiveld') as h_maaiveld
       from attributes where attrname in ('h_dak_max', 'h_dak_min', 'h_maaiveld') group by 1""",
)
def _(spark, d):
    return eav.attributes_wide(S.attributes(spark, d), ["h_dak_max", "h_dak_min", "h_maaiveld"])


@query("io6_table_sink", "select identificatie, status, oorspronkelijkbouwjaar from pand")
def _(spark, d):
    path = scratch_dir(spark, "sink")
    out = S.pand(spark, d).select("identificatie", "status", "oorspronkelijkbouwjaar")
    tables.write_table(out.limit(0), path)
    tables.write_table(out, path)
    return tables.read_table(spark, path, out.schema)


@query("io7_publish", "select gmlid as bag_id, objectclass_id from cityobject")
def _(spark, d):
    root = scratch_dir(spark, "published")
    first = S.cityobject(spark, d).select(F.col("gmlid").alias("bag_id"))
    tables.publish(first, root, key="bag_id")
    objects = S.cityobject(spark, d).select(F.col("gmlid").alias("bag_id"), "objectclass_id")
    tables.publish(objects, root, key="bag_id")
    return tables.read_published(spark, root)


@query("p1_column_subset", "select id, \"max_Z\", \"ground_Z\", obb_width from metrics")
def _(spark, d):
    return S.metrics(spark, d).select("id", "max_Z", "ground_Z", "obb_width")


@query(
    "p2_suffix_rename",
    'select id, "max_Z" as "max_Z_lod1", roof_area as roof_area_lod1 from metrics',
)
def _(spark, d):
    sub = S.metrics(spark, d).select("id", "max_Z", "roof_area")
    return lookup.add_suffix(sub, "lod1", keep=["id"])


@query(
    "p3_assign_column",
    """select b.bag_id, y.bag_construction_year
       from boxes b left join years y on y.identificatie = b.bag_id""",
)
def _(spark, d):
    table = S.buildings(spark, d).select("bag_id")
    return extraction.construction_year(table, S.pand(spark, d))


@query("p4_drop_if_present", "select id, obb_width from metrics")
def _(spark, d):
    kept = S.metrics(spark, d).select("id", "obb_width", "ground_area", "hole_count")
    return kept.drop("ground_area", "hole_count", "no_such_column")


@query("p5_drop_required", "select id, obb_width from metrics")
def _(spark, d):
    kept = S.metrics(spark, d).select("id", "obb_width", "ground_area", "hole_count")
    return lookup.drop_required(kept, ["ground_area", "hole_count"])


@query(
    "p6_rename_label",
    "select cityobject_id, strval as building_type from attributes where attrname = 'dutch_building_type'",
)
def _(spark, d):
    from gevel.plans.cleaning import swap_label

    rows = eav.attribute(S.attributes(spark, d), "dutch_building_type")
    return swap_label(
        rows.withColumnRenamed("dutch_building_type", "building_type2").withColumn(
            "building_type", F.lit(None).cast("array<string>")
        )
    )


@query("p7_closed_only", "select id from metrics where hole_count = 0")
def _(spark, d):
    return metrics_csv.import_metrics(S.metrics(spark, d), "lod1").select("id")


@query(
    "p8_prefix",
    """select status, count(*) as n from units where status like 'Verblijfsobject in gebruik%' group by 1""",
)
def _(spark, d):
    used = S.units(spark, d).filter(F.col("status").startswith(labels.UNIT_IN_USE))
    return used.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p9_infix",
    """select Pand_gebouwtype like '%/%' as shared, count(*) as n from energy
       where Pand_gebouwtype like '%/%' or Pand_gebouwtype not like '%/%' group by 1""",
)
def _(spark, d):
    shared = F.col("Pand_gebouwtype").contains("/")
    both = S.energy(spark, d).filter(shared | ~shared)
    return both.groupBy(shared.alias("shared")).agg(F.count(F.lit(1)).alias("n"))


@query("p10_still_valid", "select identificatie, status from units where eindgeldigheid is null")
def _(spark, d):
    return S.units(spark, d).filter(F.col("eindgeldigheid").isNull()).select("identificatie", "status")


@query(
    "p11_study_buildings",
    """select gmlid as bag_id from cityobject where objectclass_id = 26 and name is not null
       and gmlid <> 'NL.IMBAG.Pand.0150100000059983'""",
)
def _(spark, d):
    return groundtruth.study_buildings(S.cityobject(spark, d))


@query(
    "p12_residential_only",
    """select bag_id, case when bag_function = 'Unknown' then null else bag_function end as bag_function
       from functions where bag_function in ('Residential', 'Mixed-residential', 'Unknown')""",
)
def _(spark, d):
    table = extraction.building_function(S.buildings(spark, d).select("bag_id"), S.units(spark, d))
    table = table.withColumn("bag_function", F.nullif("bag_function", F.lit("Unknown")))
    return extraction.residential_only(table)


@query("p13_drop_incomplete", "select id, wall_area from metrics where wall_area is not null and \"max_Z\" is not null")
def _(spark, d):
    return lookup.drop_incomplete(S.metrics(spark, d), ["wall_area", "max_Z"]).select("id", "wall_area")


@query(
    "p14_sentinel",
    "select identificatie, nullif(oorspronkelijkbouwjaar, 1005) as year from pand",
)
def _(spark, d):
    year = scalars.sentinel_to_null(F.col("oorspronkelijkbouwjaar"), extraction.UNKNOWN_YEAR)
    return S.pand(spark, d).select("identificatie", year.alias("year"))


@query(
    "p15_guarded_zero",
    """select p.p_partkey, case when c.n is null and p.name is not null then 0 else c.n end as n
       from (select p_partkey, nullif(p_size % 7, 0) as name from part) p
       left join (select l_partkey, count(*) as n from lineitem where l_quantity <= 3 group by 1) c
       on c.l_partkey = p.p_partkey""",
)
def _(spark, d):
    counts = (
        S.table(spark, d, "lineitem")
        .filter("l_quantity <= 3")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parts = S.table(spark, d, "part").select(
        "p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).alias("name")
    )
    filled = lookup.assign_from(parts, counts, "p_partkey")
    return filled.select("p_partkey", scalars.zero_if_present(F.col("n"), F.col("name")).alias("n"))


@query(
    "p18_listed_ids",
    """select b.bag_id, case when b.p_size in (1, 2, 4) then round((maxx - minx) * (maxy - miny) * height, 6) end as volume
       from boxes b""",
)
def _(spark, d):
    volume = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) * F.col("height")
    return S.boxes(spark, d).select(
        "bag_id", F.when(F.col("p_size").isin(1, 2, 4), F.round(volume, 6)).alias("volume")
    )


@query(
    "j1_lookup_keep_old",
    """select b.bag_id, case when o.gmlid is not null then o.name else b.p_name || '!' end as name
       from boxes b left join (select gmlid, name from cityobject where objectclass_id = 26) o
       on o.gmlid = b.bag_id""",
)
def _(spark, d):
    target = S.boxes(spark, d).select("bag_id", F.concat("p_name", F.lit("!")).alias("name"))
    source = S.cityobject(spark, d).filter("objectclass_id = 26")
    return lookup.assign_from(
        target, source.select(F.col("gmlid").alias("bag_id"), "name"), "bag_id", order=[F.col("name")]
    )


@query(
    "j2_equi_join",
    "select gmlid, strval from cityobject o join attributes a on o.id = a.cityobject_id where attrname = 'lod2_volume'",
)
def _(spark, d):
    found = eav.by_object(
        S.cityobject(spark, d), eav.attribute(S.attributes(spark, d), "lod2_volume")
    )
    return found.select(F.col("bag_id").alias("gmlid"), F.col("lod2_volume").alias("strval"))


@query(
    "j3_three_tables",
    """select gmlid, count(*) as n from cityobject o join thematic_surface t on o.id = t.building_id
       join surface_geometry g on g.root_id = t.lod2_multi_surface_id
       where t.objectclass_id = 34 group by 1""",
)
def _(spark, d):
    walls = S.thematic_surface(spark, d).filter("objectclass_id = 34")
    geometry = S.surface_geometry(spark, d).select(F.col("root_id").alias("lod2_multi_surface_id"))
    pairs = S.cityobject(spark, d).join(walls, F.col("id") == F.col("building_id"))
    return pairs.join(geometry, "lod2_multi_surface_id").groupBy("gmlid").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "j4_four_tables",
    """select gmlid, count(strval) as n from cityobject o join thematic_surface t on o.id = t.building_id
       join surface_geometry g on g.parent_id = t.lod2_multi_surface_id
       join attributes a on a.cityobject_id = g.cityobject_id
       where a.attrname = 'lod2_area' group by 1""",
)
def _(spark, d):
    geometry = S.surface_geometry(spark, d).select(
        F.col("parent_id").alias("lod2_multi_surface_id"), "cityobject_id"
    )
    areas = eav.attribute(S.attributes(spark, d), "lod2_area")
    return (
        S.cityobject(spark, d)
        .select("id", "gmlid")
        .join(S.thematic_surface(spark, d), F.col("id") == F.col("building_id"))
        .join(geometry, "lod2_multi_surface_id")
        .join(areas, "cityobject_id")
        .groupBy("gmlid")
        .agg(F.count("lod2_area").alias("n"))
    )


@query(
    "j5_constructed_key",
    """select bag_id, label, count(*) as n
       from (select unnest(pandref) as bag_id, Pand_gebouwtype as label
             from energy join units on 'NL.IMBAG.Verblijfsobject.' || Pand_bagverblijfsobjectid = identificatie
             where status like 'Verblijfsobject in gebruik%' and eindgeldigheid is null)
       join pand on bag_id = pand.identificatie
       where pand.status like 'Pand in gebruik%' and pand.eindgeldigheid is null
       group by 1, 2""",
)
def _(spark, d):
    held = groundtruth.labelled_units(S.energy(spark, d), S.units(spark, d), S.pand(spark, d))
    return held.select("bag_id", "label", "n")


@query(
    "j6_truncated_key",
    """select b.bag_id, m.roof_area from boxes b join metrics m on left(m.id, -2) = b.bag_id""",
)
def _(spark, d):
    m = S.metrics(spark, d).select(
        scalars.drop_trailing(F.col("id"), 2).alias("bag_id"), "roof_area"
    )
    return S.buildings(spark, d).select("bag_id").join(m, "bag_id")


@query(
    "j7_right_join",
    """select v.bag_id, s.id as solid_id
       from (select o.gmlid as bag_id, b.id from cityobject o join building b on o.id = b.id
             where b.lod1_solid_id is not null) s
       right join (select o.gmlid as bag_id from cityobject o join attributes a on o.id = a.cityobject_id
                   where attrname = 'val3dity_codes_lod12' and strval = '[]') v on s.bag_id = v.bag_id""",
)
def _(spark, d):
    solids = (
        S.cityobject(spark, d)
        .join(S.building(spark, d).filter("lod1_solid_id is not null"), "id")
        .select(F.col("gmlid").alias("bag_id"), F.col("id").alias("solid_id"))
    )
    codes = eav.by_object(
        S.cityobject(spark, d), eav.attribute(S.attributes(spark, d), "val3dity_codes_lod12")
    )
    valid = codes.filter("val3dity_codes_lod12 = '[]'").select("bag_id")
    return solids.join(valid, "bag_id", "right")


@query("j8_same_row", "select bag_id, greatest(maxx - minx, maxy - miny) as longest from boxes")
def _(spark, d):
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return S.boxes(spark, d).select("bag_id", F.greatest(w, h).alias("longest"))


@query("j12_flatten", "select identificatie, unnest(pandref) as bag_id from units")
def _(spark, d):
    return lookup.flatten(S.units(spark, d), "pandref", "bag_id").select("identificatie", "bag_id")


@query(
    "j13_double_flatten",
    """select bag_id, unnest(gebruiksdoel) as use, identificatie
       from (select identificatie, unnest(pandref) as bag_id, gebruiksdoel from units)""",
)
def _(spark, d):
    once = lookup.flatten(S.units(spark, d), "pandref", "bag_id")
    return lookup.flatten(once, "gebruiksdoel", "use").select("bag_id", "use", "identificatie")


@query("a1_count", "select l_partkey, count(*) as n from lineitem group by 1")
def _(spark, d):
    return S.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("a2_count_distinct", "select pandid as bag_id, bag_no_dwellings from dwellings")
def _(spark, d):
    units = lookup.flatten(extraction.units_in_use(S.units(spark, d)), "pandref", "bag_id")
    return units.groupBy("bag_id").agg(F.count_distinct("identificatie").alias("bag_no_dwellings"))


@query("a4_sum_cast", "select cityobject_id // 10 as k, sum(cast(strval as double)) as total from attributes where attrname = 'lod2_area' group by 1")
def _(spark, d):
    areas = eav.attribute(S.attributes(spark, d), "lod2_area")
    return areas.groupBy(F.floor(F.col("cityobject_id") / 10).alias("k")).agg(
        F.sum(scalars.parse_double(F.col("lod2_area"))).alias("total")
    )


@query("a5_distinct_array", "select pandid as bag_id, array_to_string(uses, ',') as uses from unit_uses")
def _(spark, d):
    return extraction.purposes(S.units(spark, d)).select("bag_id", joined("uses").alias("uses"))


@query(
    "a6_array_with_nulls",
    """select bag_id, cast(sum(n) as bigint) as size, string_agg(coalesce(label, '?') || '=' || n, ',' order by label nulls first) as labels
       from labels_ep group by bag_id""",
)
def _(spark, d):
    held = groundtruth.register_labels(S.energy(spark, d), S.units(spark, d), S.pand(spark, d))
    text = F.transform(
        "building_type",
        lambda e: F.concat(F.coalesce(e["value"], F.lit("?")), F.lit("="), e["n"].cast("string")),
    )
    return held.select(
        "bag_id",
        lookup.counted_size(F.col("building_type")).alias("size"),
        F.concat_ws(",", text).alias("labels"),
    )


@query(
    "a7_single_member_groups",
    """select bag_id, any_value(label) as label from labels_ep group by bag_id having sum(n) = 1""",
)
def _(spark, d):
    held = groundtruth.register_labels(S.energy(spark, d), S.units(spark, d), S.pand(spark, d))
    one = held.filter(lookup.counted_size(F.col("building_type")) == 1)
    return one.select("bag_id", F.col("building_type")[0]["value"].alias("label"))


@query("a8_class_counts", "select Pand_gebouwtype as label, count(*) as n from energy where Pand_gebouwtype is not null group by 1")
def _(spark, d):
    from gevel.plans.analysis import class_distribution

    return class_distribution(S.energy(spark, d), "Pand_gebouwtype").withColumnRenamed(
        "Pand_gebouwtype", "label"
    )


@query(
    "s1_sorted_output",
    "select bag_id, name from (select gmlid as bag_id, name from cityobject) order by bag_id",
)
def _(spark, d):
    return S.cityobject(spark, d).select(F.col("gmlid").alias("bag_id"), "name").orderBy("bag_id")


@query("s3_first_rows", "select id, round(actual_volume, 6) as actual_volume from metrics order by id limit 50")
def _(spark, d):
    return S.metrics(spark, d).orderBy("id").limit(50).select("id", F.round("actual_volume", 6).alias("actual_volume"))


@query("u2_distinct", "select distinct status, eindgeldigheid is null as current from pand")
def _(spark, d):
    return S.pand(spark, d).select(
        "status", F.col("eindgeldigheid").isNull().alias("current")
    ).distinct()


@query("f1_drop_trailing", "select id, left(id, -2) as key from metrics")
def _(spark, d):
    return S.metrics(spark, d).select("id", scalars.drop_trailing(F.col("id"), 2).alias("key"))


@query("f1_part_suffix", "select id, regexp_replace(id, '-[0-9]+$', '') as key from metrics")
def _(spark, d):
    return S.metrics(spark, d).select("id", scalars.part_suffix(F.col("id")).alias("key"))


@query(
    "f2_concat",
    "select 'NL.IMBAG.Verblijfsobject.' || Pand_bagverblijfsobjectid as id, Pand_gebouwtype || '.' as t from energy",
)
def _(spark, d):
    return S.energy(spark, d).select(
        F.concat(F.lit(labels.UNIT_PREFIX), F.col("Pand_bagverblijfsobjectid")).alias("id"),
        F.concat("Pand_gebouwtype", F.lit(".")).alias("t"),
    )


@query(
    "f3_like",
    """select count(*) filter (where Pand_gebouwtype like '%woning%') as woning,
              count(*) filter (where Pand_gebouwtype not like 'Flat%') as no_flat from energy""",
)
def _(spark, d):
    t = F.col("Pand_gebouwtype")
    return S.energy(spark, d).agg(
        F.count_if(t.like("%woning%")).alias("woning"), F.count_if(~t.like("Flat%")).alias("no_flat")
    )


@query(
    "f4_text_to_double",
    """select cityobject_id, attrname, try_cast(strval as double) as number from attributes where strval is not null""",
)
def _(spark, d):
    rows = S.attributes(spark, d).filter("strval is not null")
    number = scalars.parse_double(F.col("strval"), strict=False)
    return rows.select("cityobject_id", "attrname", number.alias("number"))


@query("f5_function_class", "select array_to_string(uses, ',') as uses, bag_function, count(*) as n from functions group by all")
def _(spark, d):
    table = lookup.assign_from(
        S.buildings(spark, d).select("bag_id"), extraction.purposes(S.units(spark, d)), "bag_id"
    )
    text = F.when(F.col("uses").isNotNull(), joined("uses")).alias("uses")
    return table.groupBy(text, labels.function_class(F.col("uses")).alias("bag_function")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "f6_longer_shorter",
    "select bag_id, greatest(maxx - minx, maxy - miny) as length, least(maxx - minx, maxy - miny) as width from boxes",
)
def _(spark, d):
    one, two = F.col("maxy") - F.col("miny"), F.col("maxx") - F.col("minx")
    return S.boxes(spark, d).select(
        "bag_id", F.greatest(one, two).alias("length"), F.least(one, two).alias("width")
    )


@query(
    "f8_f11_array_tests",
    """select identificatie, gebruiksdoel = ['woonfunctie'] as only_dwelling,
              list_contains(gebruiksdoel, 'woonfunctie') as some_dwelling,
              len(list_filter(gebruiksdoel, lambda e: e <> 'woonfunctie')) > 0 as some_other,
              len(pandref) as buildings,
              len(list_filter(gebruiksdoel, lambda e: e = 'winkelfunctie')) as shops
       from units""",
)
def _(spark, d):
    uses = F.col("gebruiksdoel")
    return S.units(spark, d).select(
        "identificatie",
        (uses == F.array(F.lit(labels.DWELLING))).alias("only_dwelling"),
        F.array_contains(uses, labels.DWELLING).alias("some_dwelling"),
        scalars.any_differs(uses, labels.DWELLING).alias("some_other"),
        F.cardinality("pandref").cast(LONG).alias("buildings"),
        scalars.occurrences(uses, "winkelfunctie").cast(LONG).alias("shops"),
    )


@query(
    "f12_occurrences",
    """select bag_id, cast(coalesce(sum(n) filter (where label = 'Appartement'), 0) as bigint) as appartement,
              cast(coalesce(sum(n) filter (where label = 'Galerijwoning'), 0) as bigint) as galerijwoning
       from labels_ep group by bag_id""",
)
def _(spark, d):
    held = groundtruth.register_labels(S.energy(spark, d), S.units(spark, d), S.pand(spark, d))
    t = F.col("building_type")
    return held.select(
        "bag_id",
        lookup.counted_of(t, labels.APARTMENT).alias("appartement"),
        lookup.counted_of(t, labels.GALLERY).alias("galerijwoning"),
    )


@query(
    "f13_arithmetic",
    """select id, "max_Z" - "ground_Z" as height_max, "min_Z" - "ground_Z" as height_min_roof,
              obb_width * obb_length as area_check from metrics""",
)
def _(spark, d):
    return S.metrics(spark, d).select(
        "id",
        (F.col("max_Z") - F.col("ground_Z")).alias("height_max"),
        (F.col("min_Z") - F.col("ground_Z")).alias("height_min_roof"),
        (F.col("obb_width") * F.col("obb_length")).alias("area_check"),
    )


@query(
    "f14_canonical_label",
    """select cityobject_id, case strval when 'Vrijstaande woning' then 'Vrijstaande Woning' else strval end as label
       from attributes where attrname = 'dutch_building_type'""",
)
def _(spark, d):
    rows = eav.attribute(S.attributes(spark, d), "dutch_building_type")
    return rows.select(
        "cityobject_id", labels.canonical_label(F.col("dutch_building_type")).alias("label")
    )


@query(
    "f15_json_text",
    """select cityobject_id from attributes where attrname = 'val3dity_codes_lod12' and strval = '[]'""",
)
def _(spark, d):
    codes = eav.attribute(S.attributes(spark, d), "val3dity_codes_lod12")
    return codes.filter("val3dity_codes_lod12 = '[]'").select("cityobject_id")
