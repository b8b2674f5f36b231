"""Stand-ins for the building tables, derived from the given tables.

Each one exists twice, as a DataFrame and as a SQL common table expression, so
that a query and its SQL twin start from the same rows.

``buildings``  footprints from ``part``: rectangles on a loose lattice
``pand``       building registry: the same ids with year, status and old versions
``units``      unit registry from ``lineitem``: arrays of buildings and purposes
``energy``     energy labels from ``lineitem``, one per unit
``cityobject``, ``building``, ``thematic_surface``, ``surface_geometry``,
``attributes`` the object tables and attribute rows of a 3D city database
``metrics``    per-part 3D metrics
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.functions import planar
from gevel.sources.tables import read_table, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def building_id(key: Column) -> Column:
    return F.concat(F.lit("NL.IMBAG.Pand."), F.lpad(key.cast("string"), 16, "0"))


def unit_number(order: Column, line: Column) -> Column:
    return F.concat(F.lpad(order.cast("string"), 12, "0"), F.lit("-"), line.cast("string"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles with the key columns of ``part`` beside them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    x0 = (k % 50) * 12.0 + (k * 7) % 3
    y0 = F.floor(k / 50) * 14.0 + (k * 5) % 4
    return spread(table(spark, sf_dir, "part")).select(
        building_id(k).alias("bag_id"),
        "p_partkey",
        "p_size",
        "p_retailprice",
        "p_name",
        x0.alias("minx"),
        y0.alias("miny"),
        (x0 + 8.0 + size % 5).alias("maxx"),
        (y0 + 10.0 + size % 5).alias("maxy"),
        (3.0 + size % 7).alias("height"),
    )


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select(
        "bag_id", planar.rectangle(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]).alias("rings")
    )


def pand(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    year = F.when(size == 13, 1005).otherwise(1900 + (k * 37) % 120).cast("int")
    current = boxes(spark, sf_dir).select(
        F.col("bag_id").alias("identificatie"),
        year.alias("oorspronkelijkbouwjaar"),
        F.when(size % 9 == 0, "Pand gesloopt").otherwise("Pand in gebruik").alias("status"),
        F.when(size == 27, F.lit("2020-01-01 00:00:00")).cast("timestamp_ntz").alias("eindgeldigheid"),
        planar.rectangle(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]).alias("rings"),
    )
    older = boxes(spark, sf_dir).filter("p_size % 10 = 5").select(
        F.col("bag_id").alias("identificatie"),
        (year - 10).cast("int").alias("oorspronkelijkbouwjaar"),
        F.lit("Pand in gebruik").alias("status"),
        F.lit("2010-01-01 00:00:00").cast("timestamp_ntz").alias("eindgeldigheid"),
        planar.rectangle(
            F.col("minx"), F.col("miny"), F.col("minx") + 1.0, F.col("miny") + 1.0
        ).alias("rings"),
    )
    return current.unionByName(older)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o, line = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    purpose = (
        F.when(o % 7 < 5, "woonfunctie").when(o % 7 == 5, "kantoorfunctie").otherwise("overige gebruiksfunctie")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("NL.IMBAG.Verblijfsobject."), unit_number(o, line)).alias("identificatie"),
        F.when(F.col("l_quantity") <= 5, "Verblijfsobject in gebruik")
        .otherwise("Verblijfsobject buiten gebruik")
        .alias("status"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("eindgeldigheid"),
        F.when(line == 7, F.lit(None).cast("array<string>"))
        .when(line == 4, F.array(building_id(k), building_id(k + 1)))
        .otherwise(F.array(building_id(k)))
        .alias("pandref"),
        F.when(F.col("l_suppkey") % 11 == 0, F.array(purpose, F.lit("winkelfunctie")))
        .otherwise(F.array(purpose))
        .alias("gebruiksdoel"),
    )


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, line = F.col("l_orderkey"), F.col("l_linenumber")
    kinds = [
        "Appartement",
        "Maisonnette",
        "Galerijwoning",
        "Portiekwoning",
        "Flatwoning (overig)",
        "Twee-onder-een-kap / rijwoning hoek",
    ]
    which = (o + line) % 8
    label = F.when(which.isin(0, 7), kinds[0])
    for i in range(1, 6):
        label = label.when(which == i, kinds[i])
    return (
        table(spark, sf_dir, "lineitem")
        .filter("l_returnflag = 'A' and l_quantity <= 5")
        .select(
            unit_number(o, line).alias("Pand_bagverblijfsobjectid"), label.alias("Pand_gebouwtype")
        )
    )


def cityobject(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return boxes(spark, sf_dir).select(
        F.col("p_partkey").alias("id"),
        F.col("bag_id").alias("gmlid"),
        F.when(size % 10 == 0, 25).otherwise(26).alias("objectclass_id"),
        F.when(size % 7 != 0, F.col("p_name")).alias("name"),
    )


def building(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return boxes(spark, sf_dir).select(
        F.col("p_partkey").alias("id"),
        F.when(size % 6 != 0, 1 + size % 4).alias("storeys_above_ground"),
        F.when(size % 8 != 0, F.col("p_partkey") * 10).alias("lod1_solid_id"),
    )


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roof and two walls per building, as horizontal rectangles."""
    j = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("j")
    return boxes(spark, sf_dir).select("*", j)


def thematic_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select(
        F.col("p_partkey").alias("building_id"),
        F.when(F.col("j") == 1, 33).otherwise(34).alias("objectclass_id"),
        (F.col("p_partkey") * 10 + F.col("j")).alias("lod2_multi_surface_id"),
    )


def surface_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.col("p_partkey") * 10 + F.col("j")
    return surfaces(spark, sf_dir).select(
        (root + 1_000_000_000).alias("id"),
        root.alias("root_id"),
        root.alias("parent_id"),
        (root + 1_000_000_000).alias("cityobject_id"),
        planar.rectangle(
            F.col("minx"), F.col("miny"), F.col("maxx") + F.col("j"), F.col("maxy")
        ).alias("rings"),
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute rows of buildings and of their surfaces."""
    size, h = F.col("p_size"), F.col("height")

    def attr(name: str, strval: Column | None = None, realval: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("attrname"),
            (F.lit(None) if strval is None else strval).cast("string").alias("strval"),
            (F.lit(None) if realval is None else realval).cast("double").alias("realval"),
        )

    kind = F.when(size % 4 == 0, "Vrijstaande woning").when(size % 4 == 1, "Hoekwoning").otherwise("Tussenwoning")
    of_building = boxes(spark, sf_dir).select(
        F.col("p_partkey").alias("cityobject_id"),
        F.explode(
            F.array(
                attr("dutch_building_type", kind),
                attr("lod2_volume", F.round(h * 100 + size, 2)),
                attr("val3dity_codes_lod12", F.when(size % 12 == 0, "[203]").otherwise("[]")),
                attr("h_dak_max", realval=h + 1.5),
                attr("h_dak_min", realval=h + 0.5),
                attr("h_maaiveld", realval=(size % 3) / 2.0),
                attr("h_dak_70p", realval=h + 1.0),
            )
        ).alias("a"),
    )
    of_surface = surfaces(spark, sf_dir).select(
        (F.col("p_partkey") * 10 + F.col("j") + 1_000_000_000).alias("cityobject_id"),
        attr("lod2_area", (h * 10 + F.col("j")).cast("string")).alias("a"),
    )
    return of_building.unionByName(of_surface).select("cityobject_id", "a.*")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per building part, without level-of-detail suffix."""
    w, d, z = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.col("height")
    size = F.col("p_size")
    ground = (size % 3) / 2.0
    return boxes(spark, sf_dir).select(
        F.concat("bag_id", F.lit("-0")).alias("id"),
        (w * d * z).alias("actual_volume"),
        (w * d * z * 1.25).alias("convex_hull_volume"),
        (2 * (w + d)).alias("footprint_perimeter"),
        F.least(w, d).alias("obb_width"),
        F.greatest(w, d).alias("obb_length"),
        (w * d).alias("ground_area"),
        F.when(size != 49, 2 * (w + d) * z).alias("wall_area"),
        (w * d).alias("roof_area"),
        F.lit(4).alias("ground_point_count"),
        (ground + z).alias("max_Z"),
        (ground + z * 0.75).alias("min_Z"),
        ground.cast("double").alias("ground_Z"),
        F.when(size == 50, 1).otherwise(0).alias("hole_count"),
        (z * (size % 5)).alias("shared_walls_area"),
        ((size % 11) / 4.0).alias("closest_distance"),
    )


ID = "('NL.IMBAG.Pand.' || lpad(cast(%s as varchar), 16, '0'))"
UNIT = "(lpad(cast(l_orderkey as varchar), 12, '0') || '-' || cast(l_linenumber as varchar))"

TABLES: dict[str, str] = {
    "boxes": f"""
        select bag_id, p_partkey, p_size, p_retailprice, p_name, x0 as minx, y0 as miny,
               x0 + 8.0 + p_size % 5 as maxx, y0 + 10.0 + p_size % 5 as maxy,
               cast(3.0 + p_size % 7 as double) as height
        from (select *, {ID % 'p_partkey'} as bag_id,
                     cast((p_partkey % 50) * 12 + (p_partkey * 7) % 3 as double) as x0,
                     cast((p_partkey // 50) * 14 + (p_partkey * 5) % 4 as double) as y0
              from part)""",
    "pand": """
        select bag_id as identificatie,
               case when p_size = 13 then 1005 else 1900 + (p_partkey * 37) % 120 end as oorspronkelijkbouwjaar,
               case when p_size % 9 = 0 then 'Pand gesloopt' else 'Pand in gebruik' end as status,
               case when p_size = 27 then timestamp '2020-01-01' end as eindgeldigheid,
               minx, miny, maxx, maxy
        from boxes
        union all
        select bag_id, case when p_size = 13 then 1005 else 1900 + (p_partkey * 37) % 120 end - 10,
               'Pand in gebruik', timestamp '2010-01-01', minx, miny, minx + 1.0, miny + 1.0
        from boxes where p_size % 10 = 5""",
    "units": f"""
        select 'NL.IMBAG.Verblijfsobject.' || {UNIT} as identificatie,
               case when l_quantity <= 5 then 'Verblijfsobject in gebruik'
                    else 'Verblijfsobject buiten gebruik' end as status,
               case when l_returnflag = 'R' then l_shipdate end as eindgeldigheid,
               case when l_linenumber = 7 then null
                    when l_linenumber = 4 then [{ID % 'l_partkey'}, {ID % 'l_partkey + 1'}]
                    else [{ID % 'l_partkey'}] end as pandref,
               case when l_suppkey % 11 = 0 then [purpose, 'winkelfunctie'] else [purpose] end as gebruiksdoel
        from (select *, case when l_orderkey % 7 < 5 then 'woonfunctie'
                             when l_orderkey % 7 = 5 then 'kantoorfunctie'
                             else 'overige gebruiksfunctie' end as purpose from lineitem)""",
    "energy": f"""
        select {UNIT} as Pand_bagverblijfsobjectid,
               case (l_orderkey + l_linenumber) % 8
                    when 0 then 'Appartement' when 7 then 'Appartement' when 1 then 'Maisonnette'
                    when 2 then 'Galerijwoning' when 3 then 'Portiekwoning'
                    when 4 then 'Flatwoning (overig)'
                    when 5 then 'Twee-onder-een-kap / rijwoning hoek' end as Pand_gebouwtype
        from lineitem where l_returnflag = 'A' and l_quantity <= 5""",
    "cityobject": """
        select p_partkey as id, bag_id as gmlid, case when p_size % 10 = 0 then 25 else 26 end as objectclass_id,
               case when p_size % 7 <> 0 then p_name end as name from boxes""",
    "building": """
        select p_partkey as id, case when p_size % 6 <> 0 then 1 + p_size % 4 end as storeys_above_ground,
               case when p_size % 8 <> 0 then p_partkey * 10 end as lod1_solid_id from boxes""",
    "surfaces": "select b.*, t.j from boxes b, (values (1), (2), (3)) t(j)",
    "thematic_surface": """
        select p_partkey as building_id, case when j = 1 then 33 else 34 end as objectclass_id,
               p_partkey * 10 + j as lod2_multi_surface_id from surfaces""",
    "surface_geometry": """
        select p_partkey * 10 + j + 1000000000 as id, p_partkey * 10 + j as root_id,
               p_partkey * 10 + j as parent_id, p_partkey * 10 + j + 1000000000 as cityobject_id,
               minx, miny, maxx + j as maxx, maxy from surfaces""",
    "attributes": """
        select p_partkey as cityobject_id, 'dutch_building_type' as attrname,
               case p_size % 4 when 0 then 'Vrijstaande woning' when 1 then 'Hoekwoning' else 'Tussenwoning' end as strval,
               cast(null as double) as realval from boxes
        union all select p_partkey, 'lod2_volume', cast(round(height * 100 + p_size, 2) as varchar), null from boxes
        union all select p_partkey, 'val3dity_codes_lod12',
               case when p_size % 12 = 0 then '[203]' else '[]' end, null from boxes
        union all select p_partkey, 'h_dak_max', null, height + 1.5 from boxes
        union all select p_partkey, 'h_dak_min', null, height + 0.5 from boxes
        union all select p_partkey, 'h_maaiveld', null, (p_size % 3) / 2.0 from boxes
        union all select p_partkey, 'h_dak_70p', null, height + 1.0 from boxes
        union all select p_partkey * 10 + j + 1000000000, 'lod2_area', cast(height * 10 + j as varchar), null
        from surfaces""",
    "metrics": """
        select bag_id || '-0' as id, w * d * z as actual_volume, w * d * z * 1.25 as convex_hull_volume,
               2 * (w + d) as footprint_perimeter, least(w, d) as obb_width, greatest(w, d) as obb_length,
               w * d as ground_area, case when p_size <> 49 then 2 * (w + d) * z end as wall_area,
               w * d as roof_area, 4 as ground_point_count, g + z as "max_Z", g + z * 0.75 as "min_Z",
               g as "ground_Z", case when p_size = 50 then 1 else 0 end as hole_count,
               z * (p_size % 5) as shared_walls_area, (p_size % 11) / 4.0 as closest_distance
        from (select *, maxx - minx as w, maxy - miny as d, height as z,
                     cast((p_size % 3) / 2.0 as double) as g from boxes)""",
    "solid": "select *, (p_size % 3) / 2.0 as z0 from boxes",
    # Derived tables shared by several twins.
    "unit_uses": """
        select pandid, list_sort(list_distinct(list(use))) as uses
        from (select pandid, unnest(gebruiksdoel) as use
              from (select unnest(pandref) as pandid, gebruiksdoel from units
                    where status like 'Verblijfsobject in gebruik%' and eindgeldigheid is null))
        group by pandid""",
    "functions": """
        select b.bag_id, uses,
               case when uses = ['woonfunctie'] then 'Residential'
                    when list_contains(uses, 'woonfunctie') then 'Mixed-residential'
                    when uses is not null and uses <> ['overige gebruiksfunctie'] and len(uses) = 1
                         then 'Non-residential (single-function)'
                    when uses is not null and uses <> ['overige gebruiksfunctie'] and len(uses) > 1
                         then 'Non-residential (multi-function)'
                    when uses = ['overige gebruiksfunctie'] then 'Others'
                    when uses is null then 'Unknown' end as bag_function
        from boxes b left join unit_uses u on b.bag_id = u.pandid""",
    "near": """
        select a.bag_id as a_id, b.bag_id as b_id,
               greatest(a.minx - b.maxx, b.minx - a.maxx, 0) as dx,
               greatest(a.miny - b.maxy, b.miny - a.maxy, 0) as dy
        from boxes a join boxes b on a.bag_id <> b.bag_id
         and a.minx - 1 <= b.maxx and b.minx <= a.maxx + 1
         and a.miny - 1 <= b.maxy and b.miny <= a.maxy + 1""",
    "adjacency": """
        select b.bag_id, b.bag_function, count(c.b_id) as n
        from functions b left join (
            select a_id, b_id from near
            join functions fa on fa.bag_id = a_id join functions fb on fb.bag_id = b_id
            where dx <= 0.1 and dy <= 0.1 and fa.bag_function not in ('Others', 'Unknown')
              and fb.bag_function not in ('Others', 'Unknown')) c on c.a_id = b.bag_id
        group by b.bag_id, b.bag_function""",
    "adjacency2": """
        select a.bag_id, a.bag_function, a.n, coalesce(max(b.n), 0) as nn
        from adjacency a left join near on near.a_id = a.bag_id and dx <= 0.1 and dy <= 0.1
        left join adjacency b on b.bag_id = near.b_id
        group by a.bag_id, a.bag_function, a.n""",
    "neighbours": """
        select a.bag_id,
               count(b.bag_id) filter (where hypot2 <= 25 * 25) as n25,
               count(b.bag_id) filter (where hypot2 <= 50 * 50) as n50,
               count(b.bag_id) filter (where hypot2 <= 75 * 75) as n75,
               count(b.bag_id) filter (where hypot2 <= 100 * 100) as n100
        from boxes a left join (
            select a.bag_id as a_id, b.bag_id,
                   pow(greatest(b.minx - (a.minx + a.maxx) / 2, 0, (a.minx + a.maxx) / 2 - b.maxx), 2)
                   + pow(greatest(b.miny - (a.miny + a.maxy) / 2, 0, (a.miny + a.maxy) / 2 - b.maxy), 2) as hypot2
            from boxes a join boxes b on a.bag_id <> b.bag_id) b on b.a_id = a.bag_id
        group by a.bag_id""",
    "area_adjacency": """
        select s.bag_id, count(b_id) as n from functions s join cityobject o on o.gmlid = s.bag_id
        left join (
            select a_id, b_id from near join functions fa on fa.bag_id = a_id join functions fb on fb.bag_id = b_id
            join cityobject ob on ob.gmlid = b_id
            where dx <= 0.1 and dy <= 0.1 and ob.objectclass_id = 26
              and fa.bag_function not in ('Others', 'Unknown')
              and fb.bag_function not in ('Others', 'Unknown')) on a_id = s.bag_id
        where o.objectclass_id = 26 group by 1""",
    "area_adjacency2": """
        select a.bag_id, a.n, coalesce(max(b.n), 0) as nn from area_adjacency a
        left join near on a_id = a.bag_id and dx <= 0.1 and dy <= 0.1
        left join area_adjacency b on b.bag_id = b_id group by a.bag_id, a.n""",
    "study_fp": """
        select c.*, o.gmlid as bag_id from current_fp c join cityobject o on o.gmlid = c.identificatie
        where objectclass_id = 26 and name is not null""",
    "study_near": """
        select a.bag_id as a_id, b.bag_id as b_id
        from study_fp a join study_fp b on a.bag_id <> b.bag_id
         and a.minx - 0.1 <= b.maxx and b.minx <= a.maxx + 0.1
         and a.miny - 0.1 <= b.maxy and b.miny <= a.maxy + 0.1""",
    "study_adjacency": """
        select s.bag_id, count(b_id) as n from study_fp s left join (
            select a_id, b_id from study_near join functions fa on fa.bag_id = a_id
            join functions fb on fb.bag_id = b_id
            where fa.bag_function not in ('Others', 'Unknown') and fb.bag_function not in ('Others', 'Unknown'))
        on a_id = s.bag_id group by 1""",
    "study_adjacency2": """
        select a.bag_id, a.n, coalesce(max(b.n), 0) as nn from study_adjacency a
        left join study_near on a_id = a.bag_id left join study_adjacency b on b.bag_id = b_id
        group by a.bag_id, a.n""",
    "study_neighbours": """
        select a.bag_id, count(b_id) filter (where d2 <= 625) as n25, count(b_id) as n100
        from study_fp a left join (
            select a.bag_id as a_id, b.bag_id as b_id,
                   pow(greatest(b.minx - (a.minx + a.maxx) / 2, 0, (a.minx + a.maxx) / 2 - b.maxx), 2)
                   + pow(greatest(b.miny - (a.miny + a.maxy) / 2, 0, (a.miny + a.maxy) / 2 - b.maxy), 2) as d2
            from study_fp a join study_fp b on a.bag_id <> b.bag_id) on a_id = a.bag_id and d2 <= 10000
        group by 1""",
    "dwellings": """
        select pandid, count(distinct identificatie) as bag_no_dwellings
        from (select unnest(pandref) as pandid, identificatie from units
              where status like 'Verblijfsobject in gebruik%' and eindgeldigheid is null)
        group by pandid""",
    "years": """
        select identificatie, case when year <> 1005 then year end as bag_construction_year
        from (select identificatie,
                     arg_max(oorspronkelijkbouwjaar, case when eindgeldigheid is null then timestamp '9999-01-01'
                             else eindgeldigheid end) as year
              from pand group by identificatie)""",
    "current_fp": """
        select identificatie, minx, miny, maxx, maxy from (
            select *, row_number() over (partition by identificatie
                   order by case when eindgeldigheid is null then timestamp '9999-01-01' else eindgeldigheid end desc) as r
            from pand) where r = 1""",
    "labels_ep": """
        select pandid as bag_id, count(*) as n_labels, label, count(*) as n
        from (select unnest(pandref) as pandid, Pand_gebouwtype as label
              from energy join units on 'NL.IMBAG.Verblijfsobject.' || Pand_bagverblijfsobjectid = identificatie
              where status like 'Verblijfsobject in gebruik%' and eindgeldigheid is null)
        join pand on pandid = pand.identificatie
        where pand.status like 'Pand in gebruik%' and pand.eindgeldigheid is null
        group by pandid, label""",
    "classed": """
        select a.bag_id, a.p_partkey, a.n, a.nn,
               (maxx - minx) * (maxy - miny) as fp_area, 2 * (maxx - minx + maxy - miny) as fp_perimeter,
               cast(n25 as double) as no_neighbours_25m, p_retailprice as price,
               case when pred = base then base when pred is null then base else pred end as building_type
        from (select q.*, b.p_partkey, b.p_retailprice, b.minx, b.miny, b.maxx, b.maxy,
                     case when n = 0 then 'detached' when n = 1 and nn = 1 then 'semi'
                          when n = 1 then 'end' else 'terraced' end as base,
                     case when b.p_partkey % 10 = 3 then
                          case when n = 0 then 'semi' when n = 1 and nn = 1 then 'end'
                               when n = 1 then 'terraced' else 'detached' end end as pred
              from (select a.bag_id, a.n, coalesce(max(b.n), 0) as nn
                    from raw_adjacency a left join near on near.a_id = a.bag_id and dx <= 0.1 and dy <= 0.1
                    left join raw_adjacency b on b.bag_id = near.b_id group by a.bag_id, a.n) q
              join boxes b using (bag_id)) a
        join neighbours using (bag_id)""",
    "raw_adjacency": """
        select b.bag_id, count(b_id) as n from boxes b
        left join near on near.a_id = b.bag_id and dx <= 0.1 and dy <= 0.1 group by b.bag_id""",
    "guessed": """
        select bag_id, building_type as label,
               case when n = 0 then 'detached' when n = 1 then 'semi' else 'terraced' end as prediction
        from classed""",
}


def sql_with(body: str) -> str:
    """Prefix ``body`` with the stand-in tables it uses."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"(?<![\w.']){name}\b(?!\()", text):
                visit(TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} as ({TABLES[n]})" for n in needed)
    body = body.strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
