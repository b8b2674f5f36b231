"""Stand-in solids: each footprint raised to a box or to a shed with a sloping roof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gevel.functions.solids import GROUND, ROOF, WALL
from gevel.queries.standins import boxes
from gevel.session import scratch_dir

TILE_SIZE = 40


def _base(spark, d) -> DataFrame:
    size = F.col("p_size")
    return boxes(spark, d).select(
        "*",
        F.concat("bag_id", F.lit("-0")).alias("id"),
        ((size % 3) / 2.0).alias("z0"),
        (size % 4 / 2.0).alias("slope"),
    )


def _corners(rise: Column) -> Column:
    """Eight corners: the ground ring, then the roof ring, higher along the upper side."""
    z0, z1 = F.col("z0"), F.col("z0") + F.col("height")
    xy = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy")]

    def point(x, y, z):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"), z.cast("double").alias("z"))

    low = [point(x, y, z0) for x, y in xy]
    high = [point(x, y, z1 + (rise if y == "maxy" else F.lit(0.0))) for x, y in xy]
    return F.array(*low, *high)


# Corner numbers of each face, seen from outside, and what it is.
SHELL = [
    ([0, 3, 2, 1], GROUND),
    ([0, 1, 5, 4], WALL),
    ([1, 2, 6, 5], WALL),
    ([2, 3, 7, 6], WALL),
    ([3, 0, 4, 7], WALL),
    ([4, 5, 6, 7], ROOF),
]


def _faces(corners: Column) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(kind).alias("surface"),
                F.array(F.array(*[corners[i] for i in ring + ring[:1]])).alias("rings"),
            )
            for ring, kind in SHELL
        ]
    )


def box_solids(spark, d, sloped: bool = False) -> DataFrame:
    """``(id, faces)``, flat or sloping."""
    rise = F.col("slope") if sloped else F.lit(0.0)
    cornered = _base(spark, d).select("id", "bag_id", "p_partkey", "p_size", _corners(rise).alias("c"))
    return cornered.select("id", "bag_id", "p_partkey", "p_size", _faces(F.col("c")).alias("faces"))


def write_tiles(spark, d) -> str:
    """The solids at two levels of detail as CityJSON, one file per tile of few buildings."""
    corners = _base(spark, d).select(
        (F.floor(F.col("p_partkey") / TILE_SIZE)).alias("tile"),
        "bag_id",
        "id",
        F.concat(_corners(F.lit(0.0)), _corners(F.col("slope"))).alias("c"),
    )
    # Whole numbers of centimetres, as the format wants.
    grouped = corners.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("bag_id", "id", "c"))).alias("b"))

    def boundary(k: Column, shift: int) -> Column:
        return F.array(
            F.array(
                *[
                    F.array(F.array(*[(k * 16 + shift + i).cast("int") for i in ring]))
                    for ring, _ in SHELL
                ]
            )
        )

    def geometry(k: Column, lod: str, shift: int) -> Column:
        kinds = [GROUND, WALL, ROOF]
        return F.struct(
            F.lit("Solid").alias("type"),
            F.lit(lod).alias("lod"),
            boundary(k, shift).alias("boundaries"),
            F.struct(
                F.array(*[F.struct(F.lit(t).alias("type")) for t in kinds]).alias("surfaces"),
                F.array(F.array(*[F.lit(kinds.index(t)) for _, t in SHELL])).alias("values"),
            ).alias("semantics"),
        )

    # First the building, which has no solid of its own, then its part.
    entries = F.flatten(
        F.transform(
            "b",
            lambda b, k: F.array(
                F.struct(
                    b["bag_id"].alias("k"),
                    F.struct(
                        F.lit("Building").alias("type"),
                        F.array().cast("array<string>").alias("parents"),
                        F.slice(F.array(geometry(k, "1.2", 0)), 1, 0).alias("geometry"),
                    ).alias("v"),
                ),
                F.struct(
                    b["id"].alias("k"),
                    F.struct(
                        F.lit("BuildingPart").alias("type"),
                        F.array(b["bag_id"]).alias("parents"),
                        F.array(geometry(k, "1.2", 0), geometry(k, "2.2", 8)).alias("geometry"),
                    ).alias("v"),
                ),
            ),
        )
    )
    vertices = F.transform(
        F.flatten(F.transform("b", lambda b: b["c"])),
        lambda p: F.array(*[F.round(p[a] * 100).cast("long") for a in "xyz"]),
    )
    scale, shift = F.array(*[F.lit(0.01)] * 3), F.array(*[F.lit(0.0)] * 3)
    doc = F.to_json(
        F.struct(
            F.lit("CityJSON").alias("type"),
            F.lit("1.0").alias("version"),
            F.struct(scale.alias("scale"), shift.alias("translate")).alias("transform"),
            F.map_from_entries(entries).alias("CityObjects"),
            vertices.alias("vertices"),
        )
    )
    path = scratch_dir(spark, "tiles")
    grouped.select(doc.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path
