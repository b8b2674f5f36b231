"""City model tiles in CityJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Boundaries are nested deeper for solids than for surfaces: kept as text until the type is known.
GEOMETRY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("lod", T.StringType()),
        T.StructField("boundaries", T.StringType()),
        T.StructField(
            "semantics",
            T.StructType(
                [
                    T.StructField(
                        "surfaces",
                        T.ArrayType(T.StructType([T.StructField("type", T.StringType())])),
                    ),
                    T.StructField("values", T.StringType()),
                ]
            ),
        ),
    ]
)
OBJECT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("parents", T.ArrayType(T.StringType())),
        T.StructField("geometry", T.ArrayType(GEOMETRY)),
    ]
)
TILE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField(
            "transform",
            T.StructType(
                [
                    T.StructField("scale", T.ArrayType(T.DoubleType())),
                    T.StructField("translate", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
        T.StructField("CityObjects", T.MapType(T.StringType(), OBJECT)),
        T.StructField("vertices", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)


# Kinds with faces: of surfaces, of a solid, of several solids.
SURFACES = ["MultiSurface", "CompositeSurface"]
SOLIDS = ["MultiSolid", "CompositeSolid"]
KINDS = ["Solid", *SURFACES, *SOLIDS]
#: Which kind counts where an object has several at one level of detail: a closed body before a set of faces.
RANKS = {"Solid": 0, **dict.fromkeys(SOLIDS, 1), **dict.fromkeys(SURFACES, 2)}


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """One row per tile file, with its path as ``tile``; ``path`` may be a folder or a pattern."""
    read = spark.read.schema(TILE).option("multiLine", True).json(path)
    return read.select("*", F.col("_metadata.file_path").alias("tile"))


def _faces(geometry: Column, vertices: Column, scale: Column, translate: Column) -> Column:
    def point(i: Column) -> Column:
        v = F.element_at(vertices, i + 1)
        return F.struct(
            *[
                (v[k] * F.coalesce(scale[k], F.lit(1.0)) + F.coalesce(translate[k], F.lit(0.0))).alias(a)
                for k, a in enumerate("xyz")
            ]
        )

    def closed(ring: Column) -> Column:
        # The one-element transform looks the points up once.
        return F.transform(F.array(F.transform(ring, point)), lambda p: F.concat(p, F.slice(p, 1, 1)))[0]

    # Each kind nests its faces, and their numbers, one level deeper than the one before.
    boundaries, values = geometry["boundaries"], geometry["semantics"]["values"]
    is_solid, is_many = geometry["type"] == "Solid", geometry["type"].isin(SOLIDS)
    surface = F.from_json(boundaries, "array<array<array<int>>>")
    solid = F.flatten(F.from_json(boundaries, "array<array<array<array<int>>>>"))
    many = F.flatten(F.flatten(F.from_json(boundaries, "array<array<array<array<array<int>>>>>")))
    rings = F.when(is_many, many).when(is_solid, solid).otherwise(surface)
    kinds = (
        F.when(is_many, F.flatten(F.flatten(F.from_json(values, "array<array<array<int>>>"))))
        .when(is_solid, F.flatten(F.from_json(values, "array<array<int>>")))
        .otherwise(F.from_json(values, "array<int>"))
    )
    # The one-element transform parses the numbers of the kinds once, not for every face.
    return F.transform(
        F.array(kinds),
        lambda numbers: F.transform(
            rings,
            lambda face, i: F.struct(
                F.get(geometry["semantics"]["surfaces"], F.get(numbers, i))["type"].alias("surface"),
                F.transform(face, closed).alias("rings"),
            ),
        ),
    )[0]


def other_geometries(tiles: DataFrame) -> DataFrame:
    """``(object_id, geometry_type, lod)`` of what :func:`tile_objects` does not read: points, lines, instances."""
    objects = tiles.select(F.explode("CityObjects").alias("object_id", "o"))
    shown = objects.select("object_id", F.explode("o.geometry").alias("g"))
    return shown.select("object_id", F.col("g.type").alias("geometry_type"), "g.lod").filter(
        F.coalesce(~F.col("geometry_type").isin(KINDS), F.lit(True))
    )


def tile_objects(tiles: DataFrame, lods: list[str] | None = None) -> DataFrame:
    """``(tile, object_id, type, parents, lod, geometry_type, geometry_no, faces)``: one row per object geometry.

    Vertex numbers become coordinates inside the tile row, ahead of the
    explode, so that the vertex list is not repeated for every object.
    ``lods`` picks levels of detail before that. ``geometry_no`` is the place of the
    geometry in its object. Kinds without faces are in :func:`other_geometries`.
    """

    def wanted(g: Column) -> Column:
        kind = g["type"].isin(KINDS)
        return kind if lods is None else kind & g["lod"].isin(lods)

    scale, translate = F.col("transform.scale"), F.col("transform.translate")
    objects = F.transform(
        F.map_entries("CityObjects"),
        lambda e: F.struct(
            e["key"].alias("object_id"),
            e["value"]["type"].alias("type"),
            e["value"]["parents"].alias("parents"),
            F.transform(
                F.filter(
                    F.transform(
                        F.coalesce(e["value"]["geometry"], F.array().cast(T.ArrayType(GEOMETRY))),
                        lambda g, i: F.struct(g.alias("g"), i.alias("i")),
                    ),
                    lambda x: wanted(x["g"]),
                ),
                lambda x: F.struct(
                    x["g"]["lod"].alias("lod"),
                    x["g"]["type"].alias("geometry_type"),
                    x["i"].alias("geometry_no"),
                    _faces(x["g"], F.col("vertices"), scale, translate).alias("faces"),
                ),
            ).alias("geometries"),
        ),
    )
    tile = F.col("tile") if "tile" in tiles.columns else F.lit("")
    exploded = tiles.select(tile.alias("tile"), F.explode(objects).alias("o"))
    return exploded.select(
        "tile", "o.object_id", "o.type", "o.parents", F.explode("o.geometries").alias("g")
    ).select("tile", "object_id", "type", "parents", "g.*")


GEOMETRY_KEY = ["object_id", "lod", "geometry_type", "geometry_no"]


def _content() -> Column:
    return F.xxhash64("type", "parents", "lod", "geometry_type", "geometry_no", "faces")


def merge_tiles(objects: DataFrame) -> DataFrame:
    """One model out of many tiles: an object found in several tiles counts once.

    It comes whole from the tile whose path sorts first, so that tiles that differ give
    the same model in whatever order they are read. Where one path holds an object
    twice, the smaller hash of its content counts. See :func:`tile_conflicts`.
    Tiles are read and shuffled once: of every geometry the first tile's is kept, and of
    these the ones of the object's first tile stay.
    """
    known = objects.filter("object_id is not null and tile is not null").repartition("object_id")
    rest = [c for c in objects.columns if c not in GEOMETRY_KEY]
    picked = known.groupBy(*GEOMETRY_KEY).agg(F.min_by(F.struct(*rest), F.struct("tile", _content())).alias("o"))
    owner = F.min("o.tile").over(Window.partitionBy("object_id"))
    own = picked.withColumn("owner", owner).filter(F.col("o.tile") == F.col("owner"))
    return own.select(*[c if c in GEOMETRY_KEY else f"o.{c}" for c in objects.columns])


def tile_conflicts(objects: DataFrame) -> DataFrame:
    """``(object_id, kept_tile, tiles, versions)`` of objects whose tiles differ about them."""
    told = objects.select("object_id", "tile", _content().alias("c")).distinct()
    versions = told.groupBy("object_id", "tile").agg(F.sort_array(F.collect_list("c")).alias("version"))
    return (
        versions.groupBy("object_id")
        .agg(
            F.min("tile").alias("kept_tile"),
            F.count(F.lit(1)).alias("tiles"),
            F.count_distinct("version").alias("versions"),
        )
        .filter("versions > 1")
    )


def _rank() -> Column:
    return F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col("geometry_type")]


def one_per_object(objects: DataFrame) -> DataFrame:
    """``(object_id, lod, faces)``: what stands for an object at a level of detail.

    Of several kinds of geometry the first by ``RANKS`` counts, so that a body is not
    measured together with the same faces given once more as surfaces; several
    geometries of that kind are parts of one object. See :func:`set_aside`.
    """
    parts = F.sort_array(F.collect_list(F.struct(_rank().alias("rank"), "geometry_no", "faces")))
    grouped = objects.groupBy("object_id", "lod").agg(parts.alias("parts"))
    first = F.filter("parts", lambda p: p["rank"] == F.col("parts")[0]["rank"])
    return grouped.select("object_id", "lod", F.flatten(F.transform(first, lambda p: p["faces"])).alias("faces"))


def set_aside(objects: DataFrame) -> DataFrame:
    """``(object_id, lod, geometry_type, geometry_no)`` of the geometries that ``one_per_object`` leaves out."""
    ranked = objects.select(*GEOMETRY_KEY, _rank().alias("rank"))
    best = ranked.groupBy("object_id", "lod").agg(F.min("rank").alias("best"))
    return ranked.join(best, ["object_id", "lod"]).filter("rank > best").select(*GEOMETRY_KEY)


def at_lod(objects: DataFrame, lod: str) -> DataFrame:
    return objects.filter(F.col("lod") == lod)
