"""3D metrics per building part, as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.operators.lookup import add_suffix

# Metric columns and their types.
METRICS = {
    "id": "string",
    "actual_volume": "double",
    "convex_hull_volume": "double",
    "footprint_perimeter": "double",
    "obb_width": "double",
    "obb_length": "double",
    "ground_area": "double",
    "wall_area": "double",
    "roof_area": "double",
    "ground_point_count": "int",
    "max_Z": "double",
    "min_Z": "double",
    "ground_Z": "double",
    "hole_count": "int",
    "shared_walls_area": "double",
    "closest_distance": "double",
}


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a metrics file, the known columns by the names in its header.

    Other columns and any order are fine; a known one that is missing is an error.
    """
    table = spark.read.csv(path, header=True)
    missing = [c for c in METRICS if c not in table.columns]
    if missing:
        raise KeyError(f"{path} lacks the columns {missing}")
    return table.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in METRICS.items()])


def import_metrics(metrics: DataFrame, lod: str) -> DataFrame:
    """Closed solids only, every column but the id marked with its level of detail."""
    closed = metrics.select(*METRICS).filter("hole_count = 0")
    return add_suffix(closed, lod, keep=["id"])
