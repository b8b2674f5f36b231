"""Entity-attribute-value rows of a city database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attribute(rows: DataFrame, name: str, value: str = "strval") -> DataFrame:
    """One attribute as ``(cityobject_id, <name>)``."""
    return rows.filter(F.col("attrname") == name).select("cityobject_id", F.col(value).alias(name))


def attributes_wide(rows: DataFrame, names: list[str], value: str = "realval") -> DataFrame:
    """Several attributes in one pass, a column each; the highest wins on repeats."""
    return (
        rows.filter(F.col("attrname").isin(names))
        .groupBy("cityobject_id")
        .agg(*[F.max(F.when(F.col("attrname") == n, F.col(value))).alias(n) for n in names])
    )


def by_object(objects: DataFrame, values: DataFrame) -> DataFrame:
    """Swap the internal object id for the public one, as ``bag_id``."""
    return objects.join(values, objects["id"] == values["cityobject_id"]).select(
        objects["gmlid"].alias("bag_id"), *[c for c in values.columns if c != "cityobject_id"]
    )
