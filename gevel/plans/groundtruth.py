"""Labels per building from the attribute tables or from the energy register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.functions import labels
from gevel.operators.lookup import assign_from, collect_counted, flatten
from gevel.plans.extraction import units_in_use
from gevel.sources.attributes import attribute, by_object

# Class of a building object, and a building with a faulty footprint.
BUILDING_CLASS = 26
EXCLUDED = ["NL.IMBAG.Pand.0150100000059983"]


def study_buildings(objects: DataFrame, named_only: bool = True, excluded: list[str] | None = None) -> DataFrame:
    """``bag_id`` of the building objects of an area; ``excluded`` are left out of the named ones."""
    kept = objects.filter(F.col("objectclass_id") == BUILDING_CLASS)
    if named_only:
        kept = kept.filter(F.col("name").isNotNull() & ~F.col("gmlid").isin(EXCLUDED if excluded is None else excluded))
    return kept.select(F.col("gmlid").alias("bag_id"))


def attribute_labels(objects: DataFrame, rows: DataFrame, name: str = "dutch_building_type") -> DataFrame:
    """Building objects with their label attribute, null where there is none."""
    found = by_object(objects, attribute(rows, name)).withColumnRenamed(name, "building_type")
    return assign_from(
        study_buildings(objects), found, "bag_id", order=[F.col("building_type")]
    )


def unit_labels(energy: DataFrame, units: DataFrame) -> DataFrame:
    """``(bag_id, label)``: energy labels of units in use."""
    numbered = energy.select(
        F.concat(F.lit(labels.UNIT_PREFIX), F.col("Pand_bagverblijfsobjectid")).alias("identificatie"),
        F.col("Pand_gebouwtype").alias("label"),
    )
    held = numbered.join(units_in_use(units).select("identificatie", "pandref"), "identificatie")
    return flatten(held, "pandref", "bag_id").select("bag_id", "label")


def standing_buildings(pand: DataFrame) -> DataFrame:
    """``bag_id`` of buildings in use."""
    return pand.filter(
        F.col("status").startswith(labels.BUILDING_IN_USE) & F.col("eindgeldigheid").isNull()
    ).select(F.col("identificatie").alias("bag_id"))


def labelled_units(energy: DataFrame, units: DataFrame, pand: DataFrame) -> DataFrame:
    """``(bag_id, label, n)``: energy labels of units in use, in buildings in use.

    Labels are counted ahead of the join, so that a building with very many
    units brings a few rows to it.
    """
    counted = unit_labels(energy, units).groupBy("bag_id", "label").agg(F.count(F.lit(1)).alias("k"))
    versions = standing_buildings(pand).groupBy("bag_id").agg(F.count(F.lit(1)).alias("times"))
    return counted.join(versions, "bag_id").select(
        "bag_id", "label", (F.col("k") * F.col("times")).alias("n")
    )


def register_labels(energy: DataFrame, units: DataFrame, pand: DataFrame) -> DataFrame:
    """All labels per building, counted: ``building_type array<struct<value,n>>``."""
    return collect_counted(
        labelled_units(energy, units, pand), "bag_id", "label", "building_type", count="n"
    )


def area_labels(objects: DataFrame, registered: DataFrame) -> DataFrame:
    """Buildings of an area with the labels the register has for them."""
    base = assign_from(study_buildings(objects, named_only=False), registered, "bag_id")
    return base.withColumn("building_type2", F.lit(None).cast("string"))
