"""Joins of whole tables are shuffled, however small Spark takes a side to be."""

from __future__ import annotations

from pyspark.sql import functions as F

from gevel.functions import planar
from gevel.plans import validation
from gevel.queries import stages  # noqa: F401
from gevel.queries.registry import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_surface_areas_without_a_broadcast(spark):
    ids = spark.range(20)
    objects = ids.select("id", F.col("id").cast("string").alias("gmlid"))
    surface = F.explode(F.array(F.lit(1), F.lit(2))).alias("j")
    own = ids.select("id", surface).select("id", "j", (F.col("id") * 10 + F.col("j")).alias("s"))
    thematic = own.select(F.col("id").alias("building_id"), (F.col("j") + 32).alias("objectclass_id"), F.col("s").alias("lod2_multi_surface_id"))
    zero = F.lit(0.0)
    geometry = own.select(F.col("s").alias("root_id"), F.col("s").alias("parent_id"), F.col("s").alias("cityobject_id"),
                          planar.rectangle(zero, zero, F.col("j"), F.lit(3.0)).alias("rings"))
    rows = own.select(F.col("s").alias("cityobject_id"), F.lit("lod2_area").alias("attrname"), F.col("j").cast("string").alias("strval"),
                      F.lit(None).cast("double").alias("realval"))
    roofs = validation.roof_area_from_model(objects, thematic, geometry)
    stated = validation.stated_surface_areas(objects, thematic, geometry, rows)
    assert "Broadcast" not in plan(roofs) and "Broadcast" not in plan(stated)
    assert {r[1] for r in roofs.collect()} == {3.0} and roofs.count() == 20
    assert {(r[1], r[2]) for r in stated.collect()} == {(1.0, 2.0)} and stated.count() == 20


def test_metrics_of_both_levels_meet_without_a_broadcast(spark, tmp_path, monkeypatch):
    spark.range(30).selectExpr(
        "id as p_partkey", "cast(id % 7 as int) as p_size", "cast(id as double) as p_retailprice", "'n' as p_name"
    ).write.parquet(f"{tmp_path}/part.parquet")
    given = []
    monkeypatch.setattr(validation, "report", lambda name, checked, features: given.append(features))
    QUERIES["x22_surface_report"](spark, str(tmp_path))
    assert "Broadcast" not in plan(given[0]) and given[0].count() == 30
