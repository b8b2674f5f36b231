"""Exact ranks inside large groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 4


def seeded_order(seed: int | str, key: str) -> Column:
    """A reproducible shuffle key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def rank_by_hash(df: DataFrame, groups: list[str], seed: int | str, key: str, alias: str) -> DataFrame:
    """1-based rank of each row in its group, in seeded random order.

    The leading hash digits cut a group into 65,536 slices. Ranks are counted
    within slices and offset by the sizes of the slices before, of which there
    is only a short list per group.
    """
    order = seeded_order(seed, key)
    df = df.withColumn("__h", order).withColumn("__slice", F.substring("__h", 1, HASH_DIGITS))
    slices = df.groupBy(*groups, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = before.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*groups, "__slice").orderBy("__h", key)
    ranked = df.withColumn("__rank", F.row_number().over(within))
    joined = ranked.join(
        slices.withColumnsRenamed({g: f"__g_{g}" for g in groups}).withColumnRenamed(
            "__slice", "__slice2"
        ),
        [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups]
        + [F.col("__slice") == F.col("__slice2")],
    )
    return joined.withColumn(alias, F.col("__rank") + F.col("__before")).drop(
        "__h", "__slice", "__slice2", "__rank", "__before", *[f"__g_{g}" for g in groups]
    )
