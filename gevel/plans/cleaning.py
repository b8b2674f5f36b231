"""From a list of labels per building to one.

The list arrives counted (``array<struct<value,n>>``), see
:func:`gevel.operators.lookup.collect_counted`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gevel.functions import labels
from gevel.operators.lookup import bounded, counted_of, counted_size


def label_counts(table: DataFrame) -> DataFrame:
    """Occurrences of the five multi-dwelling types in lists of other than one label."""
    held = F.col("building_type")
    return table.filter(held.isNotNull() & (counted_size(held) != 1)).select(
        "bag_id",
        counted_of(held, labels.APARTMENT).alias("appartement"),
        counted_of(held, labels.MAISONETTE).alias("maisonnette"),
        counted_of(held, labels.GALLERY).alias("galerijwoning"),
        counted_of(held, labels.PORCH).alias("portiekwoning"),
        counted_of(held, labels.FLAT).alias("flatwoning"),
    )


def _only_label(held: Column) -> Column:
    """The label of a one-label list."""
    return held[0]["value"]


def _is_single(held: Column) -> Column:
    return held.isNotNull() & (counted_size(held) == 1)


def vote(table: DataFrame) -> DataFrame:
    """Set ``building_type2`` of lists of other than one label to the winner, or to null."""
    held = F.col("building_type")
    kinds = [labels.APARTMENT, labels.MAISONETTE, labels.GALLERY, labels.PORCH, labels.FLAT]
    winner = labels.majority_label(*[counted_of(held, k) for k in kinds])
    many = held.isNotNull() & (counted_size(held) != 1)
    return table.withColumn("building_type2", F.when(many, winner).otherwise(F.col("building_type2")))


def split_shared_label(table: DataFrame) -> DataFrame:
    """Decide the one-label lists whose label names two types."""
    held = F.col("building_type")
    shared = _is_single(held) & _only_label(held).contains("/")
    decided = labels.row_house_label(
        F.col("no_adjacent_bldg"), F.col("no_adjacent_of_adja_bldg"), F.col("bag_no_dwellings")
    )
    return table.withColumn(
        "building_type2", F.when(shared, F.coalesce(decided, "building_type2")).otherwise(F.col("building_type2"))
    )


def take_single_label(table: DataFrame) -> DataFrame:
    held = F.col("building_type")
    plain = _is_single(held) & ~_only_label(held).contains("/")
    return table.withColumn(
        "building_type2", F.when(plain, _only_label(held)).otherwise(F.col("building_type2"))
    )


def detached_rest(table: DataFrame) -> DataFrame:
    """Free-standing one-dwelling buildings that still have no label."""
    alone = (
        F.col("building_type2").isNull()
        & (F.col("no_adjacent_bldg") == 0)
        & (F.col("bag_no_dwellings") == 1)
    )
    return table.withColumn(
        "building_type2", F.when(alone, labels.DETACHED).otherwise(F.col("building_type2"))
    )


def override(table: DataFrame, decisions: DataFrame) -> DataFrame:
    """Labels set by hand: ``decisions(bag_id, label)``."""
    joined = table.join(bounded(decisions.select("bag_id", "label")), "bag_id", "left")
    return joined.withColumn("building_type2", F.coalesce("label", "building_type2")).drop("label")


def canonical(table: DataFrame) -> DataFrame:
    return table.withColumn("building_type2", labels.canonical_label(F.col("building_type2")))


def swap_label(table: DataFrame) -> DataFrame:
    """Drop the list and let the single label take its name."""
    return table.drop("building_type").withColumnRenamed("building_type2", "building_type")


def clean_labels(table: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """All steps; the order matters, each looks at what the one before left."""
    t = detached_rest(take_single_label(split_shared_label(vote(table))))
    if decisions is not None:
        t = override(t, decisions)
    return swap_label(canonical(t))


def label_view(table: DataFrame, kind: str) -> DataFrame:
    """Rows to look at: ``multiple``, ``shared``, ``single``, ``apartment`` or ``missing`` labels."""
    held = F.col("building_type")
    only = _only_label(held)
    cond = {
        "multiple": held.isNotNull() & (counted_size(held) != 1),
        "shared": _is_single(held) & only.contains("/"),
        "single": _is_single(held) & ~only.contains("/"),
        "apartment": _is_single(held) & (only == labels.APARTMENT),
        "missing": _is_single(held) & only.isNull(),
    }[kind]
    return table.filter(cond).select(
        "bag_id",
        "building_type",
        "building_type2",
        "no_adjacent_bldg",
        "no_adjacent_of_adja_bldg",
        "bag_no_dwellings",
    )
