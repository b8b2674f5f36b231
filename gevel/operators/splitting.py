"""Exact stratified splits and folds, and class weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gevel.operators.ranking import rank_by_hash
from gevel.session import materialize

MAX_CLASSES = 10_000


def class_counts(df: DataFrame, label: str, most: int = MAX_CLASSES) -> dict[str, int]:
    """Rows per class; a column with more than ``most`` values is not a class column."""
    rows = (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .limit(most + 1)
        .collect()
    )
    if len(rows) > most:
        raise ValueError(f"{label} has more than {most} values")
    return {r[label]: r["n"] for r in sorted(rows, key=lambda r: r[label])}


def by_class(label: str, values: dict) -> Column:
    """A constant per class, as a column."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(label))


def quotas(counts: dict[str, int], share: float) -> dict[str, int]:
    """Whole numbers per class that add up to the rounded-up share of all rows."""
    total = math.ceil(round(share * sum(counts.values()), 9))
    ideal = {c: share * n for c, n in counts.items()}
    out = {c: math.floor(round(x, 9)) for c, x in ideal.items()}
    by_rest = sorted(counts, key=lambda c: (-(round(ideal[c] - out[c], 9)), c))
    for c in by_rest[: total - sum(out.values())]:
        out[c] += 1
    return out


def mark_test(
    df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 0, alias: str = "is_test"
) -> DataFrame:
    """Mark an exact share of each class, picked in seeded random order."""
    quota = quotas(class_counts(df, label), share)
    ranked = rank_by_hash(df.filter(F.col(label).isNotNull()), [label], seed, key, "__r")
    return ranked.withColumn(alias, F.col("__r") <= by_class(label, quota)).drop("__r")


def split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 0):
    """``(train, test)``, written once: fitting reads them many times over."""
    marked = materialize(mark_test(df, label, key, share, seed), "split")
    return marked.filter("not is_test").drop("is_test"), marked.filter("is_test").drop("is_test")


def with_fold(
    df: DataFrame, label: str, key: str, folds: int = 3, seed: int = 0, alias: str = "fold"
) -> DataFrame:
    """Deal the rows of each class over the folds."""
    ranked = rank_by_hash(df.filter(F.col(label).isNotNull()), [label], seed, key, "__r")
    return ranked.withColumn(alias, ((F.col("__r") - 1) % folds).cast("int")).drop("__r")


def balanced_weight(df: DataFrame, label: str, alias: str = "weight") -> DataFrame:
    """Weight each row by the inverse share of its class."""
    counts = class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    return df.withColumn(alias, by_class(label, {c: n / (k * m) for c, m in counts.items()}))
