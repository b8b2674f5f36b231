"""Lookups, flattening, collecting and column housekeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 8 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if few rows of few bytes are counted; else have the join shuffle it."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Have a join with ``df`` shuffle both sides and merge them.

    Ahead of a run Spark sizes a table by the file it comes from and the columns taken, and
    so would send millions of rows with arrays through the driver as a broadcast.
    """
    return df.hint("merge")


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the row with the highest ``order`` per key.

    Aggregates instead of ranking in a window, so that a key with very many
    rows is reduced ahead of the shuffle. The other columns break ties.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *rest)
    best = df.groupBy(*keys).agg(F.max(ranked).alias("best"))
    return best.select(*keys, *[F.col("best")[c].alias(c) for c in rest])


def assign_from(
    target: DataFrame, source: DataFrame, key: str, order: list[Column] | None = None
) -> DataFrame:
    """Set columns of ``target`` from the row of ``source`` with the same key.

    Rows without a match keep what they have (null for a new column); a match
    overwrites even with null. ``order`` picks one source row per key, the
    highest first; leave it out when the source has unique keys.
    """
    if order is not None:
        source = one_per_key(source, [key], order)
    values = [c for c in source.columns if c != key]
    renamed = source.select(
        key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in values]
    )
    joined = target.join(renamed, key, "left")
    new = [
        (
            F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c))
            if c in target.columns
            else F.col(f"__new_{c}")
        ).alias(c)
        for c in values
    ]
    kept = [c for c in target.columns if c not in values]
    return joined.select(*kept, *new)


def flatten(df: DataFrame, column: str, alias: str) -> DataFrame:
    """One row per array element; null and empty arrays vanish."""
    return df.withColumn(alias, F.explode(column))


def collect_counted(
    df: DataFrame, key: str, value: str, alias: str, count: str | None = None
) -> DataFrame:
    """All values per key, nulls and repeats kept, as ``array<struct<value,n>>``.

    Repeats are counted ahead of the shuffle, so that a key holding a large
    share of the rows still gives one short array. ``count`` names a column
    of counts if the rows come counted.
    """
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    counted = df.groupBy(key, F.col(value).alias("value")).agg(n.alias("n"))
    return counted.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("value", "n"))).alias(alias)
    )


def expand_counted(counted: Column) -> Column:
    """The plain array behind :func:`collect_counted`, in sorted order; as long as the group."""
    return F.flatten(F.transform(counted, lambda e: F.array_repeat(e["value"], e["n"].cast("int"))))


def counted_size(counted: Column) -> Column:
    return F.aggregate(counted, F.lit(0).cast("long"), lambda acc, e: acc + e["n"])


def counted_of(counted: Column, value: str) -> Column:
    return counted_size(F.filter(counted, lambda e: e["value"] == value))


def add_suffix(df: DataFrame, suffix: str, keep: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in df.columns if c not in keep})


def drop_required(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns; a name that is not there is an error."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"no such columns: {missing}")
    return df.drop(*names)


def drop_incomplete(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop rows with a null in one of ``names``; NaN is a value and stays."""
    cond = F.lit(True)
    for c in names:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Fail if ``key`` has repeats or nulls, else return ``df``."""
    bad = df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"{key} is not a unique key: {bad.first()}")
    return df
