"""Exact quantiles in two passes, without holding a column in one task.

The built-in exact percentile keeps every distinct value in a single map. Here
a sketch with bounded error brackets each quantile first; the second pass counts
what lies below the bracket and keeps the few values inside it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Size of a sketch, and the share of ranks by which it may be off; a bracket that misses is widened, so this is no risk.
SKETCH, MARGIN = 4096, 0.0025
#: Values a bracket may hold before it is narrowed once more.
FEW = 100_000


def unpivot(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Long form ``(keep..., feature, value)`` without nulls."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                for c in cols
            ]
        )
    )
    return df.select(*(keep or []), pairs.alias("p")).select(*(keep or []), "p.*").filter(
        "value is not null"
    )


def _first_row(df: DataFrame, columns: list) -> list:
    return list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], margin: float = MARGIN) -> DataFrame:
    """``(feature, prob, value)`` with linear interpolation between neighbours.

    One mergeable sketch per column brackets all its quantiles; plain one-row
    aggregates then count what lies below a bracket and in it, and narrow brackets
    that hold more than ``FEW`` values. Only the values inside the last bracket are
    ever shuffled.
    """
    v = {c: F.col(f"`{c}`").cast("double") for c in cols}

    def sketch(value, p: float):
        # Catalyst builds the sketch of a column once, however many quantiles are asked of it.
        held = F.kll_sketch_agg_double(value, F.lit(SKETCH))
        ends = [
            F.kll_sketch_get_quantile_double(held, F.lit(min(max(p + side, 0.0), 1.0))) for side in (-margin, margin)
        ]
        return F.when(F.count(value) > 0, F.array(*ends))

    asked = [(c, float(p)) for c in cols for p in probs]
    found = _first_row(
        df,
        [F.count(v[c]) for c in cols]
        + [F.struct(F.min(v[c]), F.max(v[c])) for c in cols]
        + [sketch(v[c], p) for c, p in asked],
    )
    size, span = dict(zip(cols, found)), dict(zip(cols, found[len(cols) :]))
    at = {(c, p): (size[c] - 1) * p for c, p in asked if size[c]}
    bounds = {k: tuple(q) for k, q in zip(asked, found[2 * len(cols) :]) if k in at}
    settled: set[tuple[str, float]] = set()
    below: dict[tuple[str, float], int] = {}
    open_ = list(bounds)
    while open_:
        inside = {k: v[k[0]].between(F.lit(bounds[k][0]), F.lit(bounds[k][1])) for k in open_}
        row = _first_row(
            df,
            [F.count_if(v[k[0]] < F.lit(bounds[k][0])) for k in open_] + [F.count_if(inside[k]) for k in open_],
        )
        held = dict(zip(open_, row[len(open_) :]))
        below.update(zip(open_, row))
        again = []
        for k in open_:
            early, late = math.floor(at[k]) < below[k], math.ceil(at[k]) > below[k] + held[k] - 1
            if early or late:  # the sketch was off: take that side whole, and leave it so
                low, high = span[k[0]]
                bounds[k] = (low if early else bounds[k][0], high if late else bounds[k][1])
                settled.add(k)
                again.append(k)
        crowded = [
            k for k in open_ if k not in settled and held[k] > FEW and bounds[k][0] < bounds[k][1]
        ]
        if crowded:
            parts = [sketch(F.when(inside[k], v[k[0]]), (at[k] - below[k]) / (held[k] - 1)) for k in crowded]
            for k, q in zip(crowded, _first_row(df, parts)):
                if tuple(q) != bounds[k]:
                    bounds[k] = tuple(q)
                    again.append(k)
        open_ = again
    schema = "feature string, prob double, value double"
    if not bounds:
        return df.sparkSession.createDataFrame([], schema)
    held = [
        F.when(
            v[c].between(F.lit(bounds[c, p][0]), F.lit(bounds[c, p][1])),
            F.struct(F.lit(c).alias("feature"), F.lit(p).alias("prob"), v[c].alias("v")),
        )
        for c, p in bounds
    ]
    # One row per column and probability: as many as the caller listed.
    places = df.sparkSession.createDataFrame(
        [(c, p, float(at[c, p]), int(below[c, p])) for c, p in bounds],
        "feature string, prob double, at double, below long",
    )
    steps = (
        df.select(F.explode(F.array_compact(F.array(*held))).alias("x"))
        .select("x.*")
        .groupBy("feature", "prob", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(places), ["feature", "prob"])
    )
    keys = ["feature", "prob", "at"]
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("upto", F.col("below") + F.sum("n").over(upto))
    low, high = F.floor("at"), F.ceil("at")
    return (
        steps.groupBy(*keys)
        .agg(
            F.min(F.when(F.col("upto") > low, F.col("v"))).alias("v0"),
            F.min(F.when(F.col("upto") > high, F.col("v"))).alias("v1"),
        )
        .select("feature", "prob", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - low)).alias("value"))
    )


def quantiles_wide(df: DataFrame, cols: list[str], probs: list[float], names: list[str]) -> DataFrame:
    """One row per feature, one column per probability."""
    long = exact_quantiles(df, cols, probs)
    return long.groupBy("feature").agg(
        *[
            F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n)
            for p, n in zip(probs, names)
        ]
    )
