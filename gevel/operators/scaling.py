"""Centre on the median and scale by the interquartile range."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame

from gevel.operators.quantiles import quantiles_wide

PREFIX = "scaled_"


def robust_statistics(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Median and range per column; a range of 0 counts as 1."""
    rows = quantiles_wide(df, cols, [0.25, 0.5, 0.75], ["q25", "q50", "q75"]).collect()
    found = {r["feature"]: (r["q50"], (r["q75"] - r["q25"]) or 1.0) for r in rows}
    return {c: found.get(c, (0.0, 1.0)) for c in cols}


def robust_scaler(train: DataFrame, cols: list[str]) -> SQLTransformer:
    """A transformer that adds ``scaled_<column>``; fitted on ``train``, saved as plain SQL."""
    stats = robust_statistics(train, cols)
    scaled = ", ".join(
        f"(CAST(`{c}` AS DOUBLE) - ({m!r}D)) / ({s!r}D) AS `{PREFIX}{c}`" for c, (m, s) in stats.items()
    )
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def scaled_names(cols: list[str]) -> list[str]:
    return [PREFIX + c for c in cols]
