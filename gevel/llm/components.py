"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import forget, keep_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low"))
    joined = both.join(least, both["a"] == least["hub"]).where("b > a")
    return joined.select(F.col("b").alias("a"), F.least("a", "low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low"))
    joined = down.join(least, down["a"] == least["hub"]).where("b <> low")
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
        least.select(F.col("hub").alias("a"), F.col("low").alias("b"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the smallest node reachable. Roots and nodes without links are absent.

    Every round is written to the shared folder and the one before removed, so a
    lost executor costs a round at most. A hub's links are joined, not gathered:
    only its minimum travels. No links: no rows.
    """
    spark = edges.sparkSession
    state, path = keep_table(edges.where("a <> b").select("a", "b").distinct(), "links")
    seen = None
    while True:
        state, newer = keep_table(_small_star(_large_star(state).distinct()).distinct(), "stars")
        forget(spark, path)
        path = newer
        n, mark = state.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if (n, mark) == seen or n == 0:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (n, mark)
