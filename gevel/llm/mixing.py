"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gevel.llm.common import fraction, free_names, keep_table

WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all words, and of a source's words that its target may reach.
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def n_words(text: str = "text") -> Column:
    r"""Runs of other characters than blank and \x09-\x0D; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their rank by code point, null last, from 0.

    Ranges of sources are ranked apart and offset by the sizes of the ranges
    before them, of which there is one row for each partition.
    """
    ranges = sources.repartitionByRange(F.col("source").asc_nulls_last())
    ranges, _ = keep_table(ranges.withColumn("slice", F.spark_partition_id()), "sources")
    inside = Window.partitionBy("slice").orderBy(F.col("source").asc_nulls_last())
    sizes = ranges.groupBy(F.col("slice").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = ranges.withColumn("inside", F.row_number().over(inside) - 1)
    return ranked.join(offsets, F.col("slice") == F.col("s")).select(
        "source", "source_size", (F.col("inside") + F.col("offset")).alias("rank")
    )


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, size) rows to (source, source_size, target).

    ``weights`` repeat over the ranked sources and share ``share`` times all words. A
    target stops at ``most`` times its source; the excess goes to the others by weight
    until none is above. One aggregate row comes to the driver in a round.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals)
    turn = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    weighed, _ = keep_table(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")),
        "weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("cap") if stopped >= 0 else F.lit(False)
        full, rest, n = weighed.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(above, 1)),
        ).first()
        if n == stopped or rest == 0:
            break
        level, stopped = (share * total - full) / rest, n
    return weighed.select(
        "source", "source_size", F.least(F.col("weight") * F.lit(float(level)), F.col("cap")).alias("target")
    )


def draw(seed: str) -> Column:
    """A document's draw from [0, 1), from its id and text."""
    return fraction(seed, F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def copies(drawn: str) -> Column:
    """floor(rate), and once more if the draw is below the rest; at least 0 words: rate 0."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (F.floor(rate) + (F.col(drawn) < rate - F.floor(rate)).cast("long")).cast("long")


def rates(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    Each document comes floor(rate) times, rate being its source's target over its
    size, and once more if a draw hashed from seed, doc_id and text is below the rest.

    Null or empty text: size 0, mixed at its source's rate. A source without words has
    rate 0. Null source: a source of its own, ranked last. Repeated rows draw alike.
    No rows: no rows.
    """
    sizes, _ = keep_table(docs.select("doc_id", "source", n_words().alias("size"), draw(seed).alias("draw")), "sizes")
    # sources are far fewer than documents; Spark broadcasts them if small and else splits hot ones
    aims = targets(sizes).withColumnRenamed("source", "aim")
    return sizes.join(aims, F.col("source").eqNullSafe(F.col("aim"))).select(
        "doc_id", "source", "size", "source_size", "target", copies("draw").alias("copies")
    )


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as ``rates`` says, with ``copy_no`` from 1.

    A column of that name in ``docs`` is replaced, others keep their names. Texts are read twice and never shuffled.
    """
    sizes, _ = keep_table(docs.select("source", n_words().alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    own = [c for c in docs.columns if c.lower() != "copy_no"]
    aim, rate, drawn = free_names(docs, "llm_aim", "llm_rate", "llm_draw")
    aims = targets(sizes).select(F.col("source").alias(aim), F.struct("source_size", "target").alias(rate))
    joined = docs.withColumn(drawn, draw(seed)).join(aims, docs["source"].eqNullSafe(aims[aim]))
    packed = joined.select(
        F.struct(*[docs[c] for c in own]).alias("row"), f"{rate}.source_size", f"{rate}.target", F.col(drawn).alias("drawn")
    ).withColumn("n", copies("drawn"))
    taken = packed.where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy_no")).select(
        "row.*", "copy_no"
    )


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


#: DuckDB: the level at which targets stop is found over sources sorted by size for weight.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST(CAST('0x' || left(md5(concat_ws('|', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 13)
              AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source
), r AS (
  SELECT 0 AS round, CAST(1.5 * sum(source_size) / sum(weight) AS DOUBLE) AS level, CAST(0 AS BIGINT) AS n FROM s
  UNION ALL
  SELECT round + 1, lv, m FROM (
    SELECT r.round, count(*) FILTER (weight * level > 2.0 * source_size) AS m, any_value(r.n) AS n,
           (1.5 * sum(source_size) - coalesce(sum(2.0 * source_size) FILTER (weight * level > 2.0 * source_size), 0))
           / nullif(sum(weight) FILTER (weight * level <= 2.0 * source_size), 0) AS lv
    FROM r, s GROUP BY r.round) WHERE m > n AND lv IS NOT NULL
), t AS (
  SELECT source, source_size,
         least(weight * (SELECT level FROM r ORDER BY round DESC LIMIT 1), CAST(2.0 * source_size AS DOUBLE)) AS target
  FROM s
), x AS (
  SELECT doc_id, size, source_size, target, draw,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM x
"""
