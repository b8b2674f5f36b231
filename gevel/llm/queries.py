"""The operators as registered queries over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.llm import clusters, codes, decontaminate, lines, mixing, pii, rules, simhash, sites, subtrees, suffixes, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return simhash.digest(simhash.near_copies(_table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document comes in the mix."""
    return mixing.digest(mixing.rates(_table(spark, sf_dir, "documents")))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return urls.digest(urls.judge(_table(spark, sf_dir, "pages")))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages of lines."""
    return lines.digest(lines.cut_passages(_table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.digest(toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and likelihood ratio of all documents."""
    return rules.digest(rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated strings of 400 bytes."""
    return suffixes.digest(suffixes.remove_repeats(_table(spark, sf_dir, "documents")))


def op10_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, their source as site and language as path."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return sites.site_scores(docs, labels, F.col("source"), F.col("lang"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors."""
    return codes.digest(codes.compress(_table(spark, sf_dir, "embeddings")))


def op12_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of windows of 20 words."""
    return subtrees.digest(subtrees.remove_repeats(_table(spark, sf_dir, "documents")))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors."""
    return clusters.digest(clusters.cluster(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_decontaminate,
        op3_pii,
        op4_mixing,
        op5_urls,
        op6_line_chunks,
        op7_toxicity,
        op8_quality_rules,
        op9_suffixes,
        op10_sites,
        op11_codes,
        op12_subtrees,
        op13_clusters,
    )
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.SQL,
    "op4_mixing": mixing.SQL,
    "op11_codes": codes.SQL,
    "op12_subtrees": subtrees.SQL,
    "op13_clusters": clusters.SQL,
}
