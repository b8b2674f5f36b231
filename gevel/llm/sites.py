"""Quality by hierarchical empirical Bayes: a document's own evidence, its site's and its path's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import fraction, keep_table, map_arrow, utf8
from gevel.llm.rules import counts

#: Labelled rows of each label that the document classifier is fitted on.
ROWS = 10_000
NAMES = ("words", "length", "symbols", "lines", "repeats", "upper", "marks", "variety")
#: Weight of the squared coefficients.
RIDGE = 1.0
#: Documents' worth of prior when sites do not differ at all, and least there is.
STRONGEST, WEAKEST = 1e9, 1e-3

_UPPER = bytes(range(65, 91))
_MARKS = b"!?|"


def evidence(text: bytes) -> list[float]:
    """Surface features of a text, each in a narrow range; zeros and ones for an empty one."""
    n, chars, symbols, dup_lines, repeats = counts(text)
    size = max(1, len(text))
    return [
        float(np.log1p(n)),
        chars / n if n else 0.0,
        min(1.0, 10 * symbols / size),
        dup_lines / (1 + text.count(b"\n")),
        repeats / n if n else 0.0,
        (len(text) - len(text.translate(None, _UPPER))) / size,
        min(1.0, 10 * (len(text) - len(text.translate(None, _MARKS))) / size),
        len(set(text.split())) / n if n else 1.0,
    ]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; features must be standardised. Last: the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.eye(x.shape[1]) * RIDGE
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def classifier(rows: DataFrame, labels: DataFrame) -> Column:
    """P(good) of a document from its features alone, as a column over ``x``.

    At most about ``ROWS`` labelled rows of each label are fitted, thinned by a hash
    of the id; the intercept is set back to the labels' own odds.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("l_id"))
        .agg(F.max(F.col("quality").cast("int")).alias("y"))
    )
    joined = rows.join(known, F.col("doc_id") == F.col("l_id")).select("doc_id", "x", "y")
    have = dict(joined.groupBy("y").count().collect())
    if len(have) < 2:
        return F.lit(0.5)
    share = {y: min(1.0, ROWS / n) for y, n in have.items()}
    limit = F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    sample = joined.where(fraction("quality", F.col("doc_id")) < limit).orderBy("doc_id").collect()
    if len({r["y"] for r in sample}) < 2:
        return F.lit(0.5)
    x, y = np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample], float)
    mean, deviation = x.mean(0), x.std(0) + 1e-6
    w = fit((x - mean) / deviation, y)
    slope = w[:-1] / deviation
    intercept = w[-1] - slope @ mean - np.log(share[1] / share[0])
    logit = F.lit(float(intercept))
    for i, b in enumerate(slope):
        logit = logit + F.lit(float(b)) * F.element_at("x", i + 1)
    return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))


def strength(groups: DataFrame, inside: Column, n: Column, mean: Column, parent: Column) -> float:
    """Documents' worth of prior: variance inside groups over variance between them, by moments."""
    q, within, total, squares, k = groups.agg(
        F.sum(n * (mean - parent) ** 2), F.sum(inside), F.sum(n), F.sum(n * n), F.count(F.lit(1))
    ).first()
    if not total or total <= k:
        return STRONGEST
    variance = within / (total - k)
    between = (q - (k - 1) * variance) / max(total - squares / total, 1e-9)
    return STRONGEST if between <= 0 else min(STRONGEST, max(WEAKEST, variance / between))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def site_scores(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, evidence, host_quality, path_quality, score, kept) of every row.

    ``evidence`` is the classifier's P(good). Sites are shrunk towards the mean of all
    documents, paths towards their site, each by a prior as strong as the groups are
    alike; a document's own evidence is left out of both. ``score`` moves the evidence
    by the odds of its path against those of all documents; kept: 0.5 or more.

    Null and empty text: features of an empty text. Null host or path: a group of its
    own. Repeated rows are kept and count twice. Null doc_id: never fitted on. No labels
    of both values: an evidence of 0.5 for all. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([evidence(t or b"") for t in utf8(batch.column("text"))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "host", "path")), x], ["doc_id", "host", "path", "x"]
            )

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.to_json(F.struct(host.alias("v"))).alias("host"),
        F.to_json(F.struct(path.alias("v"))).alias("path"),
        "text",
    )
    rows, _ = keep_table(
        map_arrow(texts, run, "doc_id long, host string, path string, x array<double>"), "evidence"
    )
    rows, _ = keep_table(rows.withColumn("p", classifier(rows, labels)).drop("x"), "documents")
    paths, _ = keep_table(
        rows.groupBy("host", "path").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("s2")
        ),
        "paths",
    )
    hosts, _ = keep_table(
        paths.groupBy(F.col("host").alias("h")).agg(
            F.sum("n").alias("h_n"), F.sum("s").alias("h_s"), F.sum("s2").alias("h_s2")
        ),
        "hosts",
    )
    total, good = hosts.agg(F.sum("h_n"), F.sum("h_s")).first()
    mean = F.lit(good / total if total else 0.5)
    h_mean = F.col("h_s") / F.col("h_n")
    host_prior = strength(hosts, F.col("h_s2") - F.col("h_n") * h_mean**2, F.col("h_n"), h_mean, mean)
    tree = paths.join(hosts, F.col("host") == F.col("h"))
    p_mean = F.col("s") / F.col("n")
    path_prior = strength(tree, F.col("s2") - F.col("n") * p_mean**2, F.col("n"), p_mean, h_mean)
    tree = tree.select(F.col("host").alias("t_host"), F.col("path").alias("t_path"), "n", "s", "h_n", "h_s")
    p = F.col("p")
    of_host = (F.col("h_s") - p + host_prior * mean) / (F.col("h_n") - 1 + host_prior)
    of_path = (F.col("s") - p + path_prior * F.col("host_quality")) / (F.col("n") - 1 + path_prior)
    odds = _logit(p) + _logit(F.col("path_quality")) - _logit(mean)
    return (
        rows.join(tree, (F.col("host") == F.col("t_host")) & (F.col("path") == F.col("t_path")))
        .withColumn("host_quality", of_host)
        .withColumn("path_quality", of_path)
        .withColumn("score", 1 / (1 + F.exp(-odds)))
        .select(
            "doc_id",
            F.get_json_object("host", "$.v").alias("host"),
            F.get_json_object("path", "$.v").alias("path"),
            p.alias("evidence"),
            "host_quality",
            "path_quality",
            "score",
            (F.col("score") >= 0.5).alias("kept"),
        )
    )
