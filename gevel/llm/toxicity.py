"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import ALNUM, fraction, map_arrow, text_hash, utf8, word_chunks

#: Size of the hashed feature space.
BUCKETS = 1 << 20
#: Labelled rows of label 0 and of label 1 that training may use, and the bytes of text either may hold.
ROWS = (6000, 3000)
TRAIN_BYTES = 16 << 20
EPOCHS = 3
#: With L1 above the number of epochs a feature of a single row keeps weight zero.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def features(text: bytes | None) -> Iterator[np.ndarray]:
    """Buckets of a text's words, pairs, triples and pairs with one word between, repeats included."""
    tail = np.empty(0, np.uint64)
    for words in word_chunks(text or b"", ALNUM):
        new = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
        h = np.concatenate([tail, new])
        held, tail = len(tail), h[-2:]
        a, b, c, d = _MIX
        made = [h[held:] * a]
        if len(h) > 1:
            made.append((h[:-1] * b + h[1:] * a)[max(0, held - 1) :])
        if len(h) > 2:
            made.append(h[:-2] * c + h[1:-1] * b + h[2:] * a)
            made.append(h[:-2] * d + h[2:] * a)
        mixed = np.concatenate(made)
        yield ((mixed ^ (mixed >> np.uint64(29))) * a >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1)


@dataclass
class Model:
    """Weights that are not zero, sorted by bucket, and the bias."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(BUCKETS, np.float32)
        table[self.bucket] = self.weight
        return table


def score(text: bytes | None, table: np.ndarray, bias: float) -> float:
    """Probability of label 1; each feature counts once, however often it occurs."""
    known = [np.empty(0, np.int64)]
    for f in features(text):
        known.append(np.unique(f[table[f] != 0]))
    total = bias + float(table[np.unique(np.concatenate(known))].sum(dtype=np.float64))
    return 1.0 / (1.0 + np.exp(-min(max(total, -500.0), 500.0)))


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """Fit: per-coordinate rates by past gradients; L1 keeps weights at zero until evidence outweighs it."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        zi = z[at]
        return np.where(
            np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        )

    for _ in range(epochs):
        for buckets, label in rows:
            at = np.append(buckets, BUCKETS)  # the last is the bias
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-min(max(w.sum(), -500.0), 500.0))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    bucket = np.flatnonzero(w[:-1])
    return Model(bucket, w[bucket].astype(np.float32), float(w[-1]))


def train_rows(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame | None, float]:
    """At most about ``ROWS`` labelled rows of each class: (h, y, at), ``at`` being their features.

    Also the logarithm of how much more of label 1 than of label 0 was taken.

    Rows whose crc32(doc_id) mod 5 is 0 are held out. A class with more rows is
    thinned by a hash of the text, so that copies of one text come or go together and
    the choice depends on nothing but texts and counts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = (
        labels.where(F.col(label).isin(0, 1))
        .select(F.col("doc_id").cast("long").alias("l_id"), F.col(label).cast("int").alias("y"))
        .where(F.crc32(F.col("l_id").cast("string")) % 5 != 0)
        .groupBy("l_id")
        .agg(F.max("y").alias("y"))
    )
    texts = docs.select(F.col("doc_id").alias("d_id"), text_hash().alias("h"), F.octet_length("text").alias("size"))
    found = (
        texts.join(known, F.col("d_id") == F.col("l_id"))
        .groupBy("h", "y")
        .agg(F.max("size").alias("size"), F.min("d_id").alias("d_id"))
    )
    have = {r[0]: (r[1], r[2] or 0) for r in found.groupBy("y").agg(F.count(F.lit(1)), F.sum("size")).collect()}
    if len(have) < 2:
        return None, 0.0
    share = {y: min(1.0, ROWS[y] / n, TRAIN_BYTES / max(size, 1)) for y, (n, size) in have.items()}
    limit = F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    chosen = found.where(fraction("train", F.col("h")) < limit).select("d_id", "h", "y")
    # bounded by ROWS for each class
    full = docs.join(
        F.broadcast(chosen),
        (docs["doc_id"] == chosen["d_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == chosen["h"]),
    ).select("h", "y", docs["text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [
                np.unique(np.concatenate([np.empty(0, np.int64), *features(t)])).astype(np.int32)
                for t in utf8(batch.column("text"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("y"), pa.array(sets, pa.list_(pa.int32()))], ["h", "y", "at"]
            )

    return map_arrow(full, hashed, "h long, y int, at array<int>"), math.log(share[1] / share[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model from the rows that are not held out; without both classes, bias only.

    One task fits the bounded sample and gives back the weights, so that the driver
    holds nothing but these.
    """
    rows, lean = train_rows(docs, labels, label)
    none = Model(np.empty(0, np.int64), np.empty(0, np.float32), -1.0)
    if rows is None:
        return none

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, last = [], None
        for batch in batches:
            at, y, h = batch.column("at"), batch.column("y").to_pylist(), batch.column("h").to_pylist()
            for i in range(batch.num_rows):
                if (h[i], y[i]) != last:  # a repeated row counts once
                    sample.append((at[i].values.to_numpy(zero_copy_only=False).copy(), y[i]))
                last = (h[i], y[i])
        if sample:
            model = ftrl(sample)
            columns = [
                pa.array([model.bucket], pa.list_(pa.int64())),
                pa.array([model.weight], pa.list_(pa.float32())),
                pa.array([model.bias], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "weight", "bias"])

    one = rows.repartition(1).sortWithinPartitions("h", "y")
    found = map_arrow(one, learn, "bucket array<long>, weight array<float>, bias double").first()
    if found is None:
        return none
    return Model(np.array(found["bucket"], np.int64), np.array(found["weight"], np.float32), found["bias"] - lean)


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, k_hash, held_out, score, predicted) of every row of ``docs``.

    Only the text goes into a score. Training takes a bounded sample of labelled rows
    (``ROWS``, ``TRAIN_BYTES``); every whole text is scored.

    Null, empty or wordless text: the score of the bias alone. Null labels and labels
    other than 0 and 1 are left out; of several labels of an id the larger counts. Null
    doc_id: never trained on, held_out false. Repeated rows are kept. No labels of both
    classes: a score of 0.27 for all. No rows: no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value.dense(), model.value.bias
        for batch in batches:
            s = [score(t, table, bias) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k_hash"), pa.array(s, pa.float64())], ["doc_id", "k_hash", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("k_hash"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return map_arrow(rows, run, "doc_id long, k_hash long, score double").select(
        "doc_id", "k_hash", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic, in one map without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value.dense(), model.value.bias
        for batch in batches:
            yield batch.filter(pa.array([score(t, table, bias) < 0.5 for t in utf8(batch.column("text"))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
