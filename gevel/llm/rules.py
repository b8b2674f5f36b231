"""Quality rules: surface counts, and a hashed n-gram likelihood ratio between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import keep_table, map_arrow, utf8

#: Buckets of the n-gram counts, and bytes of an n-gram.
BUCKETS = 1 << 16
GRAM = 4
#: Labels that are broadcast at most, some 90 MB in an executor; beyond that Spark joins them as it likes.
BROADCAST_ROWS = 1_000_000
#: Steps of the score among which the threshold is chosen.
STEP = 0.005
FEWEST_WORDS, REPEATED_SHARE, RUN = 20, 30, 8

_BLANKS = b" \t\n\x0b\x0c\r"
_LATER = bytes(range(128, 192))
_SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[bytes]) -> int:
    """Words in runs of eight that stand twice or more in the text, the first ones included."""
    n = len(words) - RUN + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) > len(words) - RUN:  # a second run would repeat eight words
        return 0
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    keys = np.zeros(n, np.uint64)
    for i in range(RUN):
        keys = keys * np.uint64(0xC2B2AE3D27D4EB4F) + ids[i : i + n]
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    if not len(starts):
        return 0
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + RUN, -1)
    return int((np.cumsum(depth) > 0).sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _BLANKS + _LATER)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def grams(text: bytes) -> np.ndarray:
    """Buckets of the text's byte n-grams."""
    if len(text) < GRAM:
        return np.empty(0, np.int64)
    codes = np.ndarray((len(text) - GRAM + 1,), "<u4", text, 0, (1,)) * np.uint32(0x9E3779B1)
    return (codes >> np.uint32(16)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two count tables for a partition: of trusted texts, of all."""
    trusted, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("label").to_pylist()
        for i, text in enumerate(utf8(batch.column("text"))):
            own = np.bincount(grams(text or b""), minlength=BUCKETS)
            raw += own
            if good[i] == 1:
                trusted += own
    yield pa.RecordBatch.from_arrays(
        [pa.array([trusted.tobytes()]), pa.array([raw.tobytes()])], ["trusted", "raw"]
    )


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {"trusted": np.zeros(BUCKETS, np.int64), "raw": np.zeros(BUCKETS, np.int64)}
    for batch in batches:
        for name, table in total.items():
            for part in batch.column(name).to_pylist():
                table += np.frombuffer(part, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()]) for t in total.values()], list(total))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``label``: the quality of the id (the larger of several), or null."""
    known = (
        labels.where(F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("l_id"))
        .agg(F.max(F.col("quality").cast("int")).alias("label"))
        .where("l_id is not null")
    )
    known, _ = keep_table(known, "labels")
    small = known.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(F.broadcast(known) if small else known, F.col("doc_id") == F.col("l_id"), "left").select(
        "doc_id", "text", "label"
    )


def multinomials(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of trusted and of all texts, summed up in two rounds of fixed width."""
    sums = map_arrow(rows, _tally, "trusted binary, raw binary")
    for width in (256, 8):
        sums = map_arrow(sums.repartition(width), _sum, "trusted binary, raw binary")
    trusted, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for a, b in sums.collect():
        trusted += np.frombuffer(a, np.int64)
        raw += np.frombuffer(b, np.int64)
    return trusted, raw


def ratio(at: np.ndarray, trusted: np.ndarray, raw: np.ndarray, is_trusted: bool) -> float:
    """Mean log-likelihood ratio of n-grams, the text's own counts taken out of both multinomials."""
    if not len(at):
        return 0.0
    own = np.bincount(at, minlength=BUCKETS)[at]
    mine = own if is_trusted else 0
    n = len(at)
    t = np.log(trusted[at] - mine + 1.0).mean() - np.log(trusted.sum() - n * is_trusted + BUCKETS)
    r = np.log(raw[at] - own + 1.0).mean() - np.log(raw.sum() - n + BUCKETS)
    return float(t - r)


SCORED = (
    "doc_id long, label int, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, score double"
)


def threshold(scored: DataFrame) -> float:
    """The score that separates the labels best among texts that pass the base rules.

    Greatest sum of the shares of good ones kept and bad ones dropped, over steps of
    ``STEP``; of equal ones the lowest. Without both labels: minus infinity.
    """
    bins = scored.where(~base_failed()).where("label is not null")
    rows = bins.groupBy(F.floor(F.col("score") / STEP).cast("long").alias("bin"), "label").count().collect()
    total = [sum(n for _, y, n in rows if y == label) for label in (0, 1)]
    if not all(total):
        return float("-inf")
    best, at, bad, good = 0.0, float("-inf"), 0, 0
    for b in sorted({r[0] for r in rows}):
        bad += sum(n for x, y, n in rows if x == b and y == 0)
        good += sum(n for x, y, n in rows if x == b and y == 1)
        if bad / total[0] - good / total[1] > best:
            best, at = bad / total[0] - good / total[1], (b + 1) * STEP
    return at


def base_failed():
    few = F.col("n_words") < FEWEST_WORDS
    return few | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its counts, score, base_failed and kept.

    The score is the mean, over the text's hashed byte n-grams, of their log-likelihood
    in the texts labelled good against that in all texts. Both count tables cover every
    document. A text is kept if the base rules pass and its score reaches the threshold.

    Null, empty and wordless texts: counts of 0, base_failed. Under four bytes: score 0.
    Null labels and labels other than 0 and 1 are left out; null doc_id: no label.
    Repeated rows are kept. No labels: only the base rules decide. No rows: no rows.
    """
    rows = labelled(docs, labels)
    tables = docs.sparkSession.sparkContext.broadcast(multinomials(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trusted, raw = tables.value
        for batch in batches:
            label = batch.column("label").to_pylist()
            made, score = [], []
            for i, text in enumerate(utf8(batch.column("text"))):
                made.append(counts(text or b""))
                score.append(ratio(grams(text or b""), trusted, raw, label[i] == 1))
            numbers = [pa.array(x, pa.int64()) for x in (zip(*made) if made else [[]] * 5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), *numbers, pa.array(score, pa.float64())],
                ["doc_id", "label", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
            )

    scored, _ = keep_table(map_arrow(rows, run, SCORED), "scores")
    return scored.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold(scored)))
    )


def digest(rows: DataFrame) -> DataFrame:
    return rows.drop("label")
