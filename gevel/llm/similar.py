"""Texts that share most of their five-word shingles: MinHash bands find pairs, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import LOWER, forget, keep_table, map_arrow, same_doc, text_hash, utf8, word_chunks
from gevel.llm.components import components

#: Texts are alike from four fifths of shared shingles on.
WORDS = 5
#: Keys of a text and minima in each: a pair at 0.8 shares no key in 1 of 2,900 cases, a pair at 0.9 never in practice.
BANDS, ROWS = 20, 5
#: Texts and shingles of one key that are compared in one go.
BLOCK, BLOCK_SHINGLES = 2000, 1 << 20
_DRAW = np.random.default_rng(5)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the different shingles, sorted; a shorter text is one shingle, one without words has none."""
    parts, tail = [], []
    for words in word_chunks(text or b"", LOWER):
        words = tail + words
        tail = words[1 - WORDS :]
        n = len(words) - WORDS + 1
        if n > 0:
            each = zip(*(islice(words, i, None) for i in range(WORDS)))
            parts.append(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s)) for s in each), np.uint64, n))
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tail))] if tail else [], np.uint64)
    return np.unique(np.concatenate(parts))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * _TIMES + _PLUS).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_keys(shingles(t)) for t in utf8(batch.column("text"))]
        rows = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), pa.int64())
        flat = pa.array([k for ks in keys for k in ks], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("t").take(rows), flat], ["t", "k"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t).tobytes() for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(sets, pa.binary())], ["t", "shingles"])


def alike(sets: list[np.ndarray], roots: np.ndarray) -> list[tuple[int, int]]:
    """Enough pairs of members to join all that are joined by shared shingles, at most one a member.

    One member at a time is counted against all later ones through the list of who has
    each shingle; members of one root are joined from the start.
    """
    n, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    label = np.unique(roots, return_inverse=True)[1]
    left, out = int(label.max()) + 1, []
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    by_name = np.argsort(name, kind="stable")
    holder, ends = np.repeat(np.arange(n), sizes)[by_name], np.cumsum(np.bincount(name))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(n - 1):
        if left == 1:
            break
        own = name[begin[i] : begin[i + 1]]
        low = np.where(own > 0, ends[own - 1], 0)
        count = ends[own] - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(holder[at], minlength=n)[i + 1 :]
        hits = np.flatnonzero(5 * both >= 4 * (sizes[i] + sizes[i + 1 :] - both)) + i + 1
        while len(hits := hits[label[hits] != label[i]]):
            out.append((i, int(hits[0])))
            label[label == label[hits[0]]] = label[i]
            left -= 1
    return out


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of roots that similar texts join; rows come sorted by (k, p, q), groups cut by a batch's end wait."""
    held: list[tuple] = []
    group = None

    def joined():
        roots = np.array([r for r, _ in held], np.int64)
        if len(held) < 2 or (roots == roots[0]).all():
            return
        pairs = alike([np.frombuffer(s, np.uint64) for _, s in held], roots)
        if pairs:
            ends = [roots[[p[side] for p in pairs]] for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], ["a", "b"])

    for batch in batches:
        for k, p, q, root, shared in zip(*(c.to_pylist() for c in batch.columns)):
            if (k, p, q) != group:
                yield from joined()
                held, group = [], (k, p, q)
            held.append((root, shared))
    yield from joined()


def merged(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(t, root): the group of every text hash, groups of ``groups`` (doc_id, k_hash, root) joined over similar texts.

    Only keys whose texts are of several groups are looked at. Their texts' shingle sets
    are made once, of one document for each text, and meet in the key's task; a crowded
    key is dealt in blocks of which every two meet in a task of their own. Tasks give
    back stars of groups, never pairs of texts.
    """
    spark = docs.sparkSession
    texts = docs.select(text_hash().alias("t"), "text")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    state = groups.groupBy(F.col("k_hash").alias("t")).agg(F.min("root").alias("root"), F.min(place).alias("place"))
    state, _ = keep_table(state, "groups")
    keys, at_keys = keep_table(map_arrow(texts, _bands, "t long, k long").distinct(), "bands")
    named = keys.join(state, "t")
    mixed = named.groupBy(F.col("k").alias("k2")).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    rows, at_rows = keep_table(
        named.join(mixed.where("low < high"), F.col("k") == F.col("k2")).select("k", "t", "root", "place"), "mixed"
    )
    forget(spark, at_keys)
    asked = rows.select(F.col("t").alias("k_hash"), F.col("place.doc_id").alias("k_id")).distinct()
    own = docs.select("doc_id", "text")
    wanted = own.join(asked, same_doc(own, asked)).select(F.col("k_hash").alias("t"), "text")
    sets, at_sets = keep_table(map_arrow(wanted, _sets, "t long, shingles binary").dropDuplicates(["t"]), "shingles")
    size = F.octet_length("shingles") / 8
    sized = rows.join(sets.select("t", size.alias("size")), "t")
    crowd = sized.groupBy(F.col("k").alias("k2")).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("parts")
    )
    dealt = (
        rows.join(crowd, F.col("k") == F.col("k2"))
        .withColumn("mine", F.pmod(F.xxhash64("t"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("k", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "t", "root")
        .join(sets, "t")
        .select("k", "p", "q", "root", "shingles")
        .repartition("k", "p", "q")
        .sortWithinPartitions("k", "p", "q")
    )
    links, at_links = keep_table(map_arrow(dealt, _alike, "a long, b long").distinct(), "alike")
    for path in (at_rows, at_sets):
        forget(spark, path)
    roots = components(links).withColumnRenamed("root", "to")
    joined = state.join(roots, F.col("root") == F.col("node"), "left").select("t", F.coalesce("to", "root").alias("root"))
    out, _ = keep_table(joined, "groups")
    forget(spark, at_links)
    return out
