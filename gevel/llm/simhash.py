"""Near copies by SimHash fingerprints, found with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm import similar
from gevel.llm.common import LOWER, forget, free_names, keep_table, known_id, map_arrow, text_hash, utf8, word_chunks
from gevel.llm.components import components

WORDS = 4
SEED = 42
BITS = 4
#: Five ring segments: with four differing bits allowed, a chain of l of them may hold 4l/5.
WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
#: Fingerprints of one key that are compared in one go.
BLOCK = 2000


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text; no words: zero."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_chunks(text or b"", LOWER):
        words = tail + words
        tail = words[1 - WORDS :]
        if len(words) < WORDS:
            continue
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(islice(words, i, None) for i in range(WORDS)))),
            np.uint64,
            len(words) - WORDS + 1,
        )
        total += len(hashes)
        for at in range(0, len(hashes), 1 << 16):
            rows = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    if total == 0:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in utf8(batch.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k_hash"), pa.array(prints.view(np.int64))],
            ["doc_id", "k_hash", "fp"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k_hash, fp) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("k_hash"), "text")
    return map_arrow(rows, _fingerprints, "doc_id long, k_hash long, fp long")


def ring_keys(nodes: DataFrame) -> DataFrame:
    """(k, fp): where a chain of a linked pair can start.

    By the pigeonring principle a pair within four bits has a segment from which
    every chain of l segments differs in at most 4l/5 bits: the first is equal,
    and of the second one bit at most differs, so that one of its halves is equal.
    """
    def part(start: int, width: int):
        return F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for i, (start, width) in enumerate(zip(STARTS, WIDTHS)):
        j = (i + 1) % len(WIDTHS)
        low = WIDTHS[j] // 2
        for half, (at, size) in enumerate(((STARTS[j], low), (STARTS[j] + low, WIDTHS[j] - low))):
            packed = part(start, width) * (1 << size) + part(at, size)
            keys.append(packed * 16 + F.lit(2 * i + half))
    return nodes.select(F.explode(F.array(*keys)).alias("k"), "fp")


def _chain_masks() -> np.ndarray:
    """masks[i][l]: the bits of l + 1 segments from segment i on, round the ring."""
    masks = np.zeros((len(WIDTHS), len(WIDTHS)), np.uint64)
    for i in range(len(WIDTHS)):
        bits = 0
        for step in range(len(WIDTHS)):
            j = (i + step) % len(WIDTHS)
            bits |= ((1 << WIDTHS[j]) - 1) << STARTS[j]
            masks[i, step] = bits
    return masks


MASKS = _chain_masks()


def linked(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences ``x`` keep all chain budgets from segment ``start``, and so four bits in all."""
    alive = np.arange(len(x))
    for step in range(1, len(WIDTHS)):
        budget = (step + 1) * BITS // len(WIDTHS)
        differ = np.bitwise_count(x[alive] & MASKS[start[alive], step])
        alive = alive[differ <= budget]
    return alive


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def stars(group: np.ndarray, fp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What links join, within runs of equal ``group``: every such row with the first of its kind.

    No more pairs than rows, and one step deep, so that few rounds are left to join them.
    """
    n, parent = len(fp), list(range(len(fp)))
    label, at = np.arange(n), np.arange(n)
    for d in range(1, n):
        at = at[at + d < n]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        hits = at[linked(fp[at] ^ fp[at + d], start[at])]
        hits = hits[label[hits] != label[hits + d]]
        for i in hits.tolist():
            a, b = _find(parent, i), _find(parent, i + d)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(hits):
            label = np.array(parent)
            while (jumped := label[label]).tobytes() != label.tobytes():
                label = jumped
    joined = np.flatnonzero(label != np.arange(n))
    return fp[label[joined]], fp[joined]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (k, p, q); a group cut by a batch's end waits for the next."""
    held = [np.empty(0, np.int64)] * 4

    def links(k, p, q, fp):
        step = np.ones(len(k), bool)
        step[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        a, b = stars(np.cumsum(step), fp.view(np.uint64), (k % 16) // 2)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
        k, p, q, _ = cols
        if not len(k):
            continue
        last = (k != k[-1]) | (p != p[-1]) | (q != q[-1])
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield links(*(c[:cut] for c in cols))
    if len(held[0]):
        yield links(*held)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): enough links between different fingerprints to reach all that is reachable.

    A crowded key is cut into blocks and every two blocks meet in a task of their
    own, so no task holds more than two blocks; a task gives back stars.
    """
    keys = ring_keys(nodes)
    crowd = keys.groupBy(F.col("k").alias("k2")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK)
    rows = (
        keys.join(crowd, F.col("k") == F.col("k2"))
        .withColumn("parts", parts)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("k", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "fp")
    )
    dealt = rows.repartition("k", "p", "q").sortWithinPartitions("k", "p", "q")
    return map_arrow(dealt, _links, "a long, b long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` with its group: (doc_id, k_hash, fp, root, component_id).

    Rows link when their fingerprints differ in at most four bits; a group is what
    links reach, named by its smallest doc_id. Equal fingerprints are one node, so
    exact copies never meet in pairs.

    Null text counts as empty; empty texts have fingerprint zero and link like any
    other. Null doc_id: the row is in its group but never names it; a group of such
    rows only has component_id null. Repeated rows are kept. No rows: no rows.
    """
    prints, _ = keep_table(fingerprints(docs), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp")))
    classed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = classed.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    named = classed.join(names, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return prints.join(named, prints["fp"] == named["f"]).select("doc_id", "k_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, by_shingles: bool = False) -> DataFrame:
    """``docs`` with one document of each group of near copies: the smallest doc_id.

    Groups are those of ``near_copies``, ``by_shingles`` joined where texts share four
    fifths of their five-word shingles. Of a group without any doc_id the smallest text hash stays; of
    repeated rows one.

    Null texts count as empty, and empty texts are copies of each other. Very long texts
    are read in pieces. Further columns, whatever their names, come back as they were. No
    rows: no rows.
    """
    spark = docs.sparkSession
    groups, path = keep_table(near_copies(docs).select("doc_id", "k_hash", "root"), "near-copies")
    if by_shingles:
        roots = similar.merged(docs, groups)
        groups = groups.drop("root").join(roots, F.col("k_hash") == F.col("t")).drop("t")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("k_hash"))
    best = groups.groupBy("root").agg(F.min(order).alias("m"))
    keys, _ = keep_table(best.select(known_id(F.col("m.doc_id")).alias("i"), F.col("m.k_hash").alias("h")), "kept")
    forget(spark, path)
    own = free_names(docs, "llm_id", "llm_hash")
    keyed = docs.withColumns({own[0]: known_id(F.col("doc_id")), own[1]: text_hash()})
    return keyed.join(keys.toDF(*own), own, "left_semi").dropDuplicates(own).drop(*own)


def digest(groups: DataFrame) -> DataFrame:
    return groups.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
