"""Removal of repeated 400-byte strings, with a sparse suffix array in range partitions.

A 400-byte string starting at s is filed under its anchor: the place of the smallest
hashed 8-gram among its first 256. Equal strings have equal anchors at equal distance,
so it is enough to sort the suffixes that begin at anchors, one byte position in about
130, instead of all. Strings of one anchor differ only in where they start, d bytes
before it; a run of such starts with its bytes is a context.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import keep_table, map_arrow, same_doc, text_hash, utf8

SPAN = 400
#: Start positions among whose 8-grams the anchor is the smallest; a power of two.
WINDOW = 256
#: Bytes after an anchor that are in all its strings.
SHARED = SPAN - WINDOW + 1
#: Leading bytes by which suffixes are dealt into ranges.
LEAD = 64
#: Contexts of one anchor string that a bucket compares; more go by digests of their strings.
CROWD = 20000
#: Suffixes that are compared pair by pair rather than start by start.
FEW = 24
#: Starts that are handled at once in a very long text; below 2**24.
STEP = 1 << 22


def anchors(text: bytes) -> Iterator[tuple[int, int, int]]:
    """(first start, last start, anchor) of the runs of starts that share an anchor."""
    starts = len(text) - SPAN + 1
    place = np.uint64((1 << 24) - 1)
    for base in range(0, starts, STEP):
        count = min(STEP, starts - base)
        grams = np.ndarray((count + SPAN - 8,), "<u8", text, base, (1,))
        low = grams * np.uint64(0x9E3779B97F4A7C15)
        low ^= low >> np.uint64(32)
        low *= np.uint64(0xC2B2AE3D27D4EB4F)
        low &= ~place
        low |= np.arange(len(low), dtype=np.uint64)
        size = 1
        while size < WINDOW:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        at = (low[:count] & place).astype(np.int64)
        turns = np.flatnonzero(at[1:] != at[:-1])
        first = np.concatenate([[0], turns + 1])
        last = np.concatenate([turns, [count - 1]])
        yield from zip((first + base).tolist(), (last + base).tolist(), (at[first] + base).tolist())


PLACE = "c long, h long, doc_id long, k_hash long, times long, lo long, hi long, anchor long, width int"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts by hash: ``c`` of the shared bytes after the anchor, ``h`` of all bytes.

    Equal contexts in a row, as in a text that repeats itself, make one record.
    """
    for batch in batches:
        row, made = [], []
        for i, text in enumerate(utf8(batch.column("text"))):
            if text is None or len(text) < SPAN:
                continue
            view, last = memoryview(text), None
            for lo, hi, a in anchors(text):
                c = xxhash.xxh64_intdigest(view[a : a + SHARED])
                h = xxhash.xxh3_64_intdigest(view[lo : hi + SPAN])
                if last is not None and last[0] == c and last[1] == h:
                    last[2] += 1
                    last[4] = hi
                    continue
                last = [c, h, 1, lo, hi, a, hi - lo]
                row.append(i)
                made.append(last)
        rows = pa.array(row, pa.int64())
        c, h, times, lo, hi, anchor, width = zip(*made) if made else [[]] * 7
        signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (c, h)]
        plain = [pa.array(x, pa.int64()) for x in (times, lo, hi, anchor)]
        ids = [batch.column(x).take(rows) for x in ("doc_id", "k_hash")]
        yield pa.RecordBatch.from_arrays(
            [*signed, *ids, *plain, pa.array(width, pa.int32())],
            ["c", "h", "doc_id", "k_hash", "times", "lo", "hi", "anchor", "width"],
        )


CONTEXT = "lead binary, c long, h long, times long, cut int, data binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts asked for, with their bytes; ``cut`` is where the anchor lies in them."""
    for batch in batches:
        lead, data, cut, c, h, times = [], [], [], [], [], []
        asks = batch.column("asks").to_pylist()
        for i, text in enumerate(utf8(batch.column("text"))):
            for x in asks[i]:
                lead.append(text[x["anchor"] : x["anchor"] + LEAD])
                data.append(text[x["lo"] : x["lo"] + x["width"] + SPAN])
                cut.append(x["anchor"] - x["lo"])
                c.append(x["c"])
                h.append(x["h"])
                times.append(x["times"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(lead, pa.binary()),
                pa.array(c, pa.int64()),
                pa.array(h, pa.int64()),
                pa.array(times, pa.int64()),
                pa.array(cut, pa.int32()),
                pa.array(data, pa.binary()),
            ],
            ["lead", "c", "h", "times", "cut", "data"],
        )


def multikey_quicksort(suffixes: list[bytes]) -> list[int]:
    """Order of ``suffixes``: three-way partitions on eight bytes at a time, equal ones go on to the next eight."""
    if not suffixes:
        return []
    words = -(-max(map(len, suffixes)) // 8) or 1
    table = np.frombuffer(b"".join(s.ljust(8 * words, b"\0") for s in suffixes), ">u8").reshape(-1, words)
    out: list[int] = []
    stack = [(np.arange(len(suffixes)), 0)]
    while stack:
        at, depth = stack.pop()
        if len(at) <= 32 or depth == words:
            out.extend(sorted(at.tolist(), key=lambda i: suffixes[i][8 * depth :]))
            continue
        keys = table[at, depth]
        pivot = np.sort(keys[[0, len(keys) // 2, -1]])[1]
        stack.append((at[keys > pivot], depth))
        stack.append((at[keys == pivot], depth + 1))
        stack.append((at[keys < pivot], depth))
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if n == 0:
        return 0
    differ = int.from_bytes(a[-n:], "big") ^ int.from_bytes(b[-n:], "big")
    return n if differ == 0 else ((differ & -differ).bit_length() - 1) // 8


def repeats(cuts: list[int], datas: list[bytes]) -> list[list[tuple[int, int]]]:
    """For contexts of one anchor string: the ranges of d whose string another context has too."""
    spans: list[list[tuple[int, int]]] = [[] for _ in datas]
    low = [cut - (len(data) - SPAN) for cut, data in zip(cuts, datas)]
    if len(datas) <= FEW:
        for j in range(len(datas)):
            for i in range(j):
                right = common_prefix(datas[i][cuts[i] :], datas[j][cuts[j] :])
                left = common_suffix(datas[i][: cuts[i]], datas[j][: cuts[j]])
                first, last = max(SPAN - right, low[i], low[j]), min(left, cuts[i], cuts[j])
                if first <= last:
                    spans[i].append((first, last))
                    spans[j].append((first, last))
        return spans
    for d in range(min(low), max(cuts) + 1):
        seen: dict[bytes, int] = {}
        for i, data in enumerate(datas):
            if low[i] <= d <= cuts[i]:
                j = seen.setdefault(data[cuts[i] - d : cuts[i] - d + SPAN], i)
                if j != i:
                    spans[i].append((d, d))
                    if not spans[j] or spans[j][-1] != (d, d):
                        spans[j].append((d, d))
    return spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted whole-number ranges, ends included, joined where they meet."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


FOUND = "c long, h long, first int, last int"


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of suffixes: sort, then compare the neighbours that share an anchor string."""
    c, h, times, cut, data = [], [], [], [], []
    for batch in batches:
        c += batch.column("c").to_pylist()
        h += batch.column("h").to_pylist()
        times += batch.column("times").to_pylist()
        cut += batch.column("cut").to_pylist()
        data += batch.column("data").to_pylist()
    # a repeated row brings its contexts again
    alone = list({key: i for i, key in enumerate(zip(c, h))}.values())
    order = [alone[i] for i in multikey_quicksort([data[i][cut[i] :] for i in alone])]
    shared = [x[k : k + SHARED] for x, k in zip(data, cut)]
    turns = [0, *(n for n, (i, j) in enumerate(pairwise(order), 1) if shared[i] != shared[j]), len(order)]
    rows = []
    for start, end in pairwise(turns):
        own = order[start:end]
        for i, spans in zip(own, repeats([cut[i] for i in own], [data[i] for i in own])):
            if times[i] > 1:  # the whole context stands somewhere else
                spans = [(cut[i] - (len(data[i]) - SPAN), cut[i])]
            rows += [(c[i], h[i], a, b) for a, b in _merged(spans)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    columns = zip(*rows) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["c", "h", "first", "last"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of crowded contexts by 128-bit digest, one row each, some thousands at a time."""

    def flush(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
            ["c", "h", "times", "d", "digest"],
        )

    for batch in batches:
        rows = []
        for c, h, times, cut, data in zip(*(batch.column(x).to_pylist() for x in ("c", "h", "times", "cut", "data"))):
            for start in range(len(data) - SPAN + 1):
                string = memoryview(data)[start : start + SPAN]
                rows.append((c, h, times, cut - start, xxhash.xxh3_128_digest(string)))
            if len(rows) > 20000:
                yield flush(rows)
                rows = []
        if rows:
            yield flush(rows)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, k_hash, first, last): ranges of starts whose 400 bytes also start somewhere else.

    1. Contexts are counted by hash; those whose anchor string is unique cannot repeat.
    2. A context that occurs twice repeats as a whole. Where an anchor string has
       different contexts, one of each is fetched with its bytes.
    3. Their suffixes are range-partitioned by leading bytes with sampled splitters,
       sorted by multikey quicksort in each range, and neighbours with the same anchor
       string are compared byte by byte. Equal leading bytes share a range, so no
       comparison crosses a border.
    4. An anchor string with more than ``CROWD`` contexts, which one task should not
       hold, is settled by counting digests of its strings instead: the same answer.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("doc_id", text_hash().alias("k_hash"), "text")
    places, _ = keep_table(map_arrow(rows, _places, PLACE), "places")
    often = (
        places.groupBy(F.col("c").alias("c2"))
        .agg(F.sum("times").alias("n"), (F.min("h") != F.max("h")).alias("mixed"))
        .where("n > 1")
    )
    again, _ = keep_table(
        places.join(often, F.col("c") == F.col("c2")).select(*places.columns, "mixed"), "again"
    )
    whole = again.where("not mixed").select("doc_id", "k_hash", F.col("lo").alias("first"), F.col("hi").alias("last"))
    mixed = again.where("mixed")
    spot = F.struct("k_hash", "doc_id", "lo", "anchor", "width")
    contexts, _ = keep_table(
        mixed.groupBy("c", "h").agg(F.sum("times").alias("times"), F.min(spot).alias("spot")), "contexts"
    )
    crowded = contexts.groupBy(F.col("c").alias("c2")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    crowded, _ = keep_table(crowded.select("c2"), "crowded")

    def with_bytes(some: DataFrame) -> DataFrame:
        ask = F.struct("c", "h", "times", F.col("spot.lo"), F.col("spot.anchor"), F.col("spot.width"))
        asks = some.groupBy(F.col("spot.doc_id").alias("k_id"), F.col("spot.k_hash").alias("k_hash")).agg(
            F.collect_list(ask).alias("asks")
        )
        asked = docs.join(asks, same_doc(docs, asks)).select(docs["text"], "asks")
        return map_arrow(asked, _contexts, CONTEXT)

    is_crowded = F.col("c") == F.col("c2")
    few = with_bytes(contexts.join(crowded, is_crowded, "left_anti"))
    found = map_arrow(few.repartitionByRange("lead"), _bucket, FOUND)
    if not crowded.isEmpty():
        strings = "c long, h long, times long, d int, digest binary"
        many = map_arrow(with_bytes(contexts.join(crowded, is_crowded, "left_semi")), _digests, strings)
        many, _ = keep_table(many.dropDuplicates(["c", "h", "d"]), "digests")
        twice = many.groupBy(F.col("digest").alias("g")).agg(F.sum("times").alias("n")).where("n > 1").select("g")
        d = F.col("d")
        found = found.unionByName(
            many.join(twice, F.col("digest") == F.col("g")).select("c", "h", d.alias("first"), d.alias("last"))
        )
    found = found.withColumnsRenamed({"c": "fc", "h": "fh", "first": "near", "last": "far"})
    # of a record that stands for several equal contexts, the whole range repeats
    several = F.col("times") > 1
    part = mixed.join(found, (F.col("c") == F.col("fc")) & (F.col("h") == F.col("fh"))).select(
        "doc_id",
        "k_hash",
        F.when(several, F.col("lo")).otherwise(F.col("anchor") - F.col("far")).alias("first"),
        F.when(several, F.col("hi")).otherwise(F.col("anchor") - F.col("near")).alias("last"),
    )
    return whole.unionByName(part)


KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, spans, kept = [], [], []
        starts = batch.column("starts").to_pylist()
        for i, text in enumerate(utf8(batch.column("text"))):
            text = text or b""
            gone = _merged([(x["first"], x["last"] + SPAN - 1) for x in starts[i] or ()])
            at, parts = 0, []
            for a, b in gone:
                parts.append(text[at:a])
                at = b + 1
            parts.append(text[at:])
            sizes.append(len(text))
            spans.append([{"start": a, "end": b + 1} for a, b in gone])
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as UTF-8 bytes: n_bytes, the spans removed (end exclusive), the bytes kept.

    A byte goes if a 400-byte string over it also starts anywhere else in the table, in
    the same text or another; all copies go, judged on the input as it is.

    Null text: empty. Texts under 400 bytes are kept. Repeated rows are two places, so
    they lose what is 400 bytes or longer. Null doc_id: a document like others. No
    rows: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = repeated_starts(docs)
    starts = ranges.groupBy(F.col("doc_id").alias("k_id"), "k_hash").agg(
        F.collect_list(F.struct("first", "last")).alias("starts")
    )
    joined = docs.join(starts, same_doc(docs, starts), "left").select(
        docs["doc_id"], docs["text"], "starts"
    )
    return map_arrow(joined, _kept, KEPT)


def digest(kept: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return kept.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("changed"),
        # where a cut falls inside a character, the replacement character stands for its rest
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )
