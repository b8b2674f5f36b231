"""Removal of repeated word windows, with suffix trees in prefix partitions.

A window of 20 words is filed under its anchor: the place of the smallest hashed word
pair among its first 13. Equal windows have equal anchors at equal distance d, and all
windows of one anchor hold the ``SHARED`` words after it. So the suffixes that begin at
anchors, split by those words as prefix, are enough: a window is a node of the tree
right of its anchor, 20 - d words deep, with a node of the mirrored tree left of it, d
words deep. A run of windows with one anchor and its words is a context.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import forget, keep_table, map_arrow, same_doc, text_hash, utf8, word_chunks

SPAN = 20
#: Starts among whose word pairs the anchor is the smallest.
WINDOW = 13
#: Words from an anchor on that are in all its windows: the shortest prefix.
SHARED = SPAN - WINDOW + 1
#: Words of the longer prefixes that split a crowded one.
LONGER = (12, 16)
#: Contexts of one prefix that a task takes into one subtree.
CROWD = 20000
#: Bytes of text that are looked at together; below 2**20.
PACK = 1 << 19
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
_GAP_AT = re.compile(rb"[\x20\x09-\x0D]")
_MASK = np.uint64((1 << 20) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence, from running sums modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, down = (np.full(n + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def packs(texts: list[bytes | None]) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """(bytes, where texts begin in them, their rows, words before), about ``PACK`` bytes at a time.

    A longer text is cut at gaps; the last 19 words of a piece open the next one, so that
    every window lies in one piece.
    """
    parts: list[bytes] = []
    at, rows, before, size = [], [], [], 0
    for row, text in enumerate(texts):
        start = words = 0
        text = text or b""
        while True:
            end = len(text)
            piece = text
            if end - start > PACK:
                found = _GAP_AT.search(text, start + PACK)
                while found and len(text[start : found.start()].split(None, SPAN)) <= SPAN:
                    found = _GAP_AT.search(text, found.end() + PACK)
                end = found.start() if found else len(text)
            if start or end < len(text):
                piece = text[start:end]
            at.append(size)
            rows.append(row)
            before.append(words)
            parts.append(piece)
            size += len(piece) + 1
            if size >= PACK:
                yield b" ".join(parts), at, rows, before
                parts, at, rows, before, size = [], [], [], [], 0
            if end == len(text):
                break
            words += len(piece.split()) - (SPAN - 1)
            start = end - (len(piece) - len(piece.rsplit(None, SPAN - 1)[0]))
    if rows:
        yield b" ".join(parts), at, rows, before


def contexts(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, prefix hash, context hash, first start, last start, anchor) of all contexts; places count words."""
    for data, at, rows, before in packs(texts):
        raw = np.frombuffer(data, np.uint8)
        word = np.concatenate([[False], ~_GAP[raw], [False]])
        turns = np.flatnonzero(word[1:] != word[:-1])
        start, end = turns[::2], turns[1::2]
        n = len(start)
        if n < SPAN:
            continue
        names = Rolling(raw.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15).of(start, end)
        text = np.searchsorted(at, start, "right") - 1
        first_word = np.searchsorted(start, at)
        pair = mix(names[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + names[1:])
        low = (pair & ~_MASK) | np.arange(n - 1, dtype=np.uint64)
        four = np.minimum(low[:-1], low[1:])
        four = np.minimum(four[:-2], four[2:])
        eight = np.minimum(four[:-4], four[4:])
        best = np.minimum(eight[: n - SPAN + 1], eight[WINDOW - 8 :][: n - SPAN + 1])
        starts = np.flatnonzero(text[: n - SPAN + 1] == text[SPAN - 1 :])
        if not len(starts):
            continue
        anchor = (best[starts] & _MASK).astype(np.int64)
        turn = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
        lo = starts[np.concatenate([[0], turn])]
        hi = starts[np.concatenate([turn - 1, [len(starts) - 1]])]
        a = anchor[np.concatenate([[0], turn])]
        prefix = Rolling(names, 0xD6E8FEB86659FD93).of(a, a + SHARED)
        whole = Rolling(mix(names), 0xA0761D6478BD642F).of(lo, hi + SPAN)
        whole = mix(whole + (a - lo).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        own = text[lo]
        shift = np.array(before)[own] - first_word[own]
        yield np.array(rows)[own], prefix.view(np.int64), whole.view(np.int64), lo + shift, hi + shift, a + shift


PLACE = "c long, h long, doc_id long, k_hash long, lo int, hi int, anchor int"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [c for _, c, *_ in contexts(utf8(batch.column("text")))]
        if found:
            c, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["c", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, c, h, lo, hi, a in contexts(utf8(batch.column("text"))):
            ids = [batch.column(x).take(pa.array(row)) for x in ("doc_id", "k_hash")]
            ends = [pa.array(x.astype(np.int32)) for x in (lo, hi, a)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c), pa.array(h), *ids, *ends], ["c", "h", "doc_id", "k_hash", "lo", "hi", "anchor"]
            )


def stretches(text: bytes, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    """The words of each (first, end) in ``spans``, joined by blanks; spans come sorted by first."""
    held: list[bytes] = []
    before, chunks = 0, word_chunks(text)
    for first, end in spans:
        while before + len(held) < end:
            keep = max(0, min(first - before, len(held)))
            held, before = held[keep:] + next(chunks), before + keep
        yield b" ".join(held[first - before : end - before])


MEMBER = "c long, h long, bit long, no_id boolean, doc_id long, k_hash long, left int, width int, anchor int, words string"
_NAMES = [x.split()[0] for x in MEMBER.split(", ")]
_KINDS = [*[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 2, *[pa.int32()] * 3, pa.string()]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts with their words; ``left`` of them stand before the anchor."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist(), batch.column("k_hash").to_pylist()
        out = []
        for i, (text, asks) in enumerate(zip(utf8(batch.column("text")), batch.column("asks").to_pylist())):
            asks.sort(key=lambda x: x["lo"])
            words = stretches(text or b"", [(x["lo"], x["hi"] + SPAN) for x in asks])
            own = ids[0][i] is None, ids[0][i], ids[1][i]
            for x, w in zip(asks, words):
                out.append((x["c"], x["h"], 1, *own, x["anchor"] - x["lo"], x["hi"] - x["lo"], x["anchor"], w.decode()))
        columns = zip(*out) if out else [[]] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, _KINDS)], _NAMES)


def aligned(words: pa.Array, left: np.ndarray) -> np.ndarray:
    """A row of word codes for each context, anchors in one column, -1 where there is no word."""
    lists = pc.split_pattern(words, " ")
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    count = np.diff(offsets)
    row = np.repeat(np.arange(len(count)), count)
    out = np.full((len(count), WINDOW - 1 + SPAN + WINDOW), -1, np.int64)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], count) + (WINDOW - 1 - left)[row]] = codes[: len(row)]
    return out


def deeper(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Nodes one word down: equal node and equal word; -1 for what is alone, or has no word left.

    A suffix alone in its node is a leaf, and no deeper node has it.
    """
    out = np.full(len(node), -1, np.int64)
    live = np.flatnonzero((node >= 0) & (word >= 0))
    if len(live):
        _, inverse, count = np.unique(
            node[live] * (int(word.max()) + 1) + word[live], return_inverse=True, return_counts=True
        )
        out[live] = np.where(count[inverse] > 1, inverse, -1)
    return out


def later_windows(
    group: np.ndarray, codes: np.ndarray, left: np.ndarray, width: np.ndarray, rank: np.ndarray
) -> np.ndarray:
    """A bit for each distance d at which a context's window stands in another of its group with lower rank.

    The subtree right of the prefix and its mirror to the left grow word by word,
    members alone in a node dropping out. A window of distance d is shared by those that
    are together 20 - d words to the right and d words to the left.
    """
    zero = WINDOW - 1
    right = [deeper(group, codes[:, zero])]
    for r in range(1, SPAN):
        right.append(deeper(right[-1], codes[:, zero + r]))
    mask, mirror = np.zeros(len(group), np.int64), group
    for d in range(WINDOW):
        if d:
            mirror = deeper(mirror, codes[:, zero - d])
        node = right[SPAN - d - 1]
        live = np.flatnonzero((node >= 0) & (mirror >= 0) & (left - width <= d) & (d <= left))
        if not len(live):
            continue
        _, both = np.unique(node[live] * (int(mirror.max()) + 1) + mirror[live], return_inverse=True)
        first = np.full(both.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, both, rank[live])
        mask[live] |= np.where(rank[live] > first[both], 1 << d, 0)
    return mask


FOUND = "c long, h long, mask long"


def _solved(table: pa.Table) -> pa.RecordBatch:
    """``mask`` of the contexts of whole groups."""
    c, h, bit = (table[x].to_numpy() for x in ("c", "h", "bit"))
    # a repeated row brings its contexts again
    alone = np.unique(np.stack([c, h, bit]), axis=1, return_index=True)[1]
    table = table.take(pa.array(alone)).combine_chunks()
    group = np.unique(table["key"].to_numpy(), return_inverse=True)[1]
    left, width, bit = (table[x].to_numpy() for x in ("left", "width", "bit"))
    by = [(x, "ascending") for x in ("no_id", "doc_id", "k_hash", "anchor")]
    rank = np.empty(len(table), np.int64)
    rank[pc.sort_indices(table, by).to_numpy()] = np.arange(len(table))
    mask = later_windows(group, aligned(table["words"].chunk(0), left), left, width, rank)
    hit = pa.array(np.flatnonzero(mask))
    columns = [table[x].chunk(0).take(hit) for x in ("c", "h")]
    return pa.RecordBatch.from_arrays([*columns, pa.array((mask * bit)[mask > 0])], ["c", "h", "mask"])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by ``key``; groups are taken together, some thousand contexts at a time."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, CROWD // 4
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < enough:
            continue
        table = pa.Table.from_batches(held)
        key = table["key"].to_numpy()
        turn = np.flatnonzero(key != key[-1])
        if len(turn):
            cut = int(turn[-1]) + 1
            yield _solved(table.slice(0, cut))
            held, n = table.slice(cut).to_batches(), n - cut
        enough = max(CROWD // 4, 2 * n)
    if n:
        yield _solved(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a context as a context of its own that begins at its anchor; ``bit`` says which it was."""
    for batch in batches:
        row, d, words = [], [], []
        for i, x in enumerate(batch.select(["left", "width", "words"]).to_pylist()):
            split = x["words"].split(" ")
            for start in range(x["width"] + 1):
                row.append(i)
                d.append(x["left"] - start)
                words.append(" ".join(split[start : start + SPAN]))
        taken, d = batch.take(pa.array(row, pa.int64())), np.array(d, np.int64)
        zeros = pa.array(np.zeros(len(d), np.int32))
        anchor = pa.array((taken.column("anchor").to_numpy() - d).astype(np.int32))
        own = {"bit": pa.array(1 << d), "left": zeros, "width": zeros, "anchor": anchor, "words": pa.array(words, pa.string())}
        yield pa.RecordBatch.from_arrays([own[x] if x in own else taken.column(x) for x in _NAMES], _NAMES)


def _grown(members: DataFrame) -> DataFrame:
    """``mask`` of all contexts in subtrees by ``key``."""
    own = members.select("key", *_NAMES)
    return map_arrow(own.repartition("key").sortWithinPartitions("key"), _subtrees, FOUND)


def _crowded(members: DataFrame, crowd: int) -> DataFrame:
    """``mask`` of contexts whose prefix is crowded: their windows by longer prefixes, of variable length.

    A window gets the shortest of the longer prefixes with at most ``crowd`` windows.
    One that is crowded up to all its 20 words is a single node, whose first place is an
    aggregate.
    """
    rows, _ = keep_table(map_arrow(members, _windows, MEMBER), "windows")
    parts = []
    for words in LONGER:
        keyed = rows.withColumn("key", F.xxhash64("c", "bit", F.substring_index("words", " ", words)))
        many = keyed.groupBy(F.col("key").alias("k2")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
        parts.append(_grown(keyed.join(many, F.col("key") == F.col("k2"), "left_anti")))
        rows, _ = keep_table(keyed.join(many, F.col("key") == F.col("k2"), "left_semi").select(*_NAMES), "crowded")
    place = F.struct("no_id", "doc_id", "k_hash", "anchor")
    first = rows.groupBy(F.col("bit").alias("b2"), F.col("words").alias("w2")).agg(F.min(place).alias("first"))
    later = rows.join(first, (F.col("bit") == F.col("b2")) & (F.col("words") == F.col("w2")))
    parts.append(later.where(place != F.col("first")).select("c", "h", F.col("bit").alias("mask")))
    return reduce(DataFrame.unionByName, parts).groupBy("c", "h").agg(F.bit_or("mask").alias("mask"))


def repeated_starts(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, k_hash, first, last): ranges of starts, in words, whose window also starts earlier.

    1. Prefixes are counted: the ``SHARED`` words after each anchor. A prefix that stands
       once has one suffix, and no window of it repeats.
    2. Of the other prefixes every different context is kept once, at its first place, with
       its words; all windows at its other places repeat.
    3. Contexts are partitioned by prefix, a subtree grows over each, and its nodes deep
       enough for a whole window give the repeats. Prefixes with more than ``crowd``
       contexts are split by longer ones.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("doc_id", text_hash().alias("k_hash"), "text")
    counted = map_arrow(rows.select("text"), _prefixes, "c long, n long").groupBy(F.col("c").alias("c2"))
    often, at_often = keep_table(counted.agg(F.sum("n").alias("n")).where("n > 1").select("c2"), "prefixes")
    again, _ = keep_table(
        map_arrow(rows, _places, PLACE).join(often, F.col("c") == F.col("c2"), "left_semi"), "places"
    )
    forget(docs.sparkSession, at_often)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k_hash", "anchor", "lo", "hi")
    firsts, _ = keep_table(again.groupBy("c", "h").agg(F.min(order).alias("first")), "contexts")
    asks = firsts.groupBy(F.col("first.doc_id").alias("k_id"), F.col("first.k_hash").alias("k_hash")).agg(
        F.collect_list(F.struct("c", "h", "first.lo", "first.hi", "first.anchor")).alias("asks")
    )
    asked = docs.join(asks, same_doc(docs, asks)).select(docs["doc_id"], "k_hash", docs["text"], "asks")
    members, at_members = keep_table(map_arrow(asked, _members, MEMBER), "members")
    crowded = members.groupBy(F.col("c").alias("c2")).agg(F.count(F.lit(1)).alias("n"))
    crowded, _ = keep_table(crowded.where(F.col("n") > crowd).select("c2"), "crowded-prefixes")
    is_crowded = F.col("c") == F.col("c2")
    found = _grown(members.join(crowded, is_crowded, "left_anti").withColumn("key", F.col("c")))
    if not crowded.isEmpty():
        found = found.unionByName(_crowded(members.join(crowded, is_crowded, "left_semi"), crowd))
    found, _ = keep_table(found, "repeats")
    forget(docs.sparkSession, at_members)
    found = found.withColumnsRenamed({"c": "fc", "h": "fh"})
    # a table, so that Spark can split the places of one context that stands very often
    known = firsts.join(found, (F.col("c") == F.col("fc")) & (F.col("h") == F.col("fh")), "left").select(
        F.col("c").alias("kc"), F.col("h").alias("kh"), "first", F.coalesce("mask", F.lit(0)).alias("mask")
    )
    known, _ = keep_table(known, "known")
    placed = again.join(known, (F.col("c") == F.col("kc")) & (F.col("h") == F.col("kh")))
    later = order != F.col("first")
    whole = F.array(F.struct(F.col("lo").alias("first"), F.col("hi").alias("last")))
    some = F.filter(
        F.sequence(F.col("anchor") - F.col("hi"), F.col("anchor") - F.col("lo")), lambda d: F.getbit("mask", d) == 1
    )
    single = F.transform(some, lambda d: F.struct((F.col("anchor") - d).alias("first"), (F.col("anchor") - d).alias("last")))
    spans = placed.where(later | (F.col("mask") != 0)).select(
        "doc_id", "k_hash", F.explode(F.when(later, whole).otherwise(single)).alias("span")
    )
    return spans.select("doc_id", "k_hash", "span.first", "span.last")


def word_spans(starts: list[dict]) -> list[tuple[int, int]]:
    """The words that windows starting in the ranges cover, as sorted (first, end) that do not touch."""
    out: list[list[int]] = []
    for first, end in sorted((x["first"], x["last"] + SPAN) for x in starts):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


KEPT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        counts, spans, kept = [], [], []
        starts = batch.column("starts").to_pylist()
        for i, text in enumerate(utf8(batch.column("text"))):
            gone, n, parts, turn = word_spans(starts[i] or []), 0, [], 0
            for words in word_chunks(text or b""):
                at, end = n, n + len(words)
                while turn < len(gone) and gone[turn][0] < end:
                    parts += words[at - n : max(0, gone[turn][0] - n)]
                    at = max(at, min(gone[turn][1], end))
                    if gone[turn][1] > end:
                        break
                    turn += 1
                parts += words[at - n :]
                if len(parts) > 1:
                    parts = [b" ".join(parts)]
                n = end
            counts.append(n)
            spans.append([{"start": a, "end": b} for a, b in gone])
            kept.append(b" ".join(parts).decode())
        columns = [pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "spans", "kept"])


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Each row of ``docs`` in words: n_words, the spans removed (end exclusive), the words kept, joined by blanks.

    A word goes if a window of 20 words over it also starts earlier: in a document with a
    smaller doc_id, or before in the same one. The first place of every window stays, and
    windows are judged on the input as it is. A span is a maximal repeat or several that
    overlap.

    Null text: no words. Texts under 20 words are kept. Rows with the same doc_id and
    text are one document and get the same result; different texts under one doc_id
    order by their hash. Null doc_ids order last. Very long texts are looked at piece by
    piece, and are one document all the same. No rows: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    starts = repeated_starts(docs, crowd).groupBy(F.col("doc_id").alias("k_id"), "k_hash").agg(
        F.collect_list(F.struct("first", "last")).alias("starts")
    )
    joined = docs.join(starts, same_doc(docs, starts), "left").select(docs["doc_id"], docs["text"], "starts")
    return map_arrow(joined, _kept, KEPT)


def digest(kept: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return kept.select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("changed"),
        F.col("kept").alias("kept_text"),
    )


SQL = f"""with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(len(w) - {SPAN - 1})) as i from d where len(w) >= {SPAN}),
r as (select doc_id, i from (
    select doc_id, i, row_number() over (partition by array_to_string(list_slice(w, i + 1, i + {SPAN}), ' ')
      order by doc_id, i) as k from s) where k > 1),
g as (select distinct doc_id, i + unnest(range({SPAN})) as p from r),
k as (select d.doc_id, list(x.word order by x.p) as kept from d
  join (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from d) x on x.doc_id = d.doc_id
  where not exists (select 1 from g where g.doc_id = x.doc_id and g.p = x.p) group by d.doc_id),
a as (select d.doc_id, len(d.w) as n, coalesce(array_to_string(k.kept, ' '), '') as t,
    coalesce(len(k.kept), 0) as m from d left join k on d.doc_id = k.doc_id)
select doc_id, cast(n as bigint) as n_words, cast(n - m as bigint) as n_removed, sha256(t) as kept_sha256,
  n > m as changed, t as kept_text
from a"""
