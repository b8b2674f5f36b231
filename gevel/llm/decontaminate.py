"""Passages of benchmark items in documents, by Wu-Manber search over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import ALNUM, keep_table, map_arrow, same_doc, text_hash, utf8, word_chunks

WINDOW = 10
#: Words of a block in the shift tables.
BLOCK = 3
#: Bytes of item texts that are searched for in one pass over the documents; tables take some eight times that, unlike words included.
PASS_BYTES = 16 << 20
#: What mixes word numbers.
_TIMES, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1

FOUND = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def item_words(text: bytes | None) -> list[bytes]:
    return [w for words in word_chunks(text or b"", ALNUM) for w in words]


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers, best in its leading bits."""
    out = np.zeros(len(ids), np.uint64)
    for column in ids.T.astype(np.uint64):
        out = (out + column + np.uint64(1)) * np.uint64(_TIMES)
    return out


def _leading(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class Length:
    """Wu-Manber tables for the test strings of one length, in numbered words.

    Flat arrays: the least shift of a block by its hash, and test strings by the hash of
    their last block, as rows of word numbers with their items.
    """

    def __init__(self, windows: np.ndarray, owners: np.ndarray):
        """``windows`` has a row of word numbers for each test string, ``owners`` its item."""
        self.size = size = windows.shape[1]
        self.block = block = min(BLOCK, size)
        longest = size - block + 1
        own, which = np.unique(windows, axis=0, return_inverse=True)
        # tables grow with the test strings: two to four slots for each of their blocks, one for each suffix
        self.bits = max(16, int(len(own) * longest).bit_length() + 1)
        self.few = max(8, len(own).bit_length())
        suffix = _leading(_mixed(own[:, size - block :]), self.few)
        order = np.argsort(suffix, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.windows = own[order].astype(np.int32)
        self.bucket = np.searchsorted(suffix[order], np.arange((1 << self.few) + 1)).astype(np.int32)
        shift = np.full(1 << self.bits, longest, np.uint8)
        for end in range(block, size + 1):  # the least shift of a block is set last
            shift[_leading(_mixed(own[:, end - block : end]), self.bits)] = size - end
        self.shift = shift.tobytes()
        pairs = np.unique(np.stack([place[which.ravel()], owners]), axis=1)
        self.items = pairs[1].astype(np.int32)
        self.held = np.searchsorted(pairs[0], np.arange(len(own) + 1)).astype(np.int32)

    def search(self, ids: list, emit: Callable[[int, list[int]], None]) -> None:
        """Calls ``emit`` with the first position and the items of every occurrence."""
        size, block, shift, bits, few = self.size, self.block, self.shift, 64 - self.bits, 64 - self.few
        at, n = size, len(ids)
        while at <= n:
            if ids[at - 1] is None:  # no test string holds this word
                at += size
                continue
            key = 0
            for word in ids[at - block : at]:
                if word is None:
                    break
                key = (key + word + 1) * _TIMES & _ALL
            else:
                step = shift[key >> bits]
                if step == 0:
                    step, slot = 1, key >> few
                    low, high = int(self.bucket[slot]), int(self.bucket[slot + 1])
                    here = ids[at - size : at]
                    if low < high and None not in here:
                        for k in range(low, high):
                            if self.windows[k].tolist() == here:
                                emit(at - size, self.items[self.held[k] : self.held[k + 1]].tolist())
                at += step
                continue
            # no block of a test string holds an unknown word: go on where it is left behind
            at += size - block + 1


class Tables:
    """All test strings of a set of items: one set of tables for each length."""

    def __init__(self, items: list[tuple[str | None, bytes | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        windows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for number, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item_words(text)]
            if not ids:
                continue
            size = min(len(ids), WINDOW)
            rows = np.lib.stride_tricks.sliding_window_view(np.array(ids, np.int32), size)
            windows.setdefault(size, []).append(rows)
            owners.setdefault(size, []).append(np.full(len(rows), number))
        self.lengths = {n: Length(np.concatenate(w), np.concatenate(owners[n])) for n, w in windows.items()}

    def find(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged hit ranges (end exclusive), items that occur."""
        longest = max(self.lengths, default=1)
        get, total, held = self.vocabulary.get, 0, []
        spans: set[tuple[int, int]] = set()
        items: set[int] = set()
        for words in word_chunks(text or b"", ALNUM):
            ids = held + list(map(get, words))
            first = total - len(held)
            total += len(words)
            for size, tables in self.lengths.items():

                def emit(at: int, owners: list[int], size: int = size) -> None:
                    spans.add((first + at, first + at + size))
                    items.update(owners)

                tables.search(ids, emit)
            held = ids[max(0, len(ids) - longest + 1) :] if longest > 1 else []
        return total, merge(spans), items


def merge(spans) -> list[tuple[int, int]]:
    """Sorted ranges, those that touch or overlap joined."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _search(tables, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Tables = tables.value  # unpacked once by a worker process, for all its tasks
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n_words, hits, items = [], [], []
            for i, text in enumerate(utf8(batch.column("text"))):
                n, spans, found = search.find(text)
                names = {search.names[x] for x in found} - {None}
                if not first:
                    spans = merge(spans + [(x["start"], x["end"]) for x in batch.column("hits")[i].as_py()])
                    names.update(batch.column("items")[i].as_py())
                n_words.append(n)
                hits.append([{"start": a, "end": b} for a, b in spans])
                items.append(sorted(names))
            made = [pa.array(n_words, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))]
            names = ["doc_id", "k_hash", "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "n_words", "hits", "items"])

    return run


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where benchmark items occur in ``docs``: doc_id, k_hash, n_words, hits, items.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A
    test string is ten words in a row of an item, or all words of a shorter item.
    ``hits`` are word ranges, end exclusive; ``items`` the sorted ids, as strings, of
    the items with an occurrence.

    Tables hold ``PASS_BYTES`` of item text; a larger benchmark takes one pass over
    the documents for each such part, and the findings are merged row by row.

    Null or wordless text: no words, no hits. Null or wordless items are never found;
    an item without id hits words but is not listed; an id that repeats is listed once.
    Repeated rows are kept. No documents: no rows. No benchmark: no hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // PASS_BYTES) or 1
    items = items.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("k_hash"), "text")
    for i in range(passes):
        part = [(r[0], r[1].encode()) for r in items.where(F.col("pass") == i).drop("pass").collect()]
        tables = spark.sparkContext.broadcast(Tables(part))
        if i:
            rows, _ = keep_table(rows, "passages")
        rows = map_arrow(rows, _search(tables, i == 0), f"doc_id long, k_hash long, text string, {FOUND}")
    return rows.drop("text")


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which a benchmark passage occurs; null and empty texts stay."""
    found = find_passages(docs, benchmark).where(F.size("hits") > 0)
    keys = found.select(F.col("doc_id").alias("k_id"), "k_hash").distinct()
    return docs.join(keys, same_doc(docs, keys), "left_anti")


#: DuckDB: the digest, from windows joined to windows.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), iw AS (
  SELECT DISTINCT item, ws[i : i + 9] AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT len(w) AS n FROM iw),
dw AS (
  SELECT rid, i, n, ws[i : i + n - 1] AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens)
), hit AS (SELECT rid, i, n, item FROM dw JOIN iw USING (w)),
pos AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid
), its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
