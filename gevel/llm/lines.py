"""Removal of repeated multi-line passages, cut by content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gevel.llm.common import forget, free_names, keep_table, map_arrow, same_doc, text_hash, utf8

#: Lines whose hashes roll into a boundary decision.
ROLL = 2
#: A boundary falls after one line in so many.
EVERY = 3
#: Lines in a chunk.
FEWEST, MOST = 2, 16
#: A single line of more words than this is a passage too.
LONG = 50
_BASE = np.uint64(0x9E3779B97F4A7C15)


def cuts(hashes: np.ndarray) -> list[int]:
    """Chunk ends (exclusive) from line hashes.

    The rolling hash at a line covers it and the ``ROLL - 1`` lines before. A chunk
    ends after a line whose rolling hash is 0 modulo ``EVERY`` once it has ``FEWEST``
    lines, at ``MOST`` lines and at the end of the text. A boundary hence depends on
    near lines only, and falls in step again soon after lines come or go.
    """
    n = len(hashes)
    roll = np.zeros(n, np.uint64)
    for back in range(ROLL):
        if n > back:
            roll[back:] = roll[back:] * _BASE + hashes[: n - back]
    marks = ((roll ^ (roll >> np.uint64(31))) * _BASE >> np.uint64(40)) % np.uint64(EVERY) == 0
    out, start = [], 0
    for i in np.flatnonzero(marks).tolist():
        while i + 1 - start > MOST:
            start += MOST
            out.append(start)
        if i + 1 - start >= FEWEST:
            start = i + 1
            out.append(start)
    while n - start > MOST:
        start += MOST
        out.append(start)
    if n > start:
        out.append(n)
    return out


def chunks(text: bytes | None) -> list[tuple[int, int, int]]:
    """(start byte, end byte, lines) of a text's chunks; line ends belong to their line."""
    if not text:
        return []
    lines = text.split(b"\n")
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    ends[-1] -= 1
    if ends[-1] == (ends[-2] if len(ends) > 1 else 0):  # nothing after the last line end
        lines, ends = lines[:-1], ends[:-1]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    out, before = [], 0
    for end in cuts(hashes):
        out.append((int(ends[before - 1]) if before else 0, int(ends[end - 1]), end - before))
        before = end
    return out


def whole_chunks(text: bytes | None) -> list[tuple[int, int]]:
    """(start byte, end byte) of a text's chunks of several lines."""
    return [(start, end) for start, end, lines in chunks(text) if lines >= FEWEST]


def passages(text: bytes | None) -> list[tuple[int, int]]:
    """(start byte, end byte) of all that counts as a passage, in order.

    Every two neighbouring lines that are not blank, with blank ones between them; lines
    of more than ``LONG`` words; the chunks of several lines. Two texts that share a run
    of lines share all pairs within it, so pairs cover the run to its ends.
    """
    out, start, before = set(whole_chunks(text)), 0, -1
    for line in (text or b"").split(b"\n"):
        end = min(start + len(line) + 1, len(text or b""))
        words = len(line.split(None, LONG))
        if words > LONG:
            out.add((start, end))
        if words:
            if before >= 0:
                out.add((before, end))
            before = start
        start = end
    return sorted(out)


def _hashes(batches: Iterator[pa.RecordBatch], pieces=whole_chunks) -> Iterator[pa.RecordBatch]:
    """Pieces by place; the last line end of a piece is left out, so that one at a text's end matches too."""
    for batch in batches:
        row, at, c1, c2 = [], [], [], []
        for i, text in enumerate(utf8(batch.column("text"))):
            for j, (start, end) in enumerate(pieces(text)):
                d = hashlib.blake2b(text[start:end].removesuffix(b"\n"), digest_size=16).digest()
                row.append(i)
                at.append(j)
                c1.append(int.from_bytes(d[:8], "little", signed=True))
                c2.append(int.from_bytes(d[8:], "little", signed=True))
        rows = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(rows),
                batch.column("k_hash").take(rows),
                pa.array(at, pa.int32()),
                pa.array(c1, pa.int64()),
                pa.array(c2, pa.int64()),
            ],
            ["doc_id", "k_hash", "at", "c1", "c2"],
        )


def _bytes(batches: Iterator[pa.RecordBatch], pieces) -> Iterator[pa.RecordBatch]:
    """The pieces asked for, with their bytes."""
    for batch in batches:
        row, at, c1, c2, data = [], [], [], [], []
        asked = batch.column("wanted").to_pylist()
        for i, text in enumerate(utf8(batch.column("text"))):
            found = pieces(text)
            for want in asked[i]:
                start, end = found[want["at"]]
                row.append(i)
                at.append(want["at"])
                c1.append(want["c1"])
                c2.append(want["c2"])
                data.append(text[start:end].removesuffix(b"\n"))
        rows = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(rows),
                batch.column("k_hash").take(rows),
                pa.array(at, pa.int32()),
                pa.array(c1, pa.int64()),
                pa.array(c2, pa.int64()),
                pa.array(data, pa.binary()),
            ],
            ["doc_id", "k_hash", "at", "c1", "c2", "data"],
        )


CHUNK = "doc_id long, k_hash long, at int, c1 long, c2 long"


def _place():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("k_hash"), F.col("at"))


def _later(places: DataFrame) -> DataFrame:
    """Places after the first one; ``until`` is that one's position if it is in the same text."""
    same = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("k_hash") == F.col("first.k_hash"))
    return places.where(_place() != F.col("first")).select(
        "doc_id", "k_hash", "at", F.when(same, F.col("first.at")).alias("until")
    )


def repeated(docs: DataFrame, pieces=whole_chunks) -> DataFrame:
    """(doc_id, k_hash, at, until): pieces that stand, byte for byte, at an earlier place too.

    The first place is that of the smallest doc_id, then the lowest position. Hashes find
    the candidates; their bytes are then grouped, and a hash that stands for more than
    one string is settled string by string.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("doc_id", text_hash().alias("k_hash"), "text")
    hashes = _hashes if pieces is whole_chunks else partial(_hashes, pieces=pieces)
    spark = docs.sparkSession
    hashed, at_hashed = keep_table(map_arrow(rows, hashes, CHUNK).distinct(), "chunks")
    often = hashed.groupBy(F.col("c1").alias("d1"), F.col("c2").alias("d2")).agg(F.count(F.lit(1)).alias("n"))
    often = often.where("n > 1")
    again, _ = keep_table(
        hashed.join(often, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))).select(*hashed.columns), "again"
    )
    forget(spark, at_hashed)
    wanted = again.groupBy(F.col("doc_id").alias("k_id"), "k_hash").agg(
        F.collect_list(F.struct("at", "c1", "c2")).alias("wanted")
    )
    asked = docs.join(wanted, same_doc(docs, wanted)).select(
        wanted["k_id"].alias("doc_id"), wanted["k_hash"], docs["text"], "wanted"
    )
    found = map_arrow(asked, partial(_bytes, pieces=pieces), f"{CHUNK}, data binary")
    # equal bytes collapse before the shuffle, however many documents hold them
    strings = found.groupBy("c1", "c2", "data").agg(F.min(_place()).alias("first"))
    keys, _ = keep_table(
        strings.groupBy(F.col("c1").alias("d1"), F.col("c2").alias("d2")).agg(
            F.count(F.lit(1)).alias("strings"), F.min("first").alias("first")
        ),
        "strings",
    )
    same = (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))
    later = _later(again.join(keys.where("strings = 1"), same))
    if keys.where("strings > 1").isEmpty():
        return later
    clash = found.join(keys.where("strings > 1").select("d1", "d2"), same).select(*found.columns)
    firsts = clash.groupBy(F.col("data").alias("d")).agg(F.min(_place()).alias("first"))
    return later.unionByName(_later(clash.join(firsts, F.col("data") == F.col("d"))))


def _without(text: bytes, found: list[tuple[int, int]], gone: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """A text without the pieces that are ``gone``, and the byte ranges cut. What overlaps its own first place leaves that whole."""
    ranges: list[tuple[int, int]] = []
    for start, end in sorted(
        (max(found[g["at"]][0], 0 if g["until"] is None else found[g["until"]][1]), found[g["at"]][1]) for g in gone
    ):
        if ranges and start <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], end))
        elif start < end:
            ranges.append((start, end))
    left, at = [], 0
    for start, end in ranges:
        left.append(text[at:start])
        at = end
    return b"".join([*left, text[at:]]), ranges


def _rewritten(text_at: int, drop_at: int, pieces, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = utf8(batch.column(text_at)), []
            drops = batch.column(drop_at).to_pylist()
            for i, text in enumerate(texts):
                parts, touched, lost = chunks(text), 0, 0
                if drops[i]:
                    texts[i], ranges = _without(text, pieces(text), drops[i])
                    lost = sum(text.count(b"\n", a, b) + (text[b - 1 : b] != b"\n") for a, b in ranges)
                    starts, ends = np.array(ranges).reshape(-1, 2).T
                    at = np.array([(a, b) for a, b, _ in parts])
                    # a part is whole if as many ranges end before it as start before its end
                    touched = int((np.searchsorted(starts, at[:, 1]) > np.searchsorted(ends, at[:, 0], "right")).sum())
                cut.append({"n_chunks": len(parts), "n_removed": touched, "n_lines_removed": lost})
            columns = list(batch.columns)
            columns[text_at] = pa.array([None if t is None else t.decode() for t in texts], pa.string())
            columns[drop_at] = pa.array(
                cut, pa.struct([(n, pa.int64()) for n in ("n_chunks", "n_removed", "n_lines_removed")])
            )
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def cut_lines(docs: DataFrame, pieces=whole_chunks) -> DataFrame:
    """``docs`` with later copies of pieces cut out of ``text``, and what was cut as a struct in the last column.

    Pieces are chunks of two lines or more; ``cut_passages`` takes whole passages. The
    struct counts a text's chunks, those that lost a line and the lines lost. Every
    document stays, even with nothing left. Null text stays null, without chunks. Repeated
    rows (same doc_id and text) are one document and get the same result. Null doc_ids
    order last. Ties in order cannot be: a place is a document and a position. Very long
    texts are cut like others. Other columns come back as they were, whatever their
    names. No rows: no rows.
    """
    (cut,) = free_names(docs, "llm_cut")
    gone = (
        repeated(docs, pieces)
        .groupBy(F.col("doc_id").alias("k_id"), "k_hash")
        .agg(F.collect_list(F.struct("at", "until")).alias(cut))
    )
    joined = docs.join(gone, same_doc(docs, gone), "left").select(*[docs[c] for c in docs.columns], cut)
    counts = T.StructType([T.StructField(n, T.LongType()) for n in ("n_chunks", "n_removed", "n_lines_removed")])
    schema = T.StructType([*joined.drop(cut).schema.fields, T.StructField(cut, counts)])
    text_at = [c.lower() for c in docs.columns].index("text")
    return map_arrow(joined, _rewritten(text_at, len(docs.columns), pieces, schema.names), schema)


def cut_passages(docs: DataFrame) -> DataFrame:
    """As ``cut_lines``, for all ``passages``: a shared run of lines goes from its first line to its last.

    The first place of every line stays: a line is cut only with a passage that holds it
    and stands at an earlier place.
    """
    return cut_lines(docs, passages)


def _plain(cut: DataFrame) -> DataFrame:
    return cut.drop(cut.columns[-1])


def drop_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with the same rows and columns, later copies of multi-line chunks cut out of ``text``."""
    return _plain(cut_lines(docs))


def drop_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the same rows and columns, later copies of passages cut out of ``text``."""
    return _plain(cut_passages(docs))


def digest(cut: DataFrame) -> DataFrame:
    counts = cut.columns[-1]
    return cut.select(
        "doc_id",
        f"{counts}.n_chunks",
        f"{counts}.n_removed",
        f"{counts}.n_lines_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
