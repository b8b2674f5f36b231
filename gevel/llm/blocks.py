"""Vectors as whole numbers, written in blocks that rounds of assignment read again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.common import map_arrow

#: Vectors in a block.
BLOCK = 4096
ROWS = "vec_id long, label string, vector array<double>"
BLOCKS = "vec_id array<long>, label array<string>, n int, vectors binary"


def largest(dims: int) -> int:
    """Below this magnitude no sum of ``dims`` squared differences leaves 64 bits."""
    return 1 << ((62 - max(1, dims - 1).bit_length()) // 2 - 1)


def whole_vectors(rows: DataFrame, scale: int, dims: int | None = None) -> DataFrame:
    """(vec_id, label, vector) of the vectors that count, components as doubles times ``scale``, floored.

    A vector counts if it is not null, holds no null or non-finite component, has
    ``dims`` components where that is given, and every floor is below ``largest``:
    beyond that no squared distance fits a long. ``label`` is text; without such a
    column it is null. Repeated rows are kept; other columns are ignored.
    """
    label = F.col("label").cast("string") if "label" in rows.columns else F.lit(None).cast("string")
    own = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"),
        F.transform("embedding", lambda x: x.cast("double") * scale).alias("raw"),
    )
    bound = float(largest(dims or 64))
    # NaN is larger than any number, and null makes the comparison null
    fits = F.forall("raw", lambda x: F.coalesce((x < bound) & (x >= -bound), F.lit(False)))
    own = own.where(F.col("raw").isNotNull() & fits)
    if dims is not None:
        own = own.where(F.size("raw") == dims)
    return own.select("vec_id", "label", "vector")


def in_blocks(
    vectors: DataFrame, dims: int, more: Callable[[np.ndarray], dict[str, bytes]], schema: str
) -> DataFrame:
    """One row for up to ``BLOCK`` vectors: ids, labels, components as 32-bit integers, and what ``more`` adds."""

    def block(ids: list, labels: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        ints = np.concatenate(parts).reshape(-1, dims)
        columns = [
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([labels], pa.list_(pa.string())),
            pa.array([len(ints)], pa.int32()),
            pa.array([ints.tobytes()], pa.binary()),
        ]
        added = more(ints)
        columns += [pa.array([x], pa.binary()) for x in added.values()]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "n", "vectors", *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, parts = [], [], []
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                piece = batch.slice(at, BLOCK)
                ids += piece.column("vec_id").to_pylist()
                labels += piece.column("label").to_pylist()
                parts.append(piece.column("vector").flatten().to_numpy().astype(np.int32))
                if len(ids) >= BLOCK:
                    yield block(ids, labels, parts)
                    ids, labels, parts = [], [], []
        if ids:
            yield block(ids, labels, parts)

    return map_arrow(vectors, run, f"{BLOCKS}{schema}")


def ints_of(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], np.int32).reshape(-1, dims).astype(np.int64)


def floored_means(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); entries without a count stay."""
    used = counts > 0
    new = old.copy()
    new[used] = sums[used] // counts[used][:, None]
    return new
