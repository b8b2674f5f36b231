"""Footprints stored as well-known binary polygons."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gevel.functions.hull import RINGS

# Fixed values of the format: type code and flag bits.
POLYGON = 3
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000


def polygon_rings(data: bytes) -> list[np.ndarray]:
    """Rings of a polygon as ``(n, 2)`` arrays; heights, measures and the reference system are skipped."""
    end = "<" if data[0] == 1 else ">"
    (kind,) = struct.unpack_from(end + "I", data, 1)
    at = 5
    dims = 2 + bool(kind & HAS_Z) + bool(kind & HAS_M)
    if kind & HAS_SRID:
        at += 4
    kind &= 0x0FFFFFFF
    dims += {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000]
    if kind % 1000 != POLYGON:
        raise ValueError(f"not a polygon: type {kind}")
    (count,) = struct.unpack_from(end + "I", data, at)
    at += 4
    rings = []
    for _ in range(count):
        (n,) = struct.unpack_from(end + "I", data, at)
        values = np.frombuffer(data, end + "f8", n * dims, at + 4)
        rings.append(values.reshape(n, dims)[:, :2].astype("f8"))
        at += 4 + 8 * n * dims
    return rings


def read_polygon(data: bytes | None) -> list | None:
    """Rings of one polygon as points."""
    if data is None:
        return None
    return [[{"x": x, "y": y} for x, y in ring.tolist()] for ring in polygon_rings(data)]


def _ring_column(blobs: list[bytes | None]) -> pa.Array:
    """Decoded polygons as one nested column, built from offsets and two coordinate arrays."""
    polygons = [None if b is None else polygon_rings(b) for b in blobs]
    rings = [r for p in polygons if p for r in p]
    xy = np.concatenate([np.empty((0, 2)), *rings])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    ends = np.cumsum([0, *map(len, rings)])
    nested = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points)
    starts = np.cumsum([0, *(len(p or ()) for p in polygons)]).tolist()
    # A null start marks a missing polygon.
    places = [None if p is None else a for p, a in zip(polygons, starts)] + starts[-1:]
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), nested)


def decode_footprints(df: DataFrame, column: str = "wkb_geometry") -> DataFrame:
    """Replace the binary column by ``rings``."""
    kept = [f for f in df.schema.fields if f.name != column]
    names = [f.name for f in kept]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = _ring_column(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), rings], [*names, "rings"])

    schema = T.StructType(kept + [T.StructField("rings", RINGS)])
    return df.mapInArrow(decode, schema)


def write_polygon(rings) -> bytes | None:
    if rings is None:
        return None
    out = [struct.pack("<BII", 1, POLYGON, len(rings))]
    for ring in rings:
        flat = [v for p in ring for v in (p["x"], p["y"])]
        out.append(struct.pack(f"<I{len(flat)}d", len(ring), *flat))
    return b"".join(out)


@F.pandas_udf(T.BinaryType())
def _encoded(rings: pd.Series) -> pd.Series:
    return rings.map(write_polygon)


def encode_footprint(rings: Column) -> Column:
    return _encoded(rings)
