"""Geometry in Python costs a fraction of a millisecond for a solid or a pair of walls, and tiles are read once."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gevel.functions import solids
from gevel.plans import mesh
from gevel.sources import cityjson

CORNERS = np.array([[x, y, z] for x in (0, 9.0) for y in (0, 11.0) for z in (0, 5.0)])


def test_hull_volume_of_many_solids(spark):
    rng = np.random.default_rng(3)
    for scale in (0.01, 1.0, 100.0):
        inside = rng.uniform(0, 1, (40, 3)) * [9, 11, 5]
        pts = (np.concatenate([inside, CORNERS, CORNERS]) + 1e5) * scale
        assert solids._hull_volume(pts) == pytest.approx(495 * scale**3, rel=1e-6)
    assert solids._hull_volume(CORNERS[:4] * [0, 1, 1]) == 0.0 and np.isnan(solids._hull_volume(CORNERS * np.nan))
    began = time.process_time()
    assert {round(solids._hull_volume(CORNERS), 6) for _ in range(1000)} == {495.0}
    assert time.process_time() - began < 1.0  # 4.5 s when numpy handled three numbers at a time
    rows = [(1, [tuple(map(float, p)) for p in CORNERS]), (2, None), (3, []), (4, [tuple(map(float, p)) for p in CORNERS * 2])]
    rows.append((5, [(None if i < 4 else x, y, z) for i, (x, y, z) in enumerate(CORNERS.tolist())]))
    t = spark.createDataFrame(rows, "id int, p array<struct<x:double,y:double,z:double>>").coalesce(1)
    got = dict(t.select("id", solids.hull_volume("p")).collect())
    assert got == {1: pytest.approx(495), 2: None, 3: 0.0, 4: pytest.approx(3960), 5: None}


def test_overlap_of_many_walls():
    wall = np.array([[0, 0], [9, 0], [9, 5], [0, 5.0]])
    notched = np.array([[0, 0], [4, 0], [4, 4], [2, 4], [2, 2], [0, 2.0]])
    assert mesh.overlap_area(wall, notched) == pytest.approx(12) and mesh.overlap_area(notched[::-1], wall + [1, 1]) == pytest.approx(6 + 1)
    assert mesh.overlap_area(wall, wall + [9, 0]) == 0.0 and mesh.overlap_area(wall, wall - [0, 7]) == 0.0
    began = time.process_time()
    assert {round(mesh.overlap_area(wall, wall + [2, 1]), 6) for _ in range(1000)} == {28.0}
    assert time.process_time() - began < 0.6  # 1.2 s when numpy handled two numbers at a time


def test_tiles_are_merged_in_one_pass(spark):
    row = "object_id string, tile string, type string, parents array<string>, lod string, geometry_type string, geometry_no int, faces array<int>"
    rows = [
        ("a", "t2", "B", None, "1", "Solid", 0, [2]), ("a", "t1", "B", None, "1", "Solid", 0, [1]), ("a", "t1", "B", None, "1", "Solid", 0, [1]),
        ("a", "t2", "B", None, "2", "Solid", 1, [3]),  # of a geometry that the first tile lacks
        ("b", "t2", "B", ["p"], "1", "Solid", 0, [4]), ("b", None, "B", None, "1", "Solid", 0, [5]), (None, "t1", "B", None, "1", "Solid", 0, [6]),
        ("c", "t1", "B", None, None, "Solid", 0, [7]), ("c", "t1", "C", None, None, "Solid", 0, [8]),
    ]
    merged = cityjson.merge_tiles(spark.createDataFrame(rows, row).withColumn("tile", F.col("tile")))
    assert "Join" not in merged._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.object_id, r.tile, r.faces[0]) for r in merged.collect())
    assert got[:2] == [("a", "t1", 1), ("b", "t2", 4)] and len(got) == 3 and got[2][0] == "c"


def test_face_vectors_are_evaluated_once(spark):
    """Once for an area and once for a volume, however often its parts are used."""
    t = spark.createDataFrame([], f"faces {solids.FACES_TYPE}")
    for column in (solids.area_of(F.col("faces"), solids.WALL), solids.volume(F.col("faces"))):
        plan = t.select(column.alias("v"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("zip_with(") == 1
