from __future__ import annotations

import json
import struct

import pytest
import shapes as S
from pyspark.sql import functions as F

from gevel.functions import solids
from gevel.plans import mesh
from gevel.session import scratch_dir
from gevel.sources import cityjson, tables, wkb

CUBE = [[0, 3, 2, 1], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7], [4, 5, 6, 7]]
KINDS = ["GroundSurface", "WallSurface", "RoofSurface"]
VALUES = [0, 1, 1, 1, 1, 2]


def tile(objects, vertices, scale=0.5, move=(100.0, 200.0, 0.0)):
    return {
        "type": "CityJSON",
        "version": "1.0",
        "transform": {"scale": [scale] * 3, "translate": list(move)},
        "CityObjects": objects,
        "vertices": vertices,
        "metadata": {},
    }


def unit_vertices(side=2):
    return [[x * side, y * side, z * side] for z in (0, 1) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]


def solid(faces=CUBE, values=VALUES, lod="2.2"):
    return {
        "type": "Solid",
        "lod": lod,
        "boundaries": [[[ring] for ring in faces]],
        "semantics": {"surfaces": [{"type": k} for k in KINDS], "values": [values]},
    }


def test_tile_scan_and_metrics(spark, tmp_path):
    surface = {
        "type": "MultiSurface",
        "lod": 0,
        "boundaries": [[[0, 1, 2, 3]]],
        "semantics": {"surfaces": [{"type": "GroundSurface"}], "values": [0]},
    }
    objects = {
        "b": {"type": "Building", "geometry": [surface]},
        "b-0": {"type": "BuildingPart", "parents": ["b"], "geometry": [solid(), solid(lod=1.2)]},
        "c-0": {"type": "BuildingPart", "geometry": [solid(CUBE[:5], VALUES[:5])]},
        "bare": {"type": "Building"},
    }
    for i in (1, 2):
        (tmp_path / f"t{i}.json").write_text(json.dumps(tile(objects, unit_vertices()), indent=2))
    read = cityjson.tile_objects(cityjson.read_tiles(spark, str(tmp_path)))
    assert read.count() == 8
    merged = cityjson.merge_tiles(read)
    assert merged.count() == 4
    assert merged.filter("geometry_type = 'MultiSurface'").select(F.size("faces")).first()[0] == 1
    parts = cityjson.at_lod(merged, "2.2").select(F.col("object_id").alias("id"), "faces")
    got = {r.id: r for r in mesh.solid_metrics(parts).collect()}
    b = got["b-0"]
    assert b.actual_volume == pytest.approx(1) and b.convex_hull_volume == pytest.approx(1)
    assert (b.ground_area, b.roof_area, b.wall_area) == pytest.approx((1, 1, 4))
    assert (b.footprint_perimeter, b.obb_width, b.obb_length) == pytest.approx((4, 1, 1))
    assert (b.max_Z, b.min_Z, b.ground_Z, b.ground_point_count, b.hole_count) == (1, 1, 0, 4, 0)
    assert got["c-0"].hole_count == 1 and got["c-0"].roof_area == 0


def test_hull_of_dented_solid(spark):
    # A cube and its inside corner point, and a tetrahedron.
    points = [[(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)] + [(0.5, 0.5, 0.5)],
              [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 0, 0), (1, 0, 0), (0, 1, 0)]]
    rows = [([dict(zip("xyz", map(float, p))) for p in ps],) for ps in points]
    df = spark.createDataFrame(rows, "p array<struct<x:double,y:double,z:double>>")
    assert [round(r[0], 9) for r in df.select(solids.hull_volume("p")).collect()] == [1, round(1 / 6, 9), 0]


def test_slanted_face_with_hole(spark):
    outer = [(0, 0, 0), (4, 0, 0), (4, 4, 3), (0, 4, 3), (0, 0, 0)]
    hole = [(1, 0.8, 0.6), (2, 0.8, 0.6), (2, 1.6, 1.2), (1, 1.6, 1.2), (1, 0.8, 0.6)]
    ring = lambda pts: [dict(zip("xyz", map(float, p))) for p in pts]
    df = spark.createDataFrame([([ring(outer), ring(hole)],)], "r array<array<struct<x:double,y:double,z:double>>>")
    assert df.select(solids.surface_area(F.col("r"))).first()[0] == pytest.approx(4 * 5 - 1)


def test_wkb_round_trip_and_variants(spark):
    holed = [S.box(0, 0, 10, 10)[0], S.box(2, 2, 6, 6)[0]]
    df = spark.createDataFrame([("a", holed), ("b", None)], f"id string, {S.RINGS}")
    stored = df.select("id", wkb.encode_footprint(F.col("rings")).alias("wkb_geometry"))
    got = {r.id: r.rings for r in wkb.decode_footprints(stored).collect()}
    assert got["b"] is None and len(got["a"]) == 2 and got["a"][1][2].x == 6
    pts = [(0.0, 0.0, 9.0), (1.0, 0.0, 9.0), (1.0, 1.0, 9.0), (0.0, 0.0, 9.0)]
    big_z = struct.pack(">BIII", 0, 1003, 1, 4) + b"".join(struct.pack(">3d", *p) for p in pts)
    ewkb = struct.pack("<BIIII", 1, 0x80000000 | 0x20000000 | 3, 28992, 1, 4) + b"".join(struct.pack("<3d", *p) for p in pts)
    for data in (big_z, ewkb):
        assert wkb.read_polygon(data)[0][2] == {"x": 1.0, "y": 1.0}
    with pytest.raises(ValueError):
        wkb.read_polygon(struct.pack("<BI", 1, 1))


def test_shared_walls_of_turned_neighbours(spark):
    import math

    def house(i, x0, height):
        c, s = math.cos(0.5), math.sin(0.5)
        base = [(x0, 0), (x0 + 4, 0), (x0 + 4, 6), (x0, 6)]
        low = [(x * c - y * s, x * s + y * c) for x, y in base]
        pts = [(x, y, 0.0) for x, y in low] + [(x, y, float(height)) for x, y in low]
        face = lambda f: [dict(zip("xyz", pts[k])) for k in f + f[:1]]
        return (i, [{"surface": KINDS[v], "rings": [face(f)]} for f, v in zip(CUBE, VALUES)])

    df = spark.createDataFrame([house("a", 0, 3), house("b", 4, 5), house("c", 20, 5)], f"id string, faces {solids.FACES_TYPE}")
    got = {r.id: r.shared_walls_area for r in mesh.shared_walls(df).collect()}
    assert got == pytest.approx({"a": 18.0, "b": 18.0})
    near = {r.id: r.closest_distance for r in mesh.mesh_metrics(df).collect()}
    assert near == pytest.approx({"a": 0, "b": 0, "c": 12})


def test_overlap_of_concave_walls():
    import numpy as np

    ell = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], dtype=float)
    box = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], dtype=float)
    assert mesh.overlap_area(ell, box) == pytest.approx(3)
    assert mesh.overlap_area(ell[::-1], box) == pytest.approx(3)


def test_publish_switches_and_guards(spark):
    root = scratch_dir(spark, "pub")
    with pytest.raises(FileNotFoundError):
        tables.read_published(spark, root)
    tables.publish(spark.range(3), root, key="id")
    with pytest.raises(ValueError):
        tables.publish(spark.range(3).union(spark.range(1)), root, key="id")
    assert tables.read_published(spark, root).count() == 3
    tables.publish(spark.range(5), root, key="id")
    assert tables.read_published(spark, root).count() == 5


def test_publish_in_a_session_without_markers(spark):
    root = scratch_dir(spark, "unmarked")
    spark.conf.set(tables.MARKER, "false")
    try:
        for n in (3, 5):
            tables.publish(spark.range(n), root, key="id")
            assert tables.read_published(spark, root).count() == n
    finally:
        spark.conf.unset(tables.MARKER)


def test_shared_walls_with_copies(spark):
    def house(i, x0, x1):
        pts = [(x, y, z) for z in (0.0, 3.0) for x, y in ((x0, 0.0), (x1, 0.0), (x1, 6.0), (x0, 6.0))]
        face = lambda f: [dict(zip("xyz", map(float, pts[k]))) for k in f + f[:1]]
        return (i, [{"surface": KINDS[v], "rings": [face(f)]} for f, v in zip(CUBE, VALUES)])

    # Three copies beside one house, and a house thinner than the tolerance, facing itself.
    rows = [house("a1", 0, 4), house("a2", 0, 4), house("a3", 0, 4), house("b", 4, 8), house("t", 30, 30.05)]
    df = spark.createDataFrame(rows, f"id string, faces {solids.FACES_TYPE}")
    got = {r.id: r.shared_walls_area for r in mesh.shared_walls(df).collect()}
    assert {k: v for k, v in got.items() if abs(v) > 1e-9} == pytest.approx({"a1": 18, "a2": 18, "a3": 18, "b": 54})


@pytest.mark.parametrize("overtaken", [False, True])
def test_two_writers_in_both_orders(spark, overtaken, monkeypatch):
    """The later number wins whichever ends first; a writer that was overtaken is told."""
    root = scratch_dir(spark, "two")
    tables.publish(spark.range(1), root)
    versions = tables._versions
    slow, fast = spark.range(10), spark.range(20)
    if overtaken:  # the slow writer has seen version 1, and writes 2 when 3 is there already
        fast.write.parquet(f"{root}/version=3")
        seen = iter([[1]])
        monkeypatch.setattr(tables, "_versions", lambda s, r: next(seen, None) or versions(s, r))
        with pytest.raises(tables.StaleVersion):
            tables.publish(slow, root)
    else:
        tables.publish(slow, root)
        assert tables.read_published(spark, root).count() == 10
        tables.publish(fast, root)
    assert tables.read_published(spark, root).count() == 20


def test_what_is_read_is_not_removed(spark):
    root = scratch_dir(spark, "held")
    tables.publish(spark.range(1), root)
    with tables.reading(spark, root) as first:
        tables.publish(spark.range(2), root)
        tables.publish(spark.range(3), root)
        assert tables.prune(spark, root) == [2]
        assert first.count() == 1 and tables.read_published(spark, root).count() == 3
    assert tables.prune(spark, root) == [1] and tables.prune(spark, root) == []
    assert tables.read_published(spark, root).count() == 3
