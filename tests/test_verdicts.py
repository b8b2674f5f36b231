"""Cases that once went wrong in silence."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_sources import CUBE, KINDS, VALUES, solid, tile, unit_vertices

from gevel.functions import solids
from gevel.operators import scores
from gevel.plans import mesh, prediction, tuning
from gevel.session import scratch_dir
from gevel.sources import cityjson, metrics_csv, tables


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def tied_information(x, y, k=3):
    """The estimate with every tie of a class put in all orders at once."""
    terms = []
    for v, c in zip(x, y):
        n_class = int(np.sum(y == c))
        if n_class < 2:
            continue
        kk = min(k, n_class - 1)
        gaps = np.sort(np.abs(x[y == c] - v))[1:]
        n_own = int(np.sum((y == c) & (x == v)))
        if n_own > kk:
            near = psi(kk) + psi(np.sum(x == v)) - psi(n_own)
        else:
            near = psi(max(1, np.sum(np.abs(x - v) < gaps[kk - 1])))
        terms.append((psi(kk), psi(n_class), near))
    a, b, c = np.mean(terms, axis=0)
    return max(0.0, psi(len(terms)) + a - b - c)


def test_information_of_tied_values(spark):
    rng = np.random.default_rng(5)
    n = 400
    y = np.array(["a", "b", "c"])[rng.integers(0, 3, n)]
    x = rng.integers(0, 6, n) * 0.5 + (y == "c") * 1.0
    few = np.where(rng.random(n) < 0.02, rng.integers(10, 14, n), x)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "y": y, "x": x, "few": few}))
    for rows in (50_000, 30):
        got = {r.feature: r.score for r in scores.mutual_information(df, ["x", "few"], "y", "k", rows_per_slice=rows).collect()}
        assert got["x"] == pytest.approx(tied_information(x, y), abs=1e-6)
        assert got["few"] == pytest.approx(tied_information(few, y), abs=1e-6)


def test_information_of_independent_counts_stays_small(spark):
    df = spark.range(300_000).select(
        "id", (F.xxhash64("id", F.lit(1)) % 2).cast("string").alias("y"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)).alias("x")
    )
    assert scores.mutual_information(df, ["x"], "y", "id").first()["score"] < 0.01


def box(x0, y0, x1, y1, h, cut=None):
    """A box whose ground is cut in two faces at ``cut``."""
    def face(kind, pts):
        ring = [dict(zip("xyz", map(float, p))) for p in pts]
        return {"surface": kind, "rings": [ring + ring[:1]]}

    xs = [x0, cut, x1] if cut else [x0, x1]
    grounds = [face(KINDS[0], [(a, y0, 0), (a, y1, 0), (b, y1, 0), (b, y0, 0)]) for a, b in zip(xs, xs[1:])]
    roof = face(KINDS[2], [(x0, y0, h), (x1, y0, h), (x1, y1, h), (x0, y1, h)])
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    walls = [face(KINDS[1], [(*p, 0), (*q, 0), (*q, h), (*p, h)]) for p, q in zip(corners, corners[1:] + corners[:1])]
    return [*grounds, *walls, roof]


def test_ground_of_several_faces(spark):
    rows = [("a", box(0, 0, 10, 10, 3, cut=4)), ("b", box(12, 0, 20, 10, 3, cut=15))]
    df = spark.createDataFrame(rows, f"id string, faces {solids.FACES_TYPE}")
    got = {r.id: r for r in mesh.mesh_metrics(df).collect()}
    assert got["a"].footprint_perimeter == pytest.approx(40) and got["b"].footprint_perimeter == pytest.approx(36)
    assert got["a"].closest_distance == got["b"].closest_distance == pytest.approx(2)


def test_all_kinds_of_geometry(spark, tmp_path):
    one = solid()
    many = {**one, "type": "MultiSolid", "boundaries": [one["boundaries"]] * 2,
            "semantics": {"surfaces": one["semantics"]["surfaces"], "values": [one["semantics"]["values"]] * 2}}
    objects = {
        "m": {"type": "Building", "geometry": [many]},
        "c": {"type": "Building", "geometry": [{**many, "type": "CompositeSolid"}]},
        "t": {"type": "Building", "geometry": [one, one, {"type": "MultiPoint", "lod": "2.2", "boundaries": [0]}, solid(lod="1.2")]},
    }
    (tmp_path / "t.json").write_text(json.dumps(tile(objects, unit_vertices())))
    tiles = cityjson.read_tiles(spark, str(tmp_path))
    read = cityjson.merge_tiles(cityjson.tile_objects(tiles.unionByName(tiles)))
    n = {(r[0], r[1]): r[2] for r in read.groupBy("object_id", "lod").agg(F.sum(F.size("faces"))).collect()}
    assert n == {("m", "2.2"): 12, ("c", "2.2"): 12, ("t", "2.2"): 12, ("t", "1.2"): 6}
    assert read.filter("exists(faces, f -> f.surface is null)").count() == 0
    assert [tuple(r) for r in cityjson.other_geometries(tiles).collect()] == [("t", "MultiPoint", "2.2")]
    assert cityjson.tile_objects(tiles, ["1.2"]).count() == 1
    whole = {(r[0], r[1]): len(r[2]) for r in cityjson.one_per_object(read).collect()}
    assert whole == n


def test_a_solid_counts_before_the_same_faces_as_surfaces(spark, tmp_path):
    """The box of 10 x 10 x 5 given as a solid and as surfaces of one level of detail."""
    vertices = [[x * 20, y * 20, z * 10] for z in (0, 1) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    surfaces = {"type": "MultiSurface", "lod": "2.2", "boundaries": [[ring] for ring in CUBE],
                "semantics": {"surfaces": [{"type": k} for k in KINDS], "values": VALUES}}
    objects = {
        "both": {"type": "Building", "geometry": [surfaces, solid(), {**surfaces, "lod": "1.2"}]},
        "faces": {"type": "Building", "geometry": [surfaces]},
    }
    (tmp_path / "t.json").write_text(json.dumps(tile(objects, vertices)))
    read = cityjson.tile_objects(cityjson.read_tiles(spark, str(tmp_path)))
    whole = cityjson.one_per_object(read).filter("lod = '2.2'").select(F.col("object_id").alias("id"), "faces")
    for r in mesh.solid_metrics(whole).collect():
        assert (r.actual_volume, r.ground_area, r.roof_area) == pytest.approx((500, 100, 100)), r.id
        assert (r.wall_area, r.footprint_perimeter, r.hole_count) == pytest.approx((200, 40, 0)), r.id
    assert [tuple(r) for r in cityjson.set_aside(read).collect()] == [("both", "2.2", "MultiSurface", 0)]


def test_tiles_that_differ_give_one_model(spark, tmp_path):
    """In whatever order, the object comes whole from the tile that sorts first."""
    one, two = solid(), solid(CUBE[:5], VALUES[:5])
    (tmp_path / "a.json").write_text(json.dumps(tile({"x": {"type": "Building", "geometry": [one]}}, unit_vertices())))
    other = {"x": {"type": "Building", "geometry": [two, solid(lod="1.2")]}, "y": {"type": "Building", "geometry": [one]}}
    (tmp_path / "b.json").write_text(json.dumps(tile(other, unit_vertices())))
    first, second = (cityjson.tile_objects(cityjson.read_tiles(spark, str(tmp_path / f"{n}.json"))) for n in "ab")
    for read in (first.unionByName(second), second.unionByName(first), second.unionByName(first).unionByName(second)):
        got = {(r.object_id, r.lod, len(r.faces)) for r in cityjson.merge_tiles(read).collect()}
        assert got == {("x", "2.2", 6), ("y", "2.2", 6)}
        (told,) = cityjson.tile_conflicts(read).collect()
        assert (told.object_id, told.tiles, told.versions) == ("x", 2, 2) and told.kept_tile.endswith("a.json")


def metrics_row(spark):
    return spark.range(1).select(*[F.lit(i).cast(t).alias(c) for i, (c, t) in enumerate(metrics_csv.METRICS.items())])


def test_csv_columns_go_by_name(spark):
    path = scratch_dir(spark, "order")
    row = metrics_row(spark)
    tables.write_csv(row.select(F.lit("x").alias("lod"), *reversed(row.columns), F.lit(1).alias("more")), path)
    assert metrics_csv.read_metrics(spark, path).collect() == row.collect()
    path = scratch_dir(spark, "short")
    tables.write_csv(row.drop("obb_width"), path)
    with pytest.raises(KeyError, match="obb_width"):
        metrics_csv.read_metrics(spark, path)


def test_settings_without_effect_are_refused():
    for params in ({"no_such": 1}, {"min_samples_split": 40}, {"max_depth": 55}):
        with pytest.raises(ValueError):
            prediction.forest(params)
    with pytest.raises(ValueError, match="no counterpart"):
        prediction.linear_svm(10, {"dual": True})
    drawn = tuning.draw(tuning.GRIDS["rf"], 75)
    assert len(drawn) == 75 and not any(s["class_weight"] == "balanced_subsample" for s in drawn)


def test_publishing_never_overwrites(spark, monkeypatch):
    root = scratch_dir(spark, "published")
    df = spark.range(3)
    first = tables.publish(df, root)
    monkeypatch.setattr(tables, "_versions", lambda *a: [])
    second = tables.publish(df.limit(1), root)
    assert first != second and spark.read.parquet(first).count() == 3 and spark.read.parquet(second).count() == 1


def test_outline_of_a_ground_with_a_hole(spark):
    ring = lambda pts: [dict(zip("xyz", (*map(float, p), 0.0))) for p in pts]
    outer = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]
    faces = [{"surface": KINDS[0], "rings": [ring(outer), ring(hole)]}]
    df = spark.createDataFrame([(faces,)], f"faces {solids.FACES_TYPE}")
    assert df.select(solids.outline_length(F.col("faces"), solids.GROUND)).first()[0] == pytest.approx(48)
    assert math.isclose(len(CUBE), len(VALUES))
