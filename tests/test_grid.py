"""Spatial joins against nested loops, with crowded places and copies."""

from __future__ import annotations

import numpy as np
import pytest
import shapes as S
from pyspark.sql import functions as F

from gevel.functions import labels
from gevel.operators import grid
from gevel.plans import extraction, mesh
from gevel.queries import spatial  # noqa: F401
from gevel.queries.registry import QUERIES


def city(seed: int, n: int = 90) -> list[tuple]:
    """Scattered polygons, a third of them on one spot, some equal, some without outline."""
    rng = np.random.default_rng(seed)
    kinds = [labels.RESIDENTIAL, labels.MIXED, labels.OTHERS, labels.UNKNOWN, None]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rings = S.random_polygon(rng, *rng.uniform(40, 46, 2), 0.7)
        elif i % 10 == 1:
            rings = S.box(10, 10, 14, 12)
        elif i % 30 == 2:
            rings = None
        else:
            rings = S.random_polygon(rng, *rng.uniform(-60, 120, 2), rng.uniform(2, 9))
        rows.append((f"b{i:03d}", kinds[int(rng.integers(0, 5))], rings))
    return rows


SCHEMA = f"bag_id string, bag_function string, {S.RINGS}"


def test_neighbours(spark, monkeypatch):
    rows = city(3)
    table = spark.createDataFrame(rows, SCHEMA)
    radii = [5, 25, 60]
    expected = {}
    for i, _, a in rows:
        if a is None:
            expected[i] = (None,) * 3
            continue
        c = S.centroid(a)
        d = [S.point_distance(b, *c) for j, _, b in rows if j != i and b is not None]
        expected[i] = tuple(sum(x <= r for x in d) for r in radii)
    for per_cell in (512, 4):
        shapes = extraction.footprint_shapes(table)
        monkeypatch.setattr(grid.shapes_within, "__defaults__", (per_cell,))
        out = extraction.neighbours(table, radii, shapes=shapes)
        got = {r.bag_id: tuple(r[f"no_neighbours_{x}m"] for x in radii) for r in out.collect()}
        assert got == expected


@pytest.mark.parametrize("per_cell", [512, 3])
def test_adjacency(spark, monkeypatch, per_cell):
    rows = city(4)
    table = spark.createDataFrame(rows, SCHEMA)
    size = 0.5
    # Round buffers bound the mitre ones: use pairs that are clear of the corner belt.
    near = {}
    for i, _, a in rows:
        for j, _, b in rows:
            if i != j and a is not None and b is not None:
                near[i, j] = S.distance(a, b)
    monkeypatch.setattr(grid.box_pairs, "__defaults__", (None, per_cell))
    shapes = extraction.footprint_shapes(table)
    pairs = grid.touching_shapes(shapes, [size]).collect()
    assert len({(r.a_id, r.b_id) for r in pairs}) == len(pairs)
    touch = {(r.a_id, r.b_id) for r in pairs if r.touch_0}
    ids = {r.shape_id for r in shapes.collect()}
    for (i, j), d in near.items():
        if i in ids and j in ids:
            assert ((i, j) in touch) or d > size
            if d > 5 * size:
                assert (i, j) not in touch
    # Full counts, from the same pair relation spread over copies.
    rep = {}
    for i, _, a in rows:
        if a is not None:
            rep[i] = min(k for k, _, b in rows if b == a)
    f = {i: k for i, k, _ in rows}
    counts = lambda k: k in (labels.RESIDENTIAL, labels.MIXED)
    adj = {
        i: [j for j in rep if j != i and (rep[i] == rep[j] or (rep[i], rep[j]) in touch)] for i in rep
    }
    one = {i: sum(counts(f[j]) for j in adj[i]) if counts(f[i]) else 0 for i in rep}
    two = {i: max((one[j] for j in adj[i]), default=0) for i in rep}
    out = extraction.adjacency(table, [size], shapes=shapes).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.no_adjacent_bldg == one.get(r.bag_id)
        assert r.no_adjacent_of_adja_bldg == two.get(r.bag_id)


def test_box_pairs_once_and_complete(spark):
    rng = np.random.default_rng(9)
    boxes = []
    for i in range(150):
        x, y = rng.uniform(0, 30, 2) if i % 2 else rng.uniform(10, 11, 2)
        w, h = rng.uniform(0, 12, 2)
        boxes.append((i, float(x), float(y), float(x + w), float(y + h)))
    df = spark.createDataFrame(boxes, "id int, minx double, miny double, maxx double, maxy double")
    want = {
        (a[0], b[0])
        for a in boxes
        for b in boxes
        if a[1] - 1.5 <= b[3] and b[1] <= a[3] + 1.5 and a[2] - 1.5 <= b[4] and b[2] <= a[4] + 1.5
    }
    for cell, per_cell in ((4.0, 512), (4.0, 2), (50.0, 8)):
        got = [(r.a_id, r.b_id) for r in grid.box_pairs(df, df, 1.5, cell, per_cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest(spark):
    rows = [(i, None, a) for i, _, a in city(8, 40) if a is not None]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.bag_id: r.closest_distance for r in mesh.closest(table).collect()}
    for i, _, a in rows:
        want = min(S.distance(a, b) for j, _, b in rows if j != i)
        assert got[i] == pytest.approx(want, abs=1e-9)
    alone = spark.createDataFrame(rows[:1], SCHEMA)
    assert mesh.closest(alone).first().closest_distance is None


def test_no_nested_loop_in_plan(spark):
    table = spark.createDataFrame(city(2), SCHEMA)
    shapes = grid.distinct_shapes(table)
    plan = grid.touching_shapes(shapes, [0.1])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_over_all_densities(spark):
    """A crowd, a town, far outliers, a large hall and copies, against all pairs."""
    rng = np.random.default_rng(5)
    spots = [*rng.uniform(0, 15, (40, 2)), *rng.uniform(100, 400, (40, 2)), (5e4, 0), (5e4, 7e4), (-2e5, 3)]
    rows = [(f"n{i:03d}", None, S.random_polygon(rng, x, y, rng.uniform(0.2, 3))) for i, (x, y) in enumerate(spots)]
    rows.append(("hall", None, S.box(450, 0, 900, 300)))
    rows += [("copy1", None, S.box(20, 20, 21, 21)), ("copy2", None, S.box(20, 20, 21, 21))]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.bag_id: r.closest_distance for r in mesh.closest(table).collect()}
    for i, _, a in rows:
        want = min(S.distance(a, b) for j, _, b in rows if j != i)
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-9), i


def test_reach_bounds_hold(spark):
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.uniform(0, 1, (50, 2)), rng.uniform(0, 1e4, (50, 2))])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "shape_id int, px double, py double")
    top = grid._levels({"x0": 0, "x1": 1e4, "y0": 0, "y1": 1e4}, 0.5)
    got = {r.shape_id: r.reach for r in grid.reach_bounds(points, 0.0, 0.0, 0.5, top).collect()}
    far = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)) + np.diag(np.full(len(at), np.inf))
    nearest = far.min(1)
    assert len(got) == len(at) and all(got[i] >= nearest[i] - 1e-9 for i in got)
    assert np.median([got[i] / nearest[i] for i in got]) < 8


def crowd(spark, n):
    """``n`` squares of 10 cm all over one cell of 100 m."""
    rng = np.random.default_rng(n)
    rows = [(f"c{i:05d}", None, S.box(x, y, x + 0.1, y + 0.1)) for i, (x, y) in enumerate(rng.uniform(0.1, 99.8, (n, 2)))]
    return spark.createDataFrame(rows, SCHEMA), np.array([(r[2][0][0]["x"] + 0.05, r[2][0][0]["y"] + 0.05) for r in rows])


def test_rows_of_a_crowded_cell_grow_with_the_rim(spark):
    """Four times the shapes: about twice the blocks and shapes met by a centre, not four times."""
    radii, met = [10.0, 40.0], []
    for n in (512, 2048, 8192):
        table, at = crowd(spark, n)
        shapes = grid.distinct_shapes(table).select("*", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
        depth = int(np.log2(np.sqrt(n / 8)))
        members = shapes.select("shape_id", "copies", *grid.BOX, grid.planar.edges("rings").alias("edges"), "cx", "cy", F.lit(depth).alias("depth"))
        x, y = F.col("minx") + 0.05, F.col("miny") + 0.05
        probe = shapes.orderBy("shape_id").limit(100).select(
            "shape_id", x.alias("px"), y.alias("py"), x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy")
        )
        whole, opened = grid.block_counts(probe, members, 100.0, radii)
        met.append(opened.count() / 100)
        # all that is surely within came whole, and nothing twice
        sums = {r.shape_id: (r[1], r[2]) for r in whole.groupBy("shape_id").agg(F.sum("within_0"), F.sum("within_1")).collect()}
        pairs = opened.groupBy("a_shape_id").agg(F.count_if("cut_0").alias("a"), F.count_if("cut_1").alias("b")).collect()
        for r in pairs:
            centre = at[int(r.a_shape_id[1:])]
            far = np.hypot(*(at - centre).T)
            for k, radius, cut in ((0, 10, r.a), (1, 40, r.b)):
                inside = sums.get(r.a_shape_id, (0, 0))[k]
                assert inside <= (far <= radius + 0.1).sum() <= inside + cut + 1
    assert met[1] < 2.8 * met[0] and met[2] < 2.8 * met[1]
    assert met[2] < 8192 / 8


def test_crowded_neighbours_against_all_pairs(spark, monkeypatch):
    table, at = crowd(spark, 600)
    monkeypatch.setattr(grid.shapes_within, "__defaults__", (32,))
    out = extraction.neighbours(table, [5, 20, 100], shapes=extraction.footprint_shapes(table)).collect()
    low, high = at - 0.05, at + 0.05
    for r in out:
        p = at[int(r.bag_id[1:])]
        far = np.hypot(*np.maximum(0, np.maximum(low - p, p - high)).T)
        want = [int((far <= x).sum()) - 1 for x in (5, 20, 100)]
        assert [r.no_neighbours_5m, r.no_neighbours_20m, r.no_neighbours_100m] == want


def test_pairs_are_shuffled_not_broadcast(spark):
    """However small Spark takes a side to be, outlines of a whole table do not go through the driver."""
    at = F.col("id") * 5.0
    t = spark.range(40).select(F.format_string("r%03d", "id").alias("bag_id"), grid.planar.rectangle(at, at * 0, at + 5, at * 0 + 5).alias("rings"))
    pairs = grid.touching_shapes(grid.distinct_shapes(t), [0.1])
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.filter("touch_0").count() == 78


def test_the_largest_neighbour_is_looked_up_without_a_broadcast(spark, tmp_path):
    spark.range(60).selectExpr(
        "id as p_partkey", "cast(id % 7 as int) as p_size", "cast(id as double) as p_retailprice", "'n' as p_name"
    ).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["a3_max_over_neighbours"](spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0
