from __future__ import annotations

import math

import numpy as np
import pytest
import shapes as S
from pyspark.sql import functions as F

from gevel.functions import hull, planar

SQUARE = S.box(0, 0, 4, 4)
L_SHAPE = [S.ring([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)])]
HOLED = [S.box(0, 0, 10, 10)[0], S.box(2, 2, 6, 6)[0]]
TURNED = [S.ring([(0, 0), (3, 3), (0, 6), (-3, 3)])]
LINE = [S.ring([(0, 0), (4, 0), (0, 0)])]


def frame(spark, polygons):
    return spark.createDataFrame([(i, p) for i, p in enumerate(polygons)], f"id int, {S.RINGS}")


def test_measures(spark):
    rows = (
        frame(spark, [SQUARE, L_SHAPE, HOLED, TURNED, LINE])
        .select(
            "id",
            planar.area("rings").alias("a"),
            planar.perimeter("rings").alias("p"),
            planar.point_count("rings").alias("n"),
            planar.centroid("rings").alias("c"),
        )
        .orderBy("id")
        .collect()
    )
    assert [round(r.a, 9) for r in rows] == [16, 12, 84, 18, 0]
    assert [round(r.p, 6) for r in rows] == [16, 16, 56, round(4 * math.hypot(3, 3), 6), 8]
    assert [r.n for r in rows] == [5, 7, 10, 5, 3]
    assert (rows[0].c.x, rows[0].c.y) == (2, 2)
    assert rows[1].c.x == pytest.approx(10 / 6) and rows[1].c.y == pytest.approx(10 / 6)
    expected = S.centroid(HOLED)
    assert (rows[2].c.x, rows[2].c.y) == pytest.approx(expected)
    assert (rows[4].c.x, rows[4].c.y) == pytest.approx((2, 0))


def test_random_polygons_against_numpy(spark):
    rng = np.random.default_rng(1)
    polys = [S.random_polygon(rng, *rng.uniform(0, 6, 2), 2.0) for _ in range(40)]
    a = frame(spark, polys).select("id", "rings", planar.edges("rings").alias("e"))
    b = a.select(F.col("id").alias("id2"), F.col("e").alias("e2"))
    for r in a.select(planar.area("rings").alias("a"), planar.centroid("rings").alias("c"), "id").collect():
        assert r.a == pytest.approx(S.area(polys[r.id]))
        assert (r.c.x, r.c.y) == pytest.approx(S.centroid(polys[r.id]))
    pairs = a.join(b, F.col("id2") == (F.col("id") * 7 + 3) % 40)
    got = pairs.select(
        "id",
        "id2",
        planar.polygon_distance("e", "e2").alias("d"),
        planar.point_distance("3D", "3D", "e").alias("p"),
    ).collect()
    assert len(got) == 40
    for r in got:
        assert r.d == pytest.approx(S.distance(polys[r.id], polys[r.id2]), abs=1e-9)
        assert r.p == pytest.approx(S.point_distance(polys[r.id], 3, 3), abs=1e-9)


@pytest.mark.parametrize(
    "other, expected",
    [
        (S.box(4.05, 1, 5, 2), True),  # beside an edge
        (S.box(4, 4, 5, 5), True),  # corner to corner
        (S.box(4.09, 4.09, 5, 5), True),  # only the square corner reaches it
        (S.box(4.11, 4.09, 5, 5), False),
        (S.box(4.2, 0, 5, 4), False),
        (S.box(1, 1, 2, 2), True),  # inside
        (S.box(-5, -5, 9, 9), True),  # around
    ],
)
def test_mitre_buffer_of_square(spark, other, expected):
    for mine in (SQUARE, [list(reversed(SQUARE[0]))]):
        df = spark.createDataFrame([(mine, other)], f"{S.RINGS}, o array<array<struct<x:double,y:double>>>")
        df = df.select("rings", planar.edges("o").alias("e"))
        assert df.select(planar.touches_mitre_buffer("rings", 0.1, "e")).first()[0] is expected


def test_mitre_tip_is_cut_at_the_limit(spark):
    # A needle: the full tip would lie at x = 20 + 0.1 / sin(half angle), about 2 m on.
    needle = [S.ring([(0, 1), (0, -1), (20, 0)])]
    for x, expected in ((20.45, True), (20.55, False)):
        other = S.box(x, -0.001, x + 1, 0.001)
        df = spark.createDataFrame([(needle, other)], f"{S.RINGS}, o array<array<struct<x:double,y:double>>>")
        df = df.select("rings", planar.edges("o").alias("e"))
        assert df.select(planar.touches_mitre_buffer("rings", 0.1, "e")).first()[0] is expected


def test_hole_corner_does_not_reach_out(spark):
    inner = S.box(2.5, 2.5, 5.5, 5.5)
    df = spark.createDataFrame([(HOLED, inner)], f"{S.RINGS}, o array<array<struct<x:double,y:double>>>")
    df = df.select("rings", planar.edges("o").alias("e"))
    assert df.select(planar.touches_mitre_buffer("rings", 0.4, "e")).first()[0] is False
    assert df.select(planar.touches_mitre_buffer("rings", 0.5, "e")).first()[0] is True


def test_box_bounds_hold(spark):
    rng = np.random.default_rng(5)
    polys = [S.random_polygon(rng, 0, 0, 3.0) for _ in range(60)]
    df = planar.with_box(frame(spark, polys)).select("*", F.lit(4.0).alias("px"), F.lit(2.0).alias("py"))
    for r in df.select(
        "id",
        planar.box_gap("px", "py", "").alias("gap"),
        planar.box_certain("px", "py", "").alias("sure"),
        planar.box_far("px", "py", "").alias("far"),
    ).collect():
        d = S.point_distance(polys[r.id], 4, 2)
        assert r.gap <= d + 1e-9 and d <= r.sure + 1e-9 and r.sure <= r.far + 1e-9


def test_oriented_box_and_simplify(spark):
    turned = [S.ring([(0, 0), (6, 8), (2, 11), (-4, 3)])]  # 10 by 5, turned
    df = frame(spark, [turned]).select(hull.oriented_box(F.col("rings")).alias("box"))
    short, long = hull.box_sides(F.col("box"))
    r = df.select(short.alias("s"), long.alias("l"), planar.area("box").alias("a")).first()
    assert (round(r.s, 6), round(r.l, 6), round(r.a, 6)) == (5, 10, 50)
    bumpy = [S.ring([(0, 0), (2, 0.05), (4, 0), (4, 4), (2, 3), (0, 4)])]
    thin = frame(spark, [bumpy]).select(hull.simplify(0.1)(F.col("rings")).alias("t"))
    assert thin.select(planar.point_count("t")).first()[0] == 6
    flat = [S.ring([(0, 0), (2, 0.01), (4, 0), (2, -0.01)])]
    thin = frame(spark, [flat]).select(hull.simplify(0.5)(F.col("rings")).alias("t"))
    assert thin.select(planar.point_count("t")).first()[0] >= 4
