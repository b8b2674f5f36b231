"""Spatial joins on a grid.

Boxes are spread over the grid cells they touch and matched by an equi-join on
the cell, so the work is shuffled by place. A pair that shares several cells is
kept only in the one that holds the lower-left corner of the overlap of its two
boxes (Dittrich & Seeger 2000); no distinct is needed.

Crowded places are handled in two ways. Cells with many rows are cut into finer
ones. And equal footprints are joined once, with their number of copies as a
weight; what a building sees is then the weighted sum over distinct shapes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gevel.functions import planar
from gevel.operators.lookup import bounded, shuffled
from gevel.session import materialize

BOX = ["minx", "miny", "maxx", "maxy"]
CROWDED = 512
MAX_SPLIT = 1024


def _index(value: Column, cell: float, split: Column | int = 1) -> Column:
    # With split a power of two, finer cells nest exactly in coarser ones.
    return F.floor(value * split / F.lit(cell))


def _spread(df: DataFrame, p: str, reach: float, cell: float) -> DataFrame:
    lo = lambda axis: _index(F.col(f"{p}min{axis}") - reach, cell)
    hi = lambda axis: _index(F.col(f"{p}max{axis}") + reach, cell)
    return df.withColumn("cx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn(
        "cy", F.explode(F.sequence(lo("y"), hi("y")))
    )


def _spread_finer(df: DataFrame, splits: DataFrame, p: str, reach: float, cell: float) -> DataFrame:
    """Within crowded cells, spread again over the finer cells."""
    split = F.coalesce(F.col("split"), F.lit(1).cast("long"))
    df = df.join(splits, ["cx", "cy"], "left").withColumn("split", split)

    def span(axis: str) -> Column:
        base = F.col(f"c{axis}") * F.col("split")
        lo = F.greatest(base, _index(F.col(f"{p}min{axis}") - reach, cell, F.col("split")))
        hi = F.least(
            base + F.col("split") - 1, _index(F.col(f"{p}max{axis}") + reach, cell, F.col("split"))
        )
        return F.explode(F.sequence(lo, hi))

    return df.withColumn("fx", span("x")).withColumn("fy", span("y"))


def _power_of_two(x: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(x))).cast("long")


def crowded_cells(cells: DataFrame, per_cell: int) -> DataFrame:
    """Cells ``(cx, cy)`` with more rows than ``per_cell``, and the split they need."""
    counts = cells.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > per_cell).select(
        "cx",
        "cy",
        F.least(_power_of_two(F.sqrt(F.col("n") / per_cell)), F.lit(MAX_SPLIT)).alias("split"),
    )


def box_pairs(
    probe: DataFrame,
    build: DataFrame,
    reach: float,
    cell: float | None = None,
    per_cell: int | None = CROWDED,
) -> DataFrame:
    """Pairs whose boxes, the probe's grown by ``reach``, overlap or touch.

    Both sides carry ``minx, miny, maxx, maxy``; columns come back prefixed
    ``a_`` (probe) and ``b_`` (build). Every pair appears exactly once.
    ``per_cell=None`` skips the look for crowded cells.
    """
    cell = float(cell or max(reach, 25.0))
    a = probe.select(*[F.col(c).alias(f"a_{c}") for c in probe.columns])
    b = build.select(*[F.col(c).alias(f"b_{c}") for c in build.columns])
    a, b = _spread(a, "a_", reach, cell), _spread(b, "b_", 0.0, cell)
    corner = {
        axis: F.greatest(F.col(f"a_min{axis}") - reach, F.col(f"b_min{axis}")) for axis in "xy"
    }
    overlap = reduce(
        lambda x, y: x & y,
        [
            (F.col(f"a_min{axis}") - reach <= F.col(f"b_max{axis}"))
            & (F.col(f"b_min{axis}") <= F.col(f"a_max{axis}") + reach)
            for axis in "xy"
        ],
    )
    splits = None if per_cell is None else crowded_cells(b.select("cx", "cy"), per_cell)
    if splits is None or splits.isEmpty():
        keys = ["cx", "cy"]
        first = (_index(corner["x"], cell) == F.col("cx")) & (
            _index(corner["y"], cell) == F.col("cy")
        )
    else:
        splits = bounded(splits)
        a = _spread_finer(a, splits, "a_", reach, cell)
        b = _spread_finer(b, splits, "b_", 0.0, cell).drop("split")
        keys = ["cx", "cy", "fx", "fy"]
        first = (_index(corner["x"], cell, F.col("split")) == F.col("fx")) & (
            _index(corner["y"], cell, F.col("split")) == F.col("fy")
        )
    # The work is in the pairs, not in the bytes: keep adaptive execution from
    # merging small partitions. The join below needs this very partitioning.
    parts = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(parts, *keys).join(shuffled(b), keys).filter(overlap & first).drop(*keys, "split")


def shape_key(rings: Column) -> Column:
    """A 128-bit hash to group and join footprints by, so that outlines are no keys; null without rings."""
    halves = [F.hex(F.xxhash64(rings)), F.hex(F.xxhash64(F.lit("shape"), rings))]
    return F.when(rings.isNotNull(), F.concat_ws("-", *halves))


def distinct_shapes(rows: DataFrame, **flags: Column) -> DataFrame:
    """One row per distinct footprint: ``shape_key``, ``shape_id``, box, ``copies`` and counts of flags."""
    return (
        rows.filter(F.col("rings").isNotNull())
        .groupBy(shape_key(F.col("rings")).alias("shape_key"))
        .agg(
            F.first("rings").alias("rings"),
            F.min("bag_id").alias("shape_id"),
            F.count(F.lit(1)).alias("copies"),
            *[F.count_if(cond).alias(name) for name, cond in flags.items()],
        )
        .select("*", *planar.box_of("rings"))
    )


def touching_shapes(
    shapes: DataFrame, sizes: list[float], limit: float = 5.0, cell: float = 25.0
) -> DataFrame:
    """Ordered pairs of different shapes, one join for all buffer sizes.

    Returns ``a_id, b_id, touch_0, touch_1, ...``: whether ``b`` meets the
    buffer of ``a`` of each size.
    """
    probe = shapes.select("shape_id", "rings", *BOX)
    build = shapes.select("shape_id", planar.edges("rings").alias("edges"), *BOX)
    pairs = box_pairs(probe, build, limit * max(sizes), cell).filter("a_shape_id != b_shape_id")
    touches = planar.touches_mitre_buffers("a_rings", sizes, "b_edges", limit)
    return pairs.select(
        F.col("a_shape_id").alias("a_id"), F.col("b_shape_id").alias("b_id"), touches.alias("t")
    ).select("a_id", "b_id", *[F.col("t")[i].alias(f"touch_{i}") for i in range(len(sizes))])


def _home(df: DataFrame, cell: float) -> DataFrame:
    return df.withColumn("cx", _index((F.col("minx") + F.col("maxx")) / 2, cell)).withColumn(
        "cy", _index((F.col("miny") + F.col("maxy")) / 2, cell)
    )


def _pair_counts(pairs: DataFrame, radii: list[float], only: list[Column] | None = None) -> DataFrame:
    """Weighted hits per radius from pairs of a centre and a shape.

    The box bounds settle most pairs; the outline is measured for the rest.
    """
    pairs = pairs.withColumn("gap", planar.box_gap("a_px", "a_py", "b_")).withColumn(
        "certain", planar.box_certain("a_px", "a_py", "b_")
    )
    unsettled = reduce(
        lambda x, y: x | y, [(F.col("gap") <= r) & (F.col("certain") > r) for r in radii]
    )
    exact = F.when(unsettled, planar.point_distance("a_px", "a_py", "b_edges"))
    pairs = pairs.withColumn("exact", exact)
    hits = []
    for i, r in enumerate(radii):
        hit = (F.col("certain") <= r) | ((F.col("gap") <= r) & (F.col("exact") <= r))
        if only is not None:
            hit = hit & only[i]
        hits.append(F.sum(F.when(hit, F.col("b_copies")).otherwise(0)).alias(f"within_{i}"))
    return pairs.groupBy(F.col("a_shape_id").alias("shape_id")).agg(*hits)


def block_pyramid(members: DataFrame, reach: float) -> DataFrame:
    """Blocks of crowded cells: ``(level, cx, cy, bx, by, copies, box, is_leaf)``.

    Level 0 is a cell as a whole, and each next one halves its blocks both ways down to
    the cell's ``depth``, where a block has a handful of shapes. A block's box is that of
    the shapes whose middle lies in it. Counts of a level come from those of the next.
    """
    side = F.pow(F.lit(2.0), F.col("depth"))
    sums = [F.sum("copies").alias("copies")] + [
        (F.min if c.startswith("min") else F.max)(c).alias(c) for c in BOX
    ]
    finest = members.withColumns(
        {
            "bx": _index((F.col("minx") + F.col("maxx")) / 2, reach, side),
            "by": _index((F.col("miny") + F.col("maxy")) / 2, reach, side),
        }
    )
    leaves = finest.groupBy("cx", "cy", "bx", "by", "depth").agg(*sums)
    coarser = leaves.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    shifted = F.floor(F.col("bx") / F.pow(F.lit(2.0), F.col("up"))), F.floor(F.col("by") / F.pow(F.lit(2.0), F.col("up")))
    return (
        coarser.withColumns({"bx": shifted[0], "by": shifted[1], "level": F.col("depth") - F.col("up")})
        .groupBy("level", "depth", "cx", "cy", "bx", "by")
        .agg(*sums)
        .withColumn("is_leaf", F.col("level") == F.col("depth"))
        .drop("depth")
    )


def block_counts(
    probe: DataFrame, members: DataFrame, reach: float, radii: list[float]
) -> tuple[DataFrame, DataFrame]:
    """Weighted counts of whole blocks within each radius, and the pairs that are left to measure.

    A centre starts at whole cells. A block within a radius counts there as it is, one
    beyond is dropped, and one that the circle cuts is replaced by its four parts. So a
    centre meets the blocks along its circles' rims, and shapes of the finest ones only.
    """
    blocks = materialize(block_pyramid(members, reach), "blocks")
    deepest = blocks.agg(F.max("level")).first()[0] or 0  # levels are a handful: log2 of a cell's split
    place = ["cx", "cy", "bx", "by"]
    n = range(len(radii))
    any_cut = reduce(lambda x, y: x | y, [F.col(f"cut_{i}") for i in n])

    def judged(met: DataFrame, open_at) -> DataFrame:
        """What each radius that is still open makes of a block."""
        gap, far = planar.box_gap("a_px", "a_py", "b_"), planar.box_far("a_px", "a_py", "b_")
        met = met.withColumn("gap", gap).withColumn("far", far)
        cut = {f"cut_{i}": open_at(i) & (F.col("gap") <= r) & (F.col("far") > r) for i, r in enumerate(radii)}
        full = {f"full_{i}": F.when(open_at(i) & (F.col("far") <= r), F.col("b_copies")).otherwise(0) for i, r in enumerate(radii)}
        some = reduce(lambda x, y: x | y, [(F.col(f"full_{i}") > 0) for i in n], any_cut)
        own = ["a_shape_id", "a_px", "a_py", *place, "is_leaf", *cut, *full]
        return met.withColumns(cut | full).filter(some).select(*own)

    top = blocks.filter("level = 0").select("copies", *BOX, *[F.col(c).alias(f"k_{c}") for c in place], "is_leaf")
    met = box_pairs(probe, top, reach, reach, None)
    met = met.select("a_shape_id", "a_px", "a_py", "b_copies", *[f"b_{c}" for c in BOX], F.col("b_is_leaf").alias("is_leaf"),
                     *[F.col(f"b_k_{c}").alias(c) for c in place])
    front = materialize(judged(met, lambda i: F.lit(True)), "front")
    whole, cut_leaves = [], []
    for level in range(deepest + 1):
        whole.append(front.groupBy(F.col("a_shape_id").alias("shape_id")).agg(*[F.sum(f"full_{i}").alias(f"within_{i}") for i in n]))
        cut_leaves.append(front.filter(any_cut & F.col("is_leaf")))
        if level == deepest:
            break
        finer = blocks.filter(F.col("level") == level + 1).select(
            "cx", "cy", "bx", "by", "is_leaf", *[F.col(c).alias(f"b_{c}") for c in ["copies", *BOX]],
            F.floor(F.col("bx") / 2).alias("ux"), F.floor(F.col("by") / 2).alias("uy"),
        )
        up = front.filter(any_cut & ~F.col("is_leaf")).select(
            "a_shape_id", "a_px", "a_py", "cx", "cy", F.col("bx").alias("ux"), F.col("by").alias("uy"),
            *[F.col(f"cut_{i}").alias(f"open_{i}") for i in n],
        )
        front = materialize(judged(up.join(finer, ["cx", "cy", "ux", "uy"]), lambda i: F.col(f"open_{i}")), "front")
    side = F.pow(F.lit(2.0), F.col("depth"))
    inside = members.select(
        "cx",
        "cy",
        _index((F.col("minx") + F.col("maxx")) / 2, reach, side).alias("bx"),
        _index((F.col("miny") + F.col("maxy")) / 2, reach, side).alias("by"),
        *[F.col(c).alias(f"b_{c}") for c in ["shape_id", "copies", "edges", *BOX]],
    )
    opened = reduce(DataFrame.unionByName, cut_leaves).select("a_shape_id", "a_px", "a_py", *place, *[f"cut_{i}" for i in n])
    return reduce(DataFrame.unionByName, whole), opened.join(inside, place)


def shapes_within(shapes: DataFrame, radii: list[float], per_cell: int = CROWDED) -> DataFrame:
    """Per shape, how many footprints lie within each radius of its centroid.

    Returns ``shape_id, within_0, within_1, ...`` counting copies and the
    building itself where its own outline is that near. Shapes in crowded cells
    are counted by whole blocks of every size; only the finest ones that a circle
    cuts through are opened into pairs.
    """
    reach = float(max(radii))
    located = shapes.select(
        "shape_id",
        "copies",
        *BOX,
        planar.edges("rings").alias("edges"),
        planar.centroid("rings").alias("c"),
    )
    probe = located.select(
        "shape_id",
        F.col("c.x").alias("px"),
        F.col("c.y").alias("py"),
        F.col("c.x").alias("minx"),
        F.col("c.y").alias("miny"),
        F.col("c.x").alias("maxx"),
        F.col("c.y").alias("maxy"),
    )
    build = located.select("shape_id", "copies", "edges", *BOX)
    homes = _home(shapes.select(*BOX), reach)
    splits = crowded_cells(homes, per_cell)
    if splits.isEmpty():
        return _pair_counts(box_pairs(probe, build, reach, reach, None), radii)

    splits = bounded(splits)
    build = _home(build, reach)
    sparse = build.join(splits, ["cx", "cy"], "left_anti").drop("cx", "cy")
    members = build.join(splits, ["cx", "cy"]).withColumn("depth", F.log2("split").cast("int") + 1)
    whole, opened = block_counts(probe, members, reach, radii)
    parts = [
        _pair_counts(box_pairs(probe, sparse, reach, reach, None), radii),
        whole,
        _pair_counts(opened, radii, [F.col(f"cut_{i}") for i in range(len(radii))]),
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("shape_id")
        .agg(*[F.sum(f"within_{i}").alias(f"within_{i}") for i in range(len(radii))])
    )


def _levels(extent, finest: float) -> int:
    side = max(extent["x1"] - extent["x0"], extent["y1"] - extent["y0"], finest)
    return math.ceil(math.log2(side / finest)) + 1


def reach_bounds(points: DataFrame, x0: float, y0: float, finest: float, top: int) -> DataFrame:
    """``(shape_id, reach)``: a distance within which every point ``(px, py)`` has another one.

    Points are counted in squares of every power of two. Where a square holds two or
    more, none of them is further from another than the farthest corner of their box.
    Level ``top`` is one square for all.
    """
    size = F.lit(finest) * F.pow(F.lit(2.0), F.col("level"))
    squares = points.select("shape_id", "px", "py", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")).select(
        "*",
        F.floor((F.col("px") - x0) / size).alias("cx"),
        F.floor((F.col("py") - y0) / size).alias("cy"),
    )
    shared = squares.groupBy("level", "cx", "cy").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(p).alias(f"{name}{a}") for a, p in (("x", "px"), ("y", "py")) for name, f in (("min", F.min), ("max", F.max))],
    )
    far = planar.box_far("px", "py", "")
    return (
        squares.join(shared.filter("n > 1"), ["level", "cx", "cy"])
        .groupBy("shape_id")
        .agg(F.min(far).alias("reach"))
    )


def nearest_distance(shapes: DataFrame, finest: float = 4.0) -> DataFrame:
    """Distance from each shape to the nearest other footprint.

    Boxes go first, without outlines. Counts in squares bound how far each shape's
    nearest can be; with that reach it meets the boxes around it in squares of about
    the reach, whatever the density there. The nearest sure point of those boxes bounds
    it again. The outline in the nearest box is measured, and then those in boxes that
    are nearer than it turned out to be.
    A shape with copies is at distance 0. The last shape standing alone gets null.
    """
    corner = F.col("rings")[0][0]
    boxes = shapes.select("shape_id", "copies", *BOX, corner["x"].alias("px"), corner["y"].alias("py"))
    boxes = materialize(boxes, "boxes")
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    extent = boxes.agg(
        F.min("px").alias("x0"),
        F.min("py").alias("y0"),
        F.max("px").alias("x1"),
        F.max("py").alias("y1"),
        F.avg(side).alias("side"),
    ).first()
    copied = boxes.filter("copies > 1").select("shape_id", F.lit(0.0).alias("closest_distance"))
    if extent["x0"] is None:
        return copied
    finest, x0, y0 = max(finest, extent["side"]), extent["x0"], extent["y0"]
    top = _levels(extent, finest)
    single = boxes.filter("copies = 1").select("shape_id", "px", "py", *BOX)
    reached = single.join(reach_bounds(boxes, x0, y0, finest, top), "shape_id")
    need = F.greatest(F.col("reach"), F.lit(finest))
    probe = reached.withColumn("level", F.least(F.ceil(F.log2(need / finest)), F.lit(top)).cast("int"))
    probe = materialize(probe, "reached")
    used = [r["level"] for r in probe.select("level").distinct().collect()]  # at most ``top`` + 1
    if not used:
        alone = single.select("shape_id", F.lit(None).cast("double").alias("closest_distance"))
        return copied.unionByName(alone)

    def over(df: DataFrame, p: str, reach: Column) -> DataFrame:
        size = F.lit(finest) * F.pow(F.lit(2.0), F.col("level"))
        for axis, start in (("x", x0), ("y", y0)):
            lo = F.floor((F.col(f"{p}min{axis}") - reach - start) / size)
            hi = F.floor((F.col(f"{p}max{axis}") + reach - start) / size)
            df = df.withColumn(f"c{axis}", F.explode(F.sequence(lo, hi)))
        return df

    a = probe.select("level", *[F.col(c).alias(f"a_{c}") for c in ["shape_id", "reach", "px", "py", *BOX]])
    b = boxes.select(
        *[F.col(c).alias(f"b_{c}") for c in ["shape_id", *BOX]], F.explode(F.array(*map(F.lit, used))).alias("level")
    )
    met = over(a, "a_", F.col("a_reach")).join(over(b, "b_", F.lit(0.0)), ["level", "cx", "cy"])
    size = F.lit(finest) * F.pow(F.lit(2.0), F.col("level"))
    first = reduce(
        lambda x, y: x & y,
        [
            F.floor((F.greatest(F.col(f"a_min{axis}") - F.col("a_reach"), F.col(f"b_min{axis}")) - start) / size)
            == F.col(f"c{axis}")
            for axis, start in (("x", x0), ("y", y0))
        ],
    )
    apart = F.hypot(
        *[
            F.greatest(F.col(f"a_min{x}") - F.col(f"b_max{x}"), F.lit(0.0), F.col(f"b_min{x}") - F.col(f"a_max{x}"))
            for x in "xy"
        ]
    )
    pairs = met.filter(first & (F.col("a_shape_id") != F.col("b_shape_id"))).select(
        F.col("a_shape_id").alias("shape_id"),
        F.col("b_shape_id").alias("other"),
        apart.alias("apart"),
        F.least("a_reach", planar.box_certain("a_px", "a_py", "b_")).alias("sure"),
    )
    # the bound of a shape comes of the few boxes within its reach
    nearest = F.min("sure").over(Window.partitionBy("shape_id"))
    close = pairs.withColumn("nearest", nearest).filter(F.col("apart") <= F.col("nearest") * (1 + 1e-9))
    close = materialize(close.select("shape_id", "other", "apart"), "close")
    outlines = shapes.select(F.col("shape_id").alias("other"), planar.edges("rings").alias("b_edges"))
    own = shapes.select("shape_id", planar.edges("rings").alias("a_edges"))
    gap = planar.polygon_distance("a_edges", "b_edges")

    def measured(some: DataFrame) -> DataFrame:
        return some.select("shape_id", "other").join(outlines, "other").join(own, "shape_id").select("shape_id", "other", gap.alias("d"))

    # the nearest box is measured first; of the others only boxes nearer than its outline can matter
    first = close.groupBy("shape_id").agg(F.min(F.struct("apart", "other")).alias("f"))
    first = materialize(measured(first.select("shape_id", "f.other")), "first")
    bound = first.select("shape_id", F.col("other").alias("measured"), "d")
    rest = close.join(bound, "shape_id").filter((F.col("apart") < F.col("d")) & (F.col("other") != F.col("measured")))
    found = first.unionByName(measured(rest)).groupBy("shape_id").agg(F.min("d").alias("closest_distance"))
    return copied.unionByName(found)
