"""Planar polygon measures as SQL expressions over nested arrays.

A polygon is ``rings: array<array<struct<x,y>>>``: the shell first, then the
holes, every ring closed. Pair tests take the flat segment list of
:func:`edges`, best computed once, ahead of a join.

The functions take SQL text (a column name or an expression) and return a
column; those ending in ``_sql`` return text to build on. Text is parsed in one
go, where thousands of nested column calls would each cross into the JVM.
Lambdas evaluate what they capture anew for every element, hence :func:`let`.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = count()


def _var() -> str:
    return f"v{next(_names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    v = _var()
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def each(array: str, body: Callable[[str], str]) -> str:
    v = _var()
    return f"transform({array}, {v} -> {body(v)})"


def fold(array: str, start: str, step: Callable[[str, str], str], finish=None) -> str:
    acc, v = _var(), _var()
    end = "" if finish is None else f", {acc} -> {finish(acc)}"
    return f"aggregate({array}, {start}, ({acc}, {v}) -> {step(acc, v)}{end})"


def _sum(array: str) -> str:
    return fold(array, "0D", lambda acc, v: f"{acc} + {v}")


def rectangle(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Counter-clockwise rectangle as a one-ring polygon."""

    def pt(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(
        F.array(pt(minx, miny), pt(maxx, miny), pt(maxx, maxy), pt(minx, maxy), pt(minx, miny))
    )


def box_of(rings: str) -> list[Column]:
    """``minx, miny, maxx, maxy`` of all rings."""
    return [
        F.expr(f"array_{end}({each(f'flatten({rings})', lambda p: f'{p}.{axis}')})").alias(f"{end}{axis}")
        for end, axis in (("min", "x"), ("min", "y"), ("max", "x"), ("max", "y"))
    ]


def with_box(df, rings: str = "rings"):
    return df.select("*", *box_of(rings))


def _segments(ring: str) -> str:
    """Consecutive points as ``struct<x1,y1,x2,y2>``."""
    n = f"greatest(size({ring}) - 1, 0)"
    p, q = _var(), _var()
    pair = f"named_struct('x1', {p}.x, 'y1', {p}.y, 'x2', {q}.x, 'y2', {q}.y)"
    return f"zip_with(slice({ring}, 1, {n}), slice({ring}, 2, {n}), ({p}, {q}) -> {pair})"


def _segment(x1: str, y1: str, x2: str, y2: str) -> str:
    """A segment with its unit direction and length; one without length gets zeros."""
    return let(
        f"hypot({x2} - {x1}, {y2} - {y1})",
        lambda n: f"""named_struct('x1', {x1}, 'y1', {y1}, 'x2', {x2}, 'y2', {y2},
            'ux', if({n} > 0, ({x2} - {x1}) / {n}, 0D), 'uy', if({n} > 0, ({y2} - {y1}) / {n}, 0D),
            'n', {n})""",
    )


def edges_sql(rings: str) -> str:
    def of_ring(ring: str) -> str:
        return each(_segments(ring), lambda s: _segment(f"{s}.x1", f"{s}.y1", f"{s}.x2", f"{s}.y2"))

    return f"flatten({each(rings, of_ring)})"


def edges(rings: str) -> Column:
    """All segments of all rings: ``array<struct<x1,y1,x2,y2,ux,uy,n>>``."""
    return F.expr(edges_sql(rings))


def _cross(s: str, o: str) -> str:
    """Twice the signed area of the triangle of a segment and a point."""
    return f"(({s}.x1 - {o}.x) * ({s}.y2 - {o}.y) - ({s}.x2 - {o}.x) * ({s}.y1 - {o}.y))"


def _doubled_area(ring: str) -> str:
    return _sum(each(_segments(ring), lambda s: _cross(s, f"{ring}[0]")))


def area_sql(rings: str) -> str:
    ring, i = _var(), _var()
    signed = f"if({i} = 0, 0.5D, -0.5D) * abs({_doubled_area(ring)})"
    return _sum(f"transform({rings}, ({ring}, {i}) -> {signed})")


def area(rings: str) -> Column:
    """Shell minus holes, whatever way the rings turn."""
    return F.expr(area_sql(rings))


def perimeter(rings: str) -> Column:
    length = each(
        rings, lambda r: _sum(each(_segments(r), lambda s: f"hypot({s}.x2 - {s}.x1, {s}.y2 - {s}.y1)"))
    )
    return F.expr(_sum(length))


def point_count(rings: str) -> Column:
    """Number of stored points; the closing point of each ring counts."""
    return F.expr(fold(rings, "0", lambda acc, ring: f"{acc} + size({ring})"))


def centroid_sql(rings: str) -> str:
    def add(acc: str, m: str) -> str:
        return (
            f"named_struct('w', {acc}.w + {m}.w, 'mx', {acc}.mx + {m}.mx, 'my', {acc}.my + {m}.my)"
        )

    zero = "named_struct('w', 0D, 'mx', 0D, 'my', 0D)"

    def body(g: str) -> str:
        origin = f"{g}[0][0]"

        def by_triangle(s: str) -> str:
            return let(
                _cross(s, origin),
                lambda c: f"""named_struct('w', {c}, 'mx', ({s}.x1 + {s}.x2 - 2 * {origin}.x) * {c},
                              'my', ({s}.y1 + {s}.y2 - 2 * {origin}.y) * {c})""",
            )

        def by_length(s: str) -> str:
            return f"""named_struct('w', {s}.n, 'mx', {s}.n * ({s}.x1 + {s}.x2) / 2,
                                    'my', {s}.n * ({s}.y1 + {s}.y2) / 2)"""

        # The shell counts as positive and holes as negative, whichever way they turn.
        ring, i = _var(), _var()
        signed = let(
            fold(each(_segments(ring), by_triangle), zero, add),
            lambda m: let(
                f"if(({m}.w < 0) = ({i} = 0), -1D, 1D)",
                lambda k: f"named_struct('w', {k} * {m}.w, 'mx', {k} * {m}.mx, 'my', {k} * {m}.my)",
            ),
        )
        total = fold(f"transform({g}, ({ring}, {i}) -> {signed})", zero, add)
        outline = let(
            fold(each(edges_sql(g), by_length), zero, add),
            lambda t: f"""if({t}.w > 0, named_struct('x', {t}.mx / {t}.w, 'y', {t}.my / {t}.w),
                             named_struct('x', {origin}.x, 'y', {origin}.y))""",
        )
        return let(
            total,
            lambda t: f"""if({t}.w <> 0, named_struct('x', {origin}.x + {t}.mx / (3 * {t}.w),
                                                      'y', {origin}.y + {t}.my / (3 * {t}.w)), {outline})""",
        )

    return let(rings, body)


def centroid(rings: str) -> Column:
    """``struct<x,y>``; a polygon without area falls back to its outline."""
    return F.expr(f"if({rings} is null, null, {centroid_sql(rings)})")


FAR = "double('infinity')"


def point_segment_sql(px: str, py: str, s: str) -> str:
    """Distance from a point to a segment."""
    along = (
        f"least(greatest(({px} - {s}.x1) * {s}.ux + ({py} - {s}.y1) * {s}.uy, 0D), {s}.n)"
    )
    return let(
        along,
        lambda t: f"hypot({px} - {s}.x1 - {t} * {s}.ux, {py} - {s}.y1 - {t} * {s}.uy)",
    )


def inside_sql(px: str, py: str, outline: str) -> str:
    """Even-odd test against an edge list; points on an edge may go either way."""
    s = _var()
    crosses = f"""(({s}.y1 > {py}) <> ({s}.y2 > {py}))
        and {px} < ({s}.x2 - {s}.x1) * ({py} - {s}.y1) / ({s}.y2 - {s}.y1) + {s}.x1"""
    return f"(size(filter({outline}, {s} -> {crosses})) % 2 = 1)"


def point_distance_sql(px: str, py: str, outline: str) -> str:
    nearest = fold(
        outline, FAR, lambda acc, s: f"least({acc}, {point_segment_sql(px, py, s)})"
    )
    return f"if({inside_sql(px, py, outline)}, 0D, {nearest})"


def point_distance(px: str, py: str, outline: str) -> Column:
    """Distance from a point to a polygon given by its edges; 0 inside."""
    return F.expr(point_distance_sql(px, py, outline))


def _properly_cross(s: str, t: str) -> str:
    def side(i: int, u: str, v: str) -> str:
        return f"(({v}.x2 - {v}.x1) * ({u}.y{i} - {v}.y1) - ({v}.y2 - {v}.y1) * ({u}.x{i} - {v}.x1))"

    return f"({side(1, s, t)} * {side(2, s, t)} < 0 and {side(1, t, s)} * {side(2, t, s)} < 0)"


def polygon_distance_sql(a: str, b: str) -> str:
    def gap(e: str) -> str:
        one, two = f"{e}.a", f"{e}.b"

        def closer(acc: str, s: str) -> str:
            return fold(
                two,
                acc,
                lambda inner, t: f"""if({_properly_cross(s, t)}, 0D, least({inner},
                    {point_segment_sql(f'{s}.x1', f'{s}.y1', t)},
                    {point_segment_sql(f'{t}.x1', f'{t}.y1', s)}))""",
            )

        nested = (
            f"{inside_sql(f'{one}[0].x1', f'{one}[0].y1', two)} or "
            f"{inside_sql(f'{two}[0].x1', f'{two}[0].y1', one)}"
        )
        return f"if({nested}, 0D, {fold(one, FAR, closer)})"

    return let(f"named_struct('a', {a}, 'b', {b})", gap)


def polygon_distance(a: str, b: str) -> Column:
    """Distance between two polygons given by edge lists; 0 when they meet."""
    return F.expr(polygon_distance_sql(a, b))


def mitre_corners_sql(rings: str, size: float, other: str, limit: float) -> str:
    """What a mitre buffer adds beyond a round one: one kite per convex corner.

    Each kite is an edge list (corner, offset, tip, tip, offset). A tip farther
    than ``limit * size`` from its corner is cut off square. Corners out of
    reach of ``other`` (edges) are left out.
    """

    def of_ring(ring: str, i: str) -> str:
        s = _var()
        kept = f"filter({edges_sql(f'array({ring})')}, {s} -> {s}.n > 0)"
        turned = f"(({_doubled_area(ring)}) > 0) = ({i} = 0)"
        back = each(
            f"reverse({kept})", lambda t: _segment(f"{t}.x2", f"{t}.y2", f"{t}.x1", f"{t}.y1")
        )
        # Each segment next to the one that ends where it starts; outside is on the right.
        p, q = _var(), _var()
        corner = f"""named_struct('x', {q}.x1, 'y', {q}.y1, 'ax', {p}.uy, 'ay', -{p}.ux,
                                  'bx', {q}.uy, 'by', -{q}.ux)"""
        return let(
            f"if({turned}, {kept}, {back})",
            lambda o: f"""zip_with(slice(concat(slice({o}, -1, 1), {o}), 1, size({o})), {o},
                                   ({p}, {q}) -> {corner})""",
        )

    ring, i, c = _var(), _var(), _var()
    near = f"""{c}.ax * {c}.by - {c}.ay * {c}.bx > 1e-12D
        and {point_distance_sql(f'{c}.x', f'{c}.y', other)} <= {1.001 * limit * size}D"""
    corners = f"filter(flatten(transform({rings}, ({ring}, {i}) -> {of_ring(ring, i)})), {c} -> {near})"

    def kite(c: str) -> str:
        # How sharp the corner is, and how much of the tip the limit leaves.
        sharp = f"greatest(1 + {c}.ax * {c}.bx + {c}.ay * {c}.by, 1e-12D)"

        def points(k: str) -> str:
            ratio = f"sqrt(2 / {k})"
            keep = f"if({ratio} > {limit}D, ({limit}D - 1 / {ratio}) / ({ratio} - 1 / {ratio}), 1D)"
            tip = {a: f"({c}.a{a} + {c}.b{a}) / {k}" for a in "xy"}

            def pt(by: dict[str, str]) -> str:
                return f"named_struct('x', {c}.x + {size}D * ({by['x']}), 'y', {c}.y + {size}D * ({by['y']}))"

            def toward_tip(n: str, m: str) -> dict[str, str]:
                return {a: f"{c}.{n}{a} + {m} * ({tip[a]} - {c}.{n}{a})" for a in "xy"}

            corner = f"named_struct('x', {c}.x, 'y', {c}.y)"
            return let(
                keep,
                lambda m: f"""array({corner}, {pt({a: f'{c}.a{a}' for a in 'xy'})},
                    {pt(toward_tip('a', m))}, {pt(toward_tip('b', m))},
                    {pt({a: f'{c}.b{a}' for a in 'xy'})}, {corner})""",
            )

        return edges_sql(f"array({let(sharp, points)})")

    return each(corners, kite)


def touches_mitre_buffers(rings: str, sizes: list[float], other: str, limit: float = 5.0) -> Column:
    """For each buffer size, whether ``other`` (edges) meets the mitre buffer of ``rings``."""

    def of_size(gap: str, size: float) -> str:
        # The corners matter only in the belt that a round buffer misses.
        kite = _var()
        by_corner = f"""exists({mitre_corners_sql(rings, size, other, limit)},
                               {kite} -> {polygon_distance_sql(kite, other)} <= 1e-9D)"""
        return f"case when {gap} <= {size}D then true when {gap} > {limit * size}D then false else {by_corner} end"

    return F.expr(
        let(
            polygon_distance_sql(edges_sql(rings), other),
            lambda gap: f"array({', '.join(of_size(gap, s) for s in sizes)})",
        )
    )


def touches_mitre_buffer(rings: str, size: float, other: str, limit: float = 5.0) -> Column:
    return touches_mitre_buffers(rings, [size], other, limit)[0]


def box_gap(px: str, py: str, box: str) -> Column:
    """Distance from a point to a box (``box`` prefixes its columns); the polygon is no nearer."""
    dx, dy = (
        f"greatest({box}min{a} - {p}, 0D, {p} - {box}max{a})" for a, p in (("x", px), ("y", py))
    )
    return F.expr(f"hypot({dx}, {dy})")


def _far(p: str, box: str, a: str) -> str:
    return f"greatest(abs({p} - {box}min{a}), abs({p} - {box}max{a}))"


def box_far(px: str, py: str, box: str) -> Column:
    """Distance from a point to the farthest corner of a box."""
    return F.expr(f"hypot({_far(px, box, 'x')}, {_far(py, box, 'y')})")


def box_certain(px: str, py: str, box: str) -> Column:
    """Distance within which the polygon of a tight box surely has a point.

    The polygon touches all four sides of its box (Roussopoulos et al. 1995).
    """
    near_x, near_y = (
        f"({p} - if({p} <= ({box}min{a} + {box}max{a}) / 2, {box}min{a}, {box}max{a}))"
        for a, p in (("x", px), ("y", py))
    )
    return F.expr(
        f"least(hypot({near_x}, {_far(py, box, 'y')}), hypot({_far(px, box, 'x')}, {near_y}))"
    )
