"""Vector codes and clusters against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from cases import SF

from gevel.llm import clusters, codes
from gevel.llm.blocks import largest

ROWS = "vec_id long, embedding array<float>, label int, state string, c string, part string"
NAN, INF = float("nan"), float("inf")


def awkward(dims=64, n=400):
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(dims)], i % 3, "x", "x", "x") for i in range(n)]
    same = [0.25] * dims
    rows += [(1000 + i, same, None, None, None, None) for i in range(60)]  # ties
    rows += [(7, rows[7][1], 1, "x", "x", "x"), (2, rows[2][1], 2, "x", "x", "x")]  # repeated rows
    rows += [(None, rows[5][1], 1, "x", "x", "x"), (None, same, None, "x", "x", "x")]
    rows += [(2000, None, 1, "x", "x", "x"), (2001, [], 1, "x", "x", "x"), (2002, [None] + same[1:], 1, "x", "x", "x")]
    rows += [(2003, [NAN] + same[1:], 1, "x", "x", "x"), (2004, [-INF] + same[1:], 1, "x", "x", "x")]
    rows += [(2005, same[:-1], 1, "x", "x", "x"), (2006, [3e38] + same[1:], 1, "x", "x", "x")]
    rows += [(-5, [30000.0, -30000.0] + same[2:], 1, "x", "x", "x")]
    return rows


def kept(rows, scale, dims):
    """The rows that count, as (vec_id, whole numbers, label)."""
    out = []
    for i, v, label, *_ in rows:
        if v is None or len(v) != dims or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(float(np.float32(x)) * scale) for x in v]
        if max(map(abs, ints)) < largest(dims):
            out.append((i, ints, label))
    return out


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(points, entries, rounds):
    """Plain Lloyd: entries after the rounds."""
    for _ in range(rounds):
        own = [[] for _ in entries]
        for p in points:
            own[min(range(len(entries)), key=lambda e: (far(p, entries[e]), e))].append(p)
        entries = [[sum(x) // len(g) for x in zip(*g)] if g else e for g, e in zip(own, entries)]
    return entries


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_clusters_against_plain_lloyd(spark):
    rows = awkward()
    own = kept(rows, 64, 64)
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    final = lloyd([p for _, p, _ in own], [p for _, p, _ in sorted(own, key=name)[:16]], 3)
    want = []
    for i, p, _ in own:
        c = min(range(16), key=lambda e: (far(p, final[e]), e))
        want.append((i, c, far(p, final[c])))
    inertia = {c: sum(d for _, x, d in want if x == c) for c in range(16)}
    sha = [hashlib.sha256(",".join(map(str, f)).encode()).hexdigest() for f in final]
    want = [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in want]
    got = clusters.digest(clusters.cluster(spark.createDataFrame(rows, ROWS).repartition(3)))
    assert as_rows(got, *got.columns) == sorted(want, key=str)


@pytest.mark.parametrize("rounds", [0, 6])
def test_codes_against_plain_lloyd(spark, rounds):
    rows = awkward()
    own = kept(rows, 4096, 64)
    first = [p for _, p, _ in sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]]
    cut = lambda p, g: p[8 * g : 8 * g + 8]
    books = [lloyd([cut(p, g) for _, p, _ in own], [cut(p, g) for p in first], rounds) for g in range(8)]
    want, of_label = [], {}
    for i, p, label in own:
        code, error = "", 0
        for g, book in enumerate(books):
            e = min(range(16), key=lambda e: (far(cut(p, g), book[e]), e))
            code, error = code + f"{e:02x}", error + far(cut(p, g), book[e])
        want.append((i, code, error, label))
        of_label[label] = of_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = codes.digest(codes.compress(spark.createDataFrame(rows, ROWS).repartition(3), rounds=rounds))
    assert as_rows(got, *got.columns) == sorted([(i, c, e, of_label[x], sha) for i, c, e, x in want], key=str)


def test_few_and_none(spark):
    none = spark.createDataFrame([], ROWS)
    assert clusters.digest(clusters.cluster(none)).count() == 0
    assert codes.digest(codes.compress(none)).count() == 0
    one = spark.createDataFrame([(3, [0.5] * 64, 1, "x", "x", "x")] * 2, ROWS)
    assert as_rows(clusters.cluster(one)[0], "vec_id", "cluster", "distance") == [(3, 0, 0)] * 2
    assert as_rows(codes.digest(codes.compress(one)), "code", "error") == [("00" * 8, 0)] * 2


def test_bounds_skip_and_agree():
    """Bounds carried over rounds settle vectors unseen, and never another centroid than a whole scan."""
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.integers(-40, 40, (600, 8)) + 400 * k for k in range(5)]).astype(np.int64)
    at = x[::600].copy()
    state, seen = clusters.start_state(len(x), len(at)), []
    for _ in range(4):
        c = clusters.Centroids(at)
        bound = np.maximum(state["lower"], c.half[state["near"]])
        seen.append(int((state["upper"] < bound).sum()))
        state = clusters.assign(x, state, c)
        d = ((x[:, None] - at[None]) ** 2).sum(2)
        assert (state["near"] == d.argmin(1)).all()
        new = np.array([x[state["near"] == k].sum(0) // max(1, (state["near"] == k).sum()) for k in range(len(at))])
        state, at = clusters.moved(state, at, new), new
    assert seen[0] == 0 and seen[-1] > len(x) // 2


@pytest.mark.parametrize("k", [1, 2, 7, 16])
def test_trees_prune_and_agree(k):
    """Dual trees give the codes of a whole scan, ties too, and leave few points of clustered parts to it."""
    draw = np.random.default_rng(k)
    points = np.concatenate([draw.integers(-9, 9, (300, 8)) + 200 * c for c in range(6)]).astype(np.int64)
    order = codes.grow(points, codes.LEAF)
    points = points[order]
    book = points[draw.integers(0, len(points), k)]
    book[-1] = book[0]
    tree = codes.unpacked(codes.packed(points), len(points), 8)
    code, sums, counts, left = codes.lloyd_step(points, tree, book)
    want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (code == want).all()
    assert (counts == np.bincount(want, minlength=k)).all()
    assert all((sums[e] == points[want == e].sum(0)).all() for e in range(k))
    if k <= 2:
        assert left == 0 or book[0].tolist() == book[-1].tolist()


def test_cached_sums_are_used():
    """Two far groups and two entries: both nodes go whole, no point is looked at."""
    points = np.concatenate([np.zeros((64, 2)), np.full((64, 2), 1000)]).astype(np.int64)
    points = points[codes.grow(points, codes.LEAF)]
    tree = codes.unpacked(codes.packed(points), len(points), 2)
    *_, left = codes.lloyd_step(points, tree, np.array([[1, 1], [990, 990]]))
    assert left == 0


def test_given_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert clusters.cluster(rows)[0].count() == codes.compress(rows)[0].count() == rows.count()
