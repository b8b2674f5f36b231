"""Thinning that keeps rings simple and apart."""

from __future__ import annotations

import numpy as np
import pytest

from gevel.functions import hull


def segments(rings):
    return np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])


def crossings(rings):
    """Pairs of segments that cross or overlap, by looking at all."""
    s = segments(rings)
    bad = 0
    for i in range(len(s)):
        bad += hull.meets(s[i, :2], s[i, 2:], np.delete(s, i, axis=0))
    return bad


def star(rng, n, rough):
    """A ring about the origin that does not cross itself, with small dents."""
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = 10 + rng.uniform(-rough, rough, n)
    p = np.stack([r * np.cos(turn), r * np.sin(turn)], axis=1)
    return np.vstack([p, p[:1]])


def comb(rng, teeth, gap):
    """Teeth so near to each other that plain thinning of one meets the next."""
    lower, upper = [], []
    for i in range(teeth):
        x = i * 1.0
        lower += [(x, 0), (x + gap * rng.uniform(0.1, 0.9), rng.uniform(4, 5)), (x + gap, 0)]
        upper += [(x + 0.5, 5 + rng.uniform(0, gap))]
    p = np.array([*lower, (teeth, -1), (0, -1.0)])
    return np.vstack([p, p[:1]])


def on_line(rings, thinned, tolerance):
    """Every point that went is near to what stayed."""
    s = segments(thinned)
    for p in np.concatenate(rings):
        d = s[:, 2:] - s[:, :2]
        t = np.clip(((p - s[:, :2]) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        if np.hypot(*(p - s[:, :2] - t[:, None] * d).T).min() > tolerance + 1e-9:
            return False
    return True


@pytest.mark.parametrize("tolerance", [0.1, 0.5, 2.0])
def test_no_crossings(tolerance):
    rng = np.random.default_rng(int(tolerance * 10))
    thinner = 0
    for i in range(250):
        rings = [star(rng, int(rng.integers(5, 60)), rng.uniform(0.05, 3))]
        if i % 2:  # a hole that nearly touches the shell
            rings.append(rings[0][::-1] * rng.uniform(0.9, 0.995))
        if i % 5 == 0:
            rings = [comb(rng, int(rng.integers(2, 8)), rng.uniform(0.05, 0.4))]
        if crossings(rings):
            continue
        out = hull.thin_rings(rings, tolerance)
        assert crossings(out) == 0
        assert all(len(r) >= 4 and (r[0] == r[-1]).all() for r in out)
        assert on_line(rings, out, tolerance)
        thinner += sum(map(len, out)) < sum(map(len, rings))
    assert thinner > 100


def test_a_hole_in_the_way_keeps_the_point():
    """Without the hole the dent goes; a hole within the dent's triangle stays inside the shell."""
    shell = np.array([(0, 0), (5, -0.08), (10, 0), (10, 10), (0, 10), (0, 0.0)])
    hole = np.array([(4.9, -0.03), (5.1, -0.03), (5, -0.06), (4.9, -0.03)])
    assert len(hull.thin_rings([shell], 0.1)[0]) == 5
    assert len(hull.thin_rings([shell, hole], 0.1)[0]) == 6


def test_plain_shapes():
    ell = np.array([(0, 0), (5, 0), (10, 0), (10, 4), (4, 4), (4, 4.05), (4, 10), (0, 10), (0, 0.0)])
    assert len(hull.thin_rings([ell], 0.1)[0]) == 7
    same = np.array([(0, 0), (0, 0), (0, 0), (0, 0), (0, 0.0)])
    assert len(hull.thin_rings([same], 0.1)[0]) <= 5
    triangle = np.array([(0, 0), (1, 0), (0, 1), (0, 0.0)])
    assert (hull.thin_rings([triangle], 5)[0] == triangle).all()
