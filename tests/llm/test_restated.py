"""The fits of op7 and op10 restated number by number."""

from __future__ import annotations

import math
import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from gevel.llm import sites, toxicity


def scalar_ftrl(rows, epochs):
    """FTRL-proximal one coordinate at a time, as McMahan et al. (2013) give it, in plain floats."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= toxicity.L1:
            return 0.0
        rate = (toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2
        return -(zi - math.copysign(toxicity.L1, zi)) / rate

    for _ in range(epochs):
        for buckets, label in rows:
            own = [*buckets, "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in own:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


@pytest.mark.parametrize("epochs", [1, 3])
def test_ftrl_by_coordinates(epochs):
    draw = random.Random(epochs)
    rows = []
    for k in range(300):
        label = int(draw.random() < 0.4)
        own = {draw.randrange(40) + 100 * (draw.random() < 0.3 + 0.5 * label) for _ in range(12)}
        rows.append((np.array(sorted(own)), label))
    want = scalar_ftrl([(b.tolist(), y) for b, y in rows], epochs)
    got = toxicity.ftrl(rows, epochs)
    held = dict(zip(got.bucket.tolist(), got.weight.tolist()))
    assert got.bias == pytest.approx(want.pop("bias"), rel=1e-9)
    assert held.keys() == {i for i, w in want.items() if w}  # the same weights are zero
    for i, w in held.items():
        assert w == pytest.approx(want[i], rel=1e-6)
    assert 0 < len(held) < len(want)


def plain_features(text):
    """Words, pairs, triples and pairs with one word between, as sets of their words and kind."""
    w = text.split()
    kinds = [[(x,) for x in w], list(zip(w, w[1:])), list(zip(w, w[1:], w[2:])), [(a, None, b) for a, b in zip(w, w[2:])]]
    return {(k, x) for k, own in enumerate(kinds) for x in own}


def test_features_are_all_grams_and_skips(monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(60))
    whole = set(np.concatenate(list(toxicity.features(text.encode()))).tolist())
    assert len(whole) == len(plain_features(text))
    monkeypatch.setattr("gevel.llm.common.PIECE", 20)
    assert set(np.concatenate(list(toxicity.features(text.encode()))).tolist()) == whole


def shrunk(rows):
    """Evidence moved by the odds of its path, paths shrunk to sites and sites to all, row by row."""
    mean = sum(p for *_, p in rows) / len(rows)

    def groups(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[2])
        return out

    by_host, by_path = groups(lambda r: r[0]), groups(lambda r: r[:2])

    def prior(found, parent):
        n = {k: len(v) for k, v in found.items()}
        m = {k: sum(v) / len(v) for k, v in found.items()}
        total, k = sum(n.values()), len(found)
        if total <= k:
            return sites.STRONGEST
        within = sum((p - m[g]) ** 2 for g, v in found.items() for p in v)
        q = sum(n[g] * (m[g] - parent(g)) ** 2 for g in found)
        variance = within / (total - k)
        between = (q - (k - 1) * variance) / max(total - sum(x * x for x in n.values()) / total, 1e-9)
        return sites.STRONGEST if between <= 0 else min(sites.STRONGEST, max(sites.WEAKEST, variance / between))

    host_mean = {h: sum(v) / len(v) for h, v in by_host.items()}
    of_all, of_host = prior(by_host, lambda g: mean), prior(by_path, lambda g: host_mean[g[0]])
    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    out = []
    for host, path, p in rows:
        own, near = by_host[host], by_path[host, path]
        h = (sum(own) - p + of_all * mean) / (len(own) - 1 + of_all)
        x = (sum(near) - p + of_host * h) / (len(near) - 1 + of_host)
        out.append((host, path, h, x, 1 / (1 + math.exp(-(logit(p) + logit(x) - logit(mean))))))
    return out


def test_sites_by_plain_shrinkage(spark):
    docs, labels = cases.mixed(spark), cases.table(spark, "labels")
    got = sites.site_scores(docs, labels, F.col("source"), F.col("lang")).collect()
    want = shrunk([(r["host"], r["path"], r["evidence"]) for r in got])
    for r, (host, path, h, x, score) in zip(got, want):
        assert (r["host"], r["path"]) == (host, path)
        assert r["host_quality"] == pytest.approx(h, rel=1e-6)
        assert r["path_quality"] == pytest.approx(x, rel=1e-6)
        assert r["score"] == pytest.approx(score, rel=1e-6) and r["kept"] == (r["score"] >= 0.5)
    assert len({round(r["host_quality"], 3) for r in got}) > 2
