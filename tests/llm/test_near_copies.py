from __future__ import annotations

import re

import cases
import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gevel.llm import simhash
from gevel.llm.components import components


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items):
    """Smallest id reachable over pairs within four bits, by comparing all."""
    prints = sorted({p for _, p in items})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for d, p in items:
        if d is not None:
            first[find(p)] = min(first.get(find(p), d), d)
    return sorted(((d, f"{p:016x}", first.get(find(p))) for d, p in items), key=lambda r: str(r))


def check(df, spark):
    rows = df.select("doc_id", "text").collect()
    want = groups([(d, plain_print(t)) for d, t in rows])
    got = [tuple(r) for r in simhash.digest(simhash.near_copies(df)).collect()]
    assert sorted(got, key=lambda r: str(r)) == want


def test_against_all_pairs(spark):
    check(cases.mixed(spark), spark)


def test_awkward_rows_and_clashing_columns(spark):
    check(cases.docs(spark), spark)


def test_empty(spark):
    assert simhash.near_copies(cases.empty(spark)).count() == 0
    assert simhash.keep_one(cases.empty(spark)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    from gevel.llm import common

    text = cases.edge_rows()[16][1]
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(common, "PIECE", 1000)
    assert simhash.fingerprint(text.encode()) == whole == plain_print(text)


def test_one_of_each_group_stays(spark):
    df = cases.docs(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    left = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    ids = [d for d, _ in left]
    assert ids.count(5) == 1 and 2 not in ids and 3 not in ids and 1 in ids
    names = {r[2] for r in groups([(d, plain_print(t)) for d, t in df.select("doc_id", "text").collect()])}
    assert {d for d in ids if d is not None} == names - {None}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4, unique=True))
def test_pigeonring_loses_no_pair(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    found = False
    for i, (start, width) in enumerate(zip(simhash.STARTS, simhash.WIDTHS)):
        j = (i + 1) % 5
        low = simhash.WIDTHS[j] // 2
        same = (a ^ b) >> start & ((1 << width) - 1) == 0
        halves = [(simhash.STARTS[j], low), (simhash.STARTS[j] + low, simhash.WIDTHS[j] - low)]
        near = any((a ^ b) >> s & ((1 << w) - 1) == 0 for s, w in halves)
        if same and near:
            found |= len(simhash.linked(np.array([a ^ b], np.uint64), np.array([i]))) == 1
    assert found


def test_stars_join_what_links_join():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 30, np.uint64)
    prints = np.unique(np.concatenate([base ^ np.uint64(1 << b) for b in range(20, 29)]))
    a, b = simhash.stars(np.zeros(len(prints), int), prints, np.zeros(len(prints), int))
    assert len(a) == len(prints) - 30 and len(set(b.tolist())) == len(b)
    assert all((int(x) ^ int(y)).bit_count() <= 2 for x, y in zip(a, b))


def test_crowded_key_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    prints = [(1 << b) ^ (1 << c) for b in range(26, 34) for c in range(b)]
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = components(simhash.links(nodes))
    assert {r["root"] for r in roots.collect()} == {min(prints)} and roots.count() == len(prints) - 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert {got.get(i, i) for i in range(41)} == {0}
    assert got[101] == got[200] == 100 and 7 in got
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0
