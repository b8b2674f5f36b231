from __future__ import annotations

import random

import cases

from gevel.llm import similar, simhash


def plain(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def pairs():
    """Texts and a copy of each with some words changed, at 0.8 or more; then pairs below."""
    rng, out = random.Random(3), []
    for words, changed in ((60, 1), (120, 1), (300, 3), (1000, 10), (1000, 20), (60, 6), (300, 40)):
        for _ in range(12):
            a = [f"w{rng.randrange(10**6)}" for _ in range(words)]
            b = list(a)
            for i in rng.sample(range(words), changed):
                b[i] = f"x{rng.randrange(10**6)}"
            out.append((" ".join(a), " ".join(b)))
    return out


def test_similar_texts_go(spark):
    """A copy goes if and only if it shares four fifths of the shingles (or four bits)."""
    rows, want = [], []
    for i, (a, b) in enumerate(pairs()):
        rows += [(2 * i, a, "en", "a", 0), (2 * i + 1, b, "en", "a", 0)]
        x, y = plain(a), plain(b)
        bits = (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()
        want += [2 * i] + ([] if len(x & y) / len(x | y) >= 0.8 or bits <= 4 else [2 * i + 1])
    got = sorted(r["doc_id"] for r in simhash.keep_one(cases.docs(spark, rows), by_shingles=True).select("doc_id").collect())
    assert got == want


def test_chains_within_a_key_are_found(spark, monkeypatch):
    """A text that is like another one but not like its key's first is joined all the same."""
    rng = random.Random(4)
    w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join([f"c{i}" for i in range(9 * k)] + w[9 * k :]) for k in range(8)]
    monkeypatch.setattr(similar, "BLOCK", 2)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    assert [r["doc_id"] for r in simhash.keep_one(cases.docs(spark, rows), by_shingles=True).collect()] == [0]


def test_keys_of_long_texts(monkeypatch):
    from gevel.llm import common

    text = cases.edge_rows()[16][1].encode()
    whole = similar.shingles(text)
    monkeypatch.setattr(common, "PIECE", 1000)
    assert (similar.shingles(text) == whole).all() and len(whole) == len(plain(text.decode()))
    assert similar.band_keys(similar.shingles(b"")) == []
