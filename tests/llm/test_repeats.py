from __future__ import annotations

import hashlib
from collections import Counter

import cases
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gevel.llm import suffixes as s


def plain(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(hashlib.md5(b[i : i + 400]).digest() for _, b in texts for i in range(len(b) - 399))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[hashlib.md5(b[i : i + 400]).digest()] > 1:
                gone[i : i + 400] = b"\1" * 400
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        digest = hashlib.sha256(kept).hexdigest()
        out.append((d, len(b), sum(gone), runs, digest, runs > 0, kept.decode(errors="replace")))
    return sorted(out, key=str)


def check(df):
    got = [tuple(r) for r in s.digest(s.remove_repeats(df)).collect()]
    assert sorted(got, key=str) == plain([tuple(r) for r in df.select("doc_id", "text").collect()])
    return got


def near(seed, n, length=1500):
    """Copies of a text with a letter changed here and there, in different surroundings."""
    rng = np.random.default_rng(seed)
    base = bytes(rng.integers(97, 123, length, np.uint8)).decode()
    rows = []
    for i in range(n):
        x = list(base)
        for at in rng.integers(0, length, rng.integers(0, 4)):
            x[at] = "#"
        front, back = (bytes(rng.integers(97, 123, k, np.uint8)).decode() for k in rng.integers(0, 300, 2))
        rows.append((i, front + "".join(x) + back, "en", "a", 1))
    return rows


def test_awkward_rows(spark):
    got = check(cases.docs(spark))
    assert {r[2] for r in got if r[0] == 5} == {0}


def test_given_documents(spark):
    check(cases.mixed(spark))


def test_near_copies_many_contexts(spark):
    rows = near(1, 60)
    rows += [(100 + i, *rows[i][1:]) for i in range(3)] + [(5, *rows[5][1:])] * 2
    check(cases.docs(spark, rows))


def test_crowded_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(s, "CROWD", 3)
    check(cases.docs(spark, near(2, 40) + [(900, *near(2, 1)[0][1:])]))


def test_empty(spark):
    assert s.remove_repeats(cases.empty(spark)).count() == 0


def test_planted_passages_go_by_bytes_not_words(spark):
    """Of passages of 51 to 90 words both copies go whole from 400 bytes on, and nothing else goes."""
    rng = np.random.default_rng(6)

    def words(k):
        return " ".join(bytes(rng.integers(97, 123, rng.integers(2, 10), np.uint8)).decode() for _ in range(k))

    rows, want, sizes = [], {}, []
    for n in range(51, 91):
        passage = f" {words(n)} "
        sizes.append(len(passage))
        for side in "AB":
            front, back = words(30) + side, side + words(30)
            want[len(rows)] = front + ("" if len(passage) >= 400 else passage) + back
            rows.append((len(rows), front + passage + back, "en", "a", 1))
        want[len(rows)] = words(150)
        rows.append((len(rows), want[len(rows)], "en", "a", 1))
    assert min(sizes) < 400 <= max(sizes)
    got = {r["doc_id"]: r["kept_text"] for r in s.digest(s.remove_repeats(cases.docs(spark, rows))).collect()}
    assert got == want


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 60), np.uint8)) for _ in range(3000)]
    assert [texts[i] for i in s.multikey_quicksort(texts)] == sorted(texts)
    assert s.multikey_quicksort([]) == []


def test_pairs_and_starts_agree(monkeypatch):
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 123, 700, np.uint8))
    cuts, datas = [], []
    for _ in range(20):
        x = bytearray(base)
        for at in rng.integers(0, 700, 2):
            x[at] = 35
        lo, hi = sorted(rng.integers(0, 290, 2).tolist())
        datas.append(bytes(x[lo : hi + 400]))
        cuts.append(295 - lo)
    want = [s._merged(x) for x in s.repeats(cuts, datas)]
    monkeypatch.setattr(s, "FEW", 1)
    assert [s._merged(x) for x in s.repeats(cuts, datas)] == want and any(want)


def test_anchors_cover_every_start_once(monkeypatch):
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 100, 5000, np.uint8))
    for step in (1 << 22, 777):
        monkeypatch.setattr(s, "STEP", step)
        runs = list(s.anchors(text))
        assert [x for lo, hi, _ in runs for x in range(lo, hi + 1)] == list(range(len(text) - 399))
        assert all(0 <= a - hi and a - lo < s.WINDOW for lo, hi, a in runs)
    assert list(s.anchors(b"x" * 399)) == []


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=12), st.binary(max_size=12))
def test_common_ends(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    assert s.common_prefix(a, b) == n
    assert s.common_suffix(a[::-1], b[::-1]) == n
