"""Removal of repeated word windows against plain Python."""

from __future__ import annotations

import hashlib
import random

import cases
import numpy as np
import pytest

from gevel.llm import subtrees


def plain(rows):
    """{(doc_id, text): (n_words, n_removed, sha256)} by looking at every window."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    # different texts under one id come in any order; the cases below have none that share a window
    words = [t.encode().split() for *_, t in docs]
    seen, gone = set(), [set() for _ in docs]
    for k, w in enumerate(words):
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[k].update(range(i, i + 20))
            seen.add(key)
    out = {}
    for (no_id, i, t), w, g in zip(docs, words, gone):
        left = b" ".join(x for k, x in enumerate(w) if k not in g)
        out[None if no_id else i, t] = len(w), len(g), hashlib.sha256(left).hexdigest()
    return out


def awkward():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [draw.choice(vocabulary) for _ in range(90)]
    rows = list(cases.edge_rows())
    for i in range(40):
        own = [draw.choice(vocabulary) for _ in range(draw.randrange(60))]
        cut = sorted(draw.sample(range(91), 2))
        rows.append((100 + i, " ".join(own + passage[cut[0] : cut[1]] + own[:25]), "en", "a", 1))
    near = list(passage)
    near[45] = "changed"
    rows += [(200, "\t".join(near), "en", "a", 1), (201, " ".join(passage * 3), "en", "b", 1)]
    rows += [(202, "same " * 300, "en", "b", 1), (203, " ".join(passage[:20]), "en", "b", 1)]
    rows += [(204, " ".join(passage[:19]), "en", "b", 1), (None, " ".join(passage[10:50]), "en", "b", 1)]
    return rows


@pytest.mark.parametrize("crowd", [subtrees.CROWD, 2])
def test_against_plain_python(spark, crowd):
    rows = awkward()
    want = plain(rows)
    got = subtrees.digest(subtrees.remove_repeats(cases.docs(spark, rows), crowd)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) in [want[r["doc_id"], t] for t in texts[r["doc_id"]]]
        assert r["changed"] == (r["n_removed"] > 0)


@pytest.mark.parametrize("crowd", [subtrees.CROWD, 2])
def test_given_documents(spark, crowd):
    rows = [tuple(r) for r in cases.table(spark, "documents").select("doc_id", "text").collect()]
    want = plain(rows)
    got = subtrees.digest(subtrees.remove_repeats(cases.table(spark, "documents"), crowd))
    mine = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()}
    assert mine == {(i, *v) for (i, _), v in want.items()}


def test_empty(spark):
    assert subtrees.digest(subtrees.remove_repeats(cases.empty(spark))).count() == 0


def test_long_text_in_pieces(monkeypatch):
    """A text cut into pieces has the same windows, each once, under anchors that are their own."""
    words = [f"w{i % 700}".encode() for i in range(5000)]
    text = b"  ".join(words) + b" "
    for size in (50, 1000, 1 << 19):
        monkeypatch.setattr(subtrees, "PACK", size)
        starts = []
        for row, _, _, lo, hi, anchor in subtrees.contexts([b"", None, text, b"few words"]):
            assert (row == 2).all() and ((anchor >= hi) & (anchor <= lo + subtrees.WINDOW - 1)).all()
            starts += [s for a, b in zip(lo.tolist(), hi.tolist()) for s in range(a, b + 1)]
        assert starts == list(range(5000 - 19))


def test_equal_windows_share_their_anchor():
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{head} {passage} {tail}".encode() for head, tail in (("a b", "c"), ("d " * 30, "e f"), ("", ""))]
    found = [set(), set(), set()]
    for row, c, _, lo, hi, anchor in subtrees.contexts(texts):
        heads = [2, 30, 0]
        for k, x, a, b, at in zip(row.tolist(), c.tolist(), lo.tolist(), hi.tolist(), anchor.tolist()):
            found[k] |= {(s - heads[k], at - heads[k], x) for s in range(a, b + 1) if 0 <= s - heads[k] <= 20}
    assert found[0] == found[1] == found[2] and len(found[0]) == 21


def test_leaves_drop_out():
    node = np.array([0, 0, 0, 1, 1, -1])
    word = np.array([5, 5, 6, 5, -1, 5])
    deeper = subtrees.deeper(node, word)
    assert deeper[0] == deeper[1] >= 0 and (deeper[2:] == -1).all()


def test_stretches_of_a_long_text(monkeypatch):
    monkeypatch.setattr("gevel.llm.common.PIECE", 64)
    words = [f"w{i}".encode() for i in range(300)]
    spans = [(0, 25), (3, 30), (100, 121), (110, 150), (280, 300)]
    assert list(subtrees.stretches(b" ".join(words), spans)) == [b" ".join(words[a:b]) for a, b in spans]
