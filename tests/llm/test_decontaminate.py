from __future__ import annotations

import hashlib
import re

import cases
from hypothesis import given, settings
from hypothesis import strategies as st

from gevel.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items):
    out = []
    for doc_id, text in docs:
        ws, hit, names = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            n = min(10, len(iw))
            for i in range(len(iw) - n + 1 if n else 0):
                for at in range(len(ws) - n + 1):
                    if ws[at : at + n] == iw[i : i + n]:
                        hit.update(range(at, at + n))
                        names.add(item)
        listed = ",".join(sorted(str(x) for x in names if x is not None))
        n_items = len({x for x in names if x is not None})
        out.append((doc_id, len(ws), len(hit), n_items, hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, " ".join(f"shared{i}" for i in range(20, 45))),
    (2, "QUICK brown fox!"),
    (2, "quick, brown fox"),
    (3, None),
    (4, " . "),
    (5, "third"),
    (None, "lazy dog"),
    (10, "é€😀 é€😀 é€😀 é€😀 é€😀 é€😀 é€😀 é€😀 é€😀 é€😀 é€😀"),
    (11, "ab ab ab ab ab ab ab ab ab ab ab"),
]


def test_awkward_rows(spark):
    docs, bench = cases.docs(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in d.digest(d.find_passages(docs, bench)).collect()]
    assert sorted(got, key=str) == plain(rows, ITEMS)


def test_several_passes_agree(spark, monkeypatch):
    docs, bench = cases.docs(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = cases.rows_of(d.digest(d.find_passages(docs, bench)), "*")
    monkeypatch.setattr(d, "PASS_BYTES", 60)
    assert cases.rows_of(d.digest(d.find_passages(docs, bench)), "*") == want


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not d.find_passages(cases.docs(spark), bench).where("size(hits) > 0").count()
    assert d.find_passages(cases.empty(spark), bench).count() == 0


def test_contaminated_documents_go(spark):
    docs, bench = cases.docs(spark), spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    left = d.clean_only(docs, bench)
    assert left.columns == docs.columns
    gone = {r[0] for r in plain([tuple(r) for r in docs.select("doc_id", "text").collect()], ITEMS[:1]) if r[5]}
    assert gone == {7, 8, None}
    ids = [r[0] for r in left.select("doc_id").collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 3, 4, 5, 5, 6, 9, 10, 11, 12, 13, 14, 15]
    assert ids.count(None) == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abcd"), max_size=14), max_size=4))
def test_search_against_brute_force(text, items):
    tables = d.Tables([(str(i), " ".join(x).encode()) for i, x in enumerate(items)])
    n, spans, found = tables.find(" ".join(text).encode())
    want = plain([(0, " ".join(text))], [(i, " ".join(x)) for i, x in enumerate(items)])[0]
    assert (n, sum(b - a for a, b in spans), len(found)) == want[1:4]


def test_text_in_pieces(monkeypatch):
    from gevel.llm import common

    text = (cases.PASSAGE + " and more ").encode() * 3
    tables = d.Tables([("1", cases.PASSAGE.encode())])
    want = tables.find(text)
    monkeypatch.setattr(common, "PIECE", 37)
    assert tables.find(text) == want and len(want[1]) == 3
