from __future__ import annotations

import hashlib
import re

import cases
from hypothesis import given, settings
from hypothesis import strategies as st

from gevel.llm import pii


def plain(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@+-_ ()%4\n", max_size=40))
def test_base_against_the_patterns(text):
    assert sorted((a, k, b) for a, b, k in pii.base_spans(text)) == plain(text)


def test_luhn():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(spark, df):
    got = sorted((tuple(r) for r in pii.digest(pii.find(df)).collect()), key=str)
    want = []
    for d, t in df.select("doc_id", "text").collect():
        s = plain(t)
        n = [sum(k == i for _, k, _ in s) for i in range(4)]
        want.append((d, *n, hashlib.sha256(joined(s).encode()).hexdigest(), joined(s)))
    want.sort(key=str)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    for g, w in zip(got, want):
        assert set(w[6].split(",")) <= set(g[6].split(",")) | {""}
    return got


def test_awkward_rows(spark):
    got = check(spark, cases.docs(spark))
    assert [r[1:5] for r in got if r[0] == 15] == [(1, 1, 1, 1)]


def test_given_documents(spark):
    check(spark, cases.mixed(spark))


def test_empty(spark):
    assert pii.find(cases.empty(spark)).count() == 0


def model():
    rows = []
    for i in range(80):
        n = f"{100 + i} {i % 10}"
        for text in (f"call +1 ({100 + i}) 555-{1000 + 7 * i} now", f"mail user.{i}@mail{i % 9}.example.com today",
                     f"from 10.{i}.0.{i + 1} only", f"order {10**15 + 7919 * i} came", f"year {1900 + i} and {n} more of it 12345678"):
            rows.append((text, [(a, b, k) for a, b, k in pii.base_spans(text)]))
    return pii.fit(rows)


def test_field_learns_the_patterns_and_goes_on_from_them():
    weight = model()
    text = "call (212) 555-1234 or +1 (212) 555-1234 x"
    found = {(text[a:b], pii.KINDS[k]) for a, b, k in pii.decode(text, weight)}
    assert ("+1 (212) 555-1234", "phone") in found
    assert not pii.decode("the year 1984 and 12345678 more", weight)
    assert not pii.decode("", weight) and not pii.decode("no numbers here", weight)


def test_added_spans_leave_the_base_alone():
    assert pii.free([(0, 5, 1), (4, 9, 1), (9, 12, 3)], [(3, 4, 0)]) == [(4, 9, 1), (9, 12, 3)]
    assert pii.free([(0, 5, 1)], []) == [(0, 5, 1)]


def test_long_digit_runs_end():
    for text in ("1" * 50000, "1." * 30000, "+1" + " " * 50000, "a" * 50000 + "@", "a@" * 30000, "0" * 6000 + ".1.1.1"):
        pii.base_spans(text)
