from __future__ import annotations

import random

import cases

from gevel.llm import lines as n


def words(rng, k):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))


def planted(size, seed):
    """Two texts with one shared passage, at different places of each."""
    rng = random.Random(seed)
    passage = [words(rng, 60 if size == 1 else 8) for _ in range(size)]
    own = [[words(rng, 8) for _ in range(12)] for _ in range(2)]
    a, b = rng.randrange(13), rng.randrange(13)
    first = own[0][:a] + passage + own[0][a:]
    second = own[1][:b] + passage + own[1][b:]
    return "\n".join(first), "\n".join(second), own[1]


def test_planted_passages_go_whole(spark):
    """Whatever the length, every line of the later copy goes and no other."""
    rows, want = [], {}
    for size in range(1, 9):
        for seed in range(25):
            first, second, own = planted(size, 100 * size + seed)
            at = 2 * len(want) + 1
            rows += [(at, first, "en", "a", 0), (at + 1, second, "en", "a", 0)]
            want[at], want[at + 1] = first.split("\n"), own
    got = {r["doc_id"]: r["text"] for r in n.drop_passages(cases.docs(spark, rows)).collect()}
    for at, text in got.items():
        assert text.removesuffix("\n").split("\n") == want[at], at


def left(spark, *texts):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    return [r["text"] for r in n.drop_passages(cases.docs(spark, rows)).orderBy("doc_id").collect()]


def test_what_is_no_passage_stays(spark):
    """Single short lines stay."""
    texts = "own one\nTitle\nown two", "own three\nTitle\nown four\n", "Title"
    assert left(spark, *texts) == list(texts)


def test_a_run_within_a_text_keeps_its_first_place(spark):
    assert left(spark, "a b\n" * 5 + "end") == ["a b\na b\nend"]
    assert left(spark, "one\ntwo\nx\none\ntwo\n") == ["one\ntwo\nx\n"]


def test_against_plain_pairs(spark):
    """All given rows, by a dict of the bytes of passages."""
    from gevel.llm.common import text_hash

    df = cases.mixed(spark).select("doc_id", "text", text_hash().alias("h")).distinct()
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    seen, want = {}, {}
    for k, (d, t, _) in enumerate(rows):
        text = (t or "").encode()
        gone = bytearray(len(text))
        for a, b in n.passages(text):
            data = text[a:b].removesuffix(b"\n")
            if data in seen:
                there, end = seen[data]
                a = max(a, end) if there == k else a
                gone[a:b] = b"\1" * max(0, b - a)
            else:
                seen[data] = k, b
        want[d, t] = bytes(x for x, g in zip(text, gone) if not g).decode() if t is not None else None
    ids = cases.mixed(spark)
    got = n.drop_passages(ids.withColumn("was", ids["text"])).select("doc_id", "was", "text").distinct().collect()
    assert {(r[0], r[1]): r[2] for r in got} == want
