from __future__ import annotations

import hashlib

import cases
import pytest
import test_decontaminate
import test_near_copies
import test_similar
import xxhash

import __spark_entry__ as entry
import corpus_pipeline as p
from gevel.llm import lines, toxicity
from gevel.llm.common import text_hash


@pytest.fixture
def folder(spark, tmp_path):
    docs = cases.mixed(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        cases.table(spark, name).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plain(spark, folder):
    """The five stages in plain Python; only the trained weights come from the operator."""
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    table = model.dense()
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r in rows if toxicity.score((r[1] or "").encode(), table, model.bias) < 0.5]

    def hashed(text):
        return int.from_bytes(xxhash.xxh64(text or "", seed=42).digest(), "big", signed=True)

    hashes = {r[0]: r[1] for r in docs.select("text", text_hash()).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    seen, cut = {}, {}
    for k, (d, t, _) in enumerate(order):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for start, end in lines.passages(b):
            data = b[start:end].removesuffix(b"\n")
            if data in seen:
                first, until = seen[data]
                start = max(start, until) if first == k else start
                gone[start:end] = b"\1" * max(0, end - start)
            else:
                seen[data] = k, end
        cut[d, t] = bytes(x for x, g in zip(b, gone) if not g).decode() if t is not None else None
    rows = sorted({(d, cut[d, t], s) for d, t, s in rows}, key=lambda r: (r[0] is None, r[0] or 0))

    # near copies: four bits, or four fifths of the five-word shingles; every pair is looked at
    texts = sorted({t or "" for _, t, _ in rows})
    prints = [test_near_copies.plain_print(t) for t in texts]
    shared = [test_similar.plain(t) if t.split() else set() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(texts)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 4
            if near or 5 * len(shared[i] & shared[j]) >= 4 * max(1, len(shared[i] | shared[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    at = {t: i for i, t in enumerate(texts)}
    best = {}
    for d, t, s in rows:
        key = (d is None, d or 0, hashed(t))
        group = find(at[t or ""])
        if group not in best or key < best[group][0]:
            best[group] = key, (d, t, s)
    rows = [row for _, row in best.values()]

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {(r[0]) for r in test_decontaminate.plain([(i, r[1]) for i, r in enumerate(rows)], items) if r[5]}
    rows = [r for i, r in enumerate(rows) if i not in dirty]

    import re

    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    ranked = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(ranked)}
    stopped = set()
    while True:
        rest = [s for s in ranked if s not in stopped]
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in stopped)) / sum(weight[s] for s in rest)
        more = {s for s in rest if weight[s] * level > 2 * size[s]}
        if not more:
            break
        stopped |= more
    out = {}
    for d, t, s in rows:
        target = 2 * size[s] if s in stopped else weight[s] * level
        rate = target / size[s] if size[s] else 0
        key = "|".join(["mix-1", "" if d is None else str(d), hashlib.md5((t or "").encode()).hexdigest()])
        draw = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        n = int(rate) + (draw < rate - int(rate))
        if n:
            out[d, t, s] = out.get((d, t, s), 0) + n
    return out


def test_against_plain_python(spark, folder):
    got = {}
    for r in p.run(spark, folder).select("doc_id", "text", "source").collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == plain(spark, folder)


def test_stages_keep_the_columns(spark, tmp_path):
    for docs in (cases.docs(spark), cases.empty(spark)):
        for name, stage in p.STAGES:
            out = stage(spark, docs, cases.SF)
            if name == "mixing":
                assert out.columns == [*docs.columns, "copy_no"]
            else:
                assert out.columns == docs.columns, name
                assert out.dtypes == docs.dtypes, name
            assert out.count() <= 2 * docs.count()


def test_registered():
    names = entry.queries()
    assert names["pipeline"] is p.run
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
