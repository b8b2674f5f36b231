from __future__ import annotations

import cases
import numpy as np

from gevel.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def test_held_out_rows_are_never_learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    flipped = labels.selectExpr(
        "doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic"
    )
    a, b = t.fit(docs, labels), t.fit(docs, flipped)
    assert np.array_equal(a.bucket, b.bucket) and np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = t.scores(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [p for y, p in rows if y == 1]
    clean = [p for y, p in rows if y == 0]
    assert sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.01


def test_awkward_rows(spark):
    docs, labels = cases.docs(spark), cases.table(spark, "labels")
    got = t.digest(t.scores(docs, labels))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    left = t.reject(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(1 - r["predicted"] for r in rows)


def test_empty_tables(spark):
    labels = cases.table(spark, "labels")
    assert t.scores(cases.empty(spark), labels).count() == 0
    rows = t.scores(cases.docs(spark), labels.limit(0)).collect()
    assert {round(r["score"], 2) for r in rows} == {0.27}


def test_features_in_pieces(monkeypatch):
    from gevel.llm import common

    text = b"one two three four five six seven eight " * 5
    whole = np.sort(np.concatenate(list(t.features(text))))
    monkeypatch.setattr(common, "PIECE", 20)
    parts = list(t.features(text))
    assert len(parts) > 3 and np.array_equal(np.sort(np.concatenate(parts)), whole)


def test_weights_are_sparse_and_few():
    rng = np.random.default_rng(0)
    rows = [(np.append(rng.integers(10, t.BUCKETS, 200), y), y) for y in (0, 1) * 200]
    model = t.ftrl(rows)
    assert set(model.bucket) & {1} and len(model.bucket) < 50
