from __future__ import annotations

import re
from collections import Counter

import cases
import numpy as np
from pyspark.sql import functions as F

from gevel.llm import rules, sites

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(WS):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_counts_against_brute_force(spark):
    rows = [tuple(r) for r in cases.mixed(spark).select("doc_id", "text").collect()]
    rows += [(0, "a\x0bb\x0cc\x85d\u2003e\r\n a\x0bb\x0cc\x85d\u2003e\r\n"), (0, "x y z " * 6)]
    for _, text in rows:
        assert rules.counts((text or "").encode()) == plain_counts(text)


def test_judged_awkward_rows(spark):
    docs, labels = cases.docs(spark), cases.table(spark, "labels")
    got = rules.digest(rules.judged(docs, labels))
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        c = plain_counts(t)
        want.append((d, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(want, key=str)
    assert got.where("base_failed and kept").isEmpty()


def test_empty_tables(spark):
    labels = cases.table(spark, "labels")
    assert rules.judged(cases.empty(spark), labels).count() == 0
    assert sites.site_scores(cases.empty(spark), labels, F.col("source"), F.col("lang")).count() == 0
    none = labels.limit(0)
    kept = rules.judged(cases.docs(spark), none)
    assert kept.where("kept = base_failed").isEmpty()
    assert sites.site_scores(cases.docs(spark), none, F.col("source"), F.col("lang")).where("kept").count() == 18


def held_out(spark, scored):
    """Share of good and of bad documents kept, labels used for nothing else than this."""
    docs = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.join(docs.where("doc_id % 3 = 0"), "doc_id").select("quality", "kept").collect()
    good = [k for q, k in rows if q == 1]
    bad = [k for q, k in rows if q == 0]
    return sum(good) / len(good), sum(bad) / len(bad)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id % 3 <> 0")
    good, bad = held_out(spark, rules.judged(docs, labels))
    assert good > 0.9 and bad < 0.15
    good, bad = held_out(spark, sites.site_scores(docs, labels, F.col("source"), F.col("lang")))
    assert good > 0.95 and bad < 0.1


def test_ratio_leaves_the_text_itself_out():
    at = np.array([3, 3, 5])
    trusted, raw = np.zeros(rules.BUCKETS, np.int64), np.zeros(rules.BUCKETS, np.int64)
    np.add.at(raw, at, 1)
    np.add.at(trusted, at, 1)
    assert abs(rules.ratio(at, trusted, raw, True)) < 1e-12
    assert rules.ratio(np.empty(0, np.int64), trusted, raw, False) == 0.0


def test_sparse_sites_shrink_towards_all(spark):
    good = "A plain sentence with words, one after another, that says something each time number {}. " * 3
    bad = "### %%% *** |||| &&& ### %%% {} ***"
    rows, labels = [], []
    for i in range(400):
        rows.append((i, good.format(i, i, i) if i % 4 else bad.format(i), "en", "good" if i % 4 else "bad", 1))
        labels.append((i, int(i % 4 > 0), 0))
    rows += [(1000, bad.format(1), "en", "lonely", 1), (1001, good.format(9, 9, 9), "en", "lonely", 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in sites.site_scores(cases.docs(spark, rows), labels, F.col("source"), F.col("lang")).collect()}
    assert got[1]["host_quality"] > got[1001]["host_quality"] > got[0]["host_quality"]
    assert not got[1000]["kept"] and got[1001]["kept"] and len(got) == 402


def test_repeated_rows_and_null_sites(spark):
    docs = cases.docs(spark)
    got = sites.site_scores(docs, cases.table(spark, "labels"), F.col("source"), F.col("lang"))
    assert got.count() == docs.count()
    assert got.where("host is null").count() == 1
