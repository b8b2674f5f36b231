from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gevel.operators import metrics, quantiles, ranking, scaling, scores, splitting
from gevel.plans import analysis, tuning


@pytest.mark.parametrize("n", [1, 2, 7, 40, 5000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    v = np.where(rng.random(n) < 0.4, 3.0, rng.lognormal(0, 2, n))
    df = spark.createDataFrame(pd.DataFrame({"x": v, "y": np.round(v)}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    # A coarse sketch must be corrected by the second pass.
    for accuracy in (20_000, 100):
        got = {(r.feature, r.prob): r.value for r in quantiles.exact_quantiles(df, ["x", "y"], probs, accuracy).collect()}
        for c in ("x", "y"):
            for p in probs:
                want = np.quantile(df.toPandas()[c], p) if n < 100 else np.quantile(v if c == "x" else np.round(v), p)
                assert got[c, p] == pytest.approx(want)


def test_rank_by_hash_matches_window(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    got = ranking.rank_by_hash(df, ["g"], 7, "id", "r").collect()
    assert len(got) == 3000
    import hashlib

    for g in range(3):
        mine = sorted((hashlib.md5(f"7|{r.id}".encode()).hexdigest(), r.r) for r in got if r.g == g)
        assert [r for _, r in mine] == list(range(1, 1001))


def test_quotas():
    q = splitting.quotas({"a": 7, "b": 8, "c": 3}, 0.2)
    assert sum(q.values()) == math.ceil(0.2 * 18)
    assert all(abs(q[c] - 0.2 * n) < 1 for c, n in {"a": 7, "b": 8, "c": 3}.items())


def test_split_is_a_partition(spark):
    df = spark.range(503).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 170, "a").otherwise("b").alias("y"))
    train, test = splitting.split(df, "y", "k")
    assert test.count() == math.ceil(503 * 0.2) and train.count() + test.count() == 503
    folds = splitting.with_fold(df, "y", "k").groupBy("y", "fold").count().collect()
    for y in "ab":
        sizes = [r["count"] for r in folds if r.y == y]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


def test_scaler_with_zero_range(spark):
    df = spark.createDataFrame([(float(i), 5.0 if i else 9.0) for i in range(9)], "x double, c double")
    t = scaling.robust_scaler(df, ["x", "c"])
    out = t.transform(df).select("scaled_x", "scaled_c").toPandas()
    assert out["scaled_x"].median() == 0
    assert set(out["scaled_c"]) == {0.0, 4.0}


def neighbour_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Plain version of the estimate."""

    def psi(n):
        return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))

    keep = np.array([np.sum(y == c) > 1 for c in y])
    x, y = x[keep], y[keep]
    own, cls, near = [], [], []
    for i in range(len(x)):
        same = np.sort(np.abs(np.delete(x, i)[np.delete(y, i) == y[i]] - x[i]))
        kk = min(k, len(same))
        own.append(psi(kk))
        cls.append(psi(np.sum(y == y[i])))
        near.append(psi(max(1, np.sum(np.abs(x - x[i]) < same[kk - 1]))))
    return max(0.0, psi(len(x)) + np.mean(own) - np.mean(cls) - np.mean(near))


def test_mutual_information(spark):
    rng = np.random.default_rng(0)
    n = 240
    y = np.array(["a", "b", "c"])[rng.integers(0, 3, n)]
    y[0] = "lonely"
    x1 = rng.normal(0, 1, n) + (y == "a") * 2
    x2 = rng.normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "y": y, "x1": x1, "x2": x2}))
    for rows in (50_000, 20, 2):
        got = {r.feature: r.score for r in scores.mutual_information(df, ["x1", "x2"], "y", "k", rows_per_slice=rows).collect()}
        assert got["x1"] == pytest.approx(neighbour_information(x1, y), abs=1e-6)
        assert got["x2"] == pytest.approx(neighbour_information(x2, y), abs=1e-6)


def test_statistics_against_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.gamma(2, 3, 300), "b": rng.normal(0, 1, 300)})
    pdf["c"] = pdf.a + pdf.b
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in pdf])
    corr = {(r.a, r.b): r["corr"] for r in analysis.correlations(df, list(pdf)).collect()}
    assert corr["a", "b"] == pytest.approx(pdf.corr().loc["a", "b"])
    assert corr["b", "c"] == pytest.approx(pdf.corr().loc["b", "c"])
    skew = {r.feature: r.skew for r in analysis.skewness(df, list(pdf)).collect()}
    assert skew["a"] == pytest.approx(pdf.a.skew()) and skew["b"] == pytest.approx(pdf.b.skew())
    d = {r.feature: r for r in analysis.describe(df, list(pdf)).collect()}
    want = pdf.describe()
    for c in pdf:
        assert d[c]["count"] == want[c]["count"] and d[c]["q75"] == pytest.approx(want[c]["75%"])
    h = analysis.histogram(df, ["a"]).orderBy("bin").collect()
    counts, _ = np.histogram(pdf.a, 10)
    assert {r.bin: r.n for r in h} == dict(enumerate(counts))
    x = [r for r in analysis.density(df, ["a"], 50).collect()]
    bw = pdf.a.std() * 300 ** -0.2
    r = x[10]
    assert r.density == pytest.approx(np.mean(np.exp(-0.5 * ((r.x - pdf.a) / bw) ** 2)) / (bw * math.sqrt(2 * math.pi)))


def test_report_guards_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, prediction string")
    r = {x["class"]: x for x in metrics.class_report(df).collect()}
    assert r["b"].precision == 0 and r["b"].recall == 0 and r["b"].support == 0
    assert r["a"].precision == pytest.approx(0.5) and r["accuracy"].f1 == pytest.approx(1 / 3)
    assert metrics.balanced_accuracy(df).first()[0] == pytest.approx(0.25)
    cm = {x.label: (x.a, x.b, x.c) for x in metrics.confusion_matrix(df, ["a", "b", "c"]).collect()}
    assert cm == {"a": (1, 1, 0), "b": (0, 0, 0), "c": (1, 0, 0)}


def test_draws_are_distinct():
    settings = tuning.draw(tuning.GRIDS["rf"], 75)
    assert len({str(s) for s in settings}) == 75
    assert max(s["max_depth"] for s in settings) <= 30
    assert len(tuning.draw({"a": [1, 2], "b": [3]}, 75)) == 2
