"""Rules that are easy to get wrong."""

from __future__ import annotations

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gevel.functions import labels, scalars
from gevel.operators import lookup
from gevel.plans import cleaning, extraction, groundtruth


def test_drop_trailing_and_suffix(spark):
    df = spark.createDataFrame([("abc-0",), ("abc-12",), ("x",)], "s string")
    rows = df.select(scalars.drop_trailing(F.col("s"), 2), scalars.part_suffix(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("abc", "abc"), ("abc-", "abc"), ("", "x")]


def test_any_differs_is_not_none_equal(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["b"],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(scalars.any_differs(F.col("v"), "a")).collect()] == [False, True, True, None]


def test_guarded_zero(spark):
    df = spark.createDataFrame([(None, "g"), (None, None), (3, None)], "n int, g string")
    rows = df.select(scalars.zero_if_present(F.col("n"), F.col("g"))).collect()
    assert [r[0] for r in rows] == [0, None, 3]


@pytest.mark.parametrize(
    "uses, expected",
    [
        (["woonfunctie"], "Residential"),
        (["winkelfunctie", "woonfunctie"], "Mixed-residential"),
        (["winkelfunctie"], "Non-residential (single-function)"),
        (["kantoorfunctie", "winkelfunctie"], "Non-residential (multi-function)"),
        (["overige gebruiksfunctie"], "Others"),
        (["overige gebruiksfunctie", "winkelfunctie"], "Non-residential (multi-function)"),
        (None, "Unknown"),
    ],
)
def test_function_class(spark, uses, expected):
    df = spark.createDataFrame([(uses,)], "u array<string>")
    assert df.select(labels.function_class(F.col("u"))).first()[0] == expected


def test_residential_keeps_missing_function(spark):
    df = spark.createDataFrame([("a", None), ("b", "Others"), ("c", "Residential")], "bag_id string, bag_function string")
    assert {r.bag_id for r in extraction.residential_only(df).collect()} == {"a", "c"}


def test_assign_from(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    source = spark.createDataFrame([("a", 10), ("a", 11), ("b", None)], "k string, v int")
    out = lookup.assign_from(target, source, "k", order=[F.col("v")])
    assert {r.k: r.v for r in out.collect()} == {"a": 11, "b": None, "c": 3}


def test_current_registry_version_wins(spark):
    table = spark.createDataFrame([("a",), ("b",)], "bag_id string")
    pand = spark.createDataFrame(
        [("a", 1900, "2001-01-01"), ("a", 1950, None), ("a", 1990, "2005-01-01"), ("b", 1005, None)],
        "identificatie string, oorspronkelijkbouwjaar int, e string",
    ).withColumn("eindgeldigheid", F.col("e").cast("timestamp"))
    out = extraction.construction_year(table, pand)
    assert {r.bag_id: r.bag_construction_year for r in out.collect()} == {"a": 1950, "b": None}


def test_nan_is_not_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert lookup.drop_incomplete(df, ["x"]).count() == 2


def test_drop_required_fails_on_unknown(spark):
    with pytest.raises(KeyError):
        lookup.drop_required(spark.createDataFrame([(1,)], "a int"), ["b"])


def test_unique_key(spark):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    with pytest.raises(ValueError):
        lookup.require_unique(df, "k")


def counted(spark, lists):
    long = [(f"b{i}", v) for i, vs in enumerate(lists) for v in vs]
    df = spark.createDataFrame(long, "bag_id string, label string")
    return lookup.collect_counted(df, "bag_id", "label", "building_type")


def test_collect_keeps_nulls_and_repeats(spark):
    out = counted(spark, [["x", None, "x"], [None]])
    rows = out.select("bag_id", lookup.expand_counted(F.col("building_type")).alias("v")).collect()
    assert {r.bag_id: r.v for r in rows} == {"b0": [None, "x", "x"], "b1": [None]}


VOTES = [
    (dict(a=3, m=1), "Flatwoning (overig)"),
    (dict(a=2, m=2), "Maisonette"),
    (dict(g=2, f=2), "Galerijwoning"),
    (dict(p=2, a=1), "Portiekwoning"),
    (dict(m=1, g=1), None),
    (dict(f=2, a=2), "Flatwoning (overig)"),
    (dict(), None),
]


def test_majority_label(spark):
    names = {
        "a": labels.APARTMENT, "m": labels.MAISONETTE, "g": labels.GALLERY, "p": labels.PORCH, "f": labels.FLAT,
    }
    lists = [[names[k] for k, n in v.items() for _ in range(n)] + ["other", None] for v, _ in VOTES]
    table = counted(spark, lists).withColumn("building_type2", F.lit(None).cast("string"))
    got = {r.bag_id: r.building_type2 for r in cleaning.vote(table).collect()}
    assert [got[f"b{i}"] for i in range(len(VOTES))] == [w for _, w in VOTES]
    orders = [list(p) for p in permutations([names["a"], names["m"], names["m"]])]
    table = counted(spark, orders).withColumn("building_type2", F.lit(None).cast("string"))
    assert {r.building_type2 for r in cleaning.vote(table).collect()} == {"Maisonette"}


def test_cleaning_in_order(spark):
    shared = "Twee-onder-een-kap / rijwoning hoek"
    cases = [
        ([shared], 1, 1, 1, "Twee-onder-een-kapwoning"),
        ([shared], 1, 2, 1, "Hoekwoning"),
        ([shared], 3, 2, 1, "Tussenwoning"),
        ([shared], 0, 0, 1, "Vrijstaande Woning"),
        ([shared], 0, 0, 2, None),
        (["Vrijstaande woning"], 2, 2, 1, "Vrijstaande Woning"),
        ([None], 0, 0, 1, "Vrijstaande Woning"),
        ([None], 1, 1, 1, None),
        ([labels.MAISONETTE, labels.MAISONETTE], 2, 2, 9, "Maisonnettewoning"),
    ]
    held = counted(spark, [c[0] for c in cases])
    extra = spark.createDataFrame(
        [(f"b{i}", c[1], c[2], c[3]) for i, c in enumerate(cases)],
        "bag_id string, no_adjacent_bldg int, no_adjacent_of_adja_bldg int, bag_no_dwellings int",
    )
    table = held.join(extra, "bag_id").withColumn("building_type2", F.lit(None).cast("string"))
    decisions = spark.createDataFrame([("b7", "Flatwoning (overig)")], "bag_id string, label string")
    got = {r.bag_id: r.building_type for r in cleaning.clean_labels(table, decisions).collect()}
    want = [c[4] for c in cases]
    want[7] = "Flatwoning"
    assert [got[f"b{i}"] for i in range(len(cases))] == want


def test_excluded_building(spark):
    df = spark.createDataFrame(
        [(groundtruth.EXCLUDED[0], 26, "n"), ("a", 26, None), ("b", 25, "n"), ("c", 26, "n")],
        "gmlid string, objectclass_id int, name string",
    )
    assert [r.bag_id for r in groundtruth.study_buildings(df).collect()] == ["c"]
