from __future__ import annotations

import cases
import twins

from gevel.llm import mixing as m


def sql_rows(con, df):
    con.register("documents", df.select("doc_id", "text", "source").toArrow())


def test_awkward_rows_against_sql(spark):
    import duckdb

    for df in (cases.docs(spark), cases.mixed(spark)):
        con = duckdb.connect()
        sql_rows(con, df)
        assert twins.difference(m.digest(m.rates(df)), con, m.SQL) is None


def test_targets_stop_at_twice_the_source(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 900), ("c", 50), ("d", 0), (None, 10)], "source string, size long")
    got = {r["source"]: r["target"] for r in m.targets(sizes).collect()}
    assert got["a"] == 200 and got["c"] == 100 and got["d"] == 0 and got[None] == 20
    assert abs(sum(got.values()) - 1.5 * 1060) < 1e-6


def test_mix_repeats_documents_as_the_rates_say(spark):
    df = cases.docs(spark)
    mix = m.mix(df)
    assert mix.columns == [*df.columns, "copy_no"]
    n = {(r[0], r[1]): r[2] for r in m.rates(df).groupBy("doc_id", "source").sum("copies").collect()}
    got = {(r[0], r[1]): r[2] for r in mix.groupBy("doc_id", "source").count().collect()}
    assert got == {k: v for k, v in n.items() if v}
    assert m.mix(mix).columns == [*df.columns, "copy_no"]


def test_sources_come_near_their_targets(spark):
    rows = [(i, f"{i} " + "word " * (i % 40), "en", f"s{i % 3}", 1) for i in range(3000)]
    found = m.rates(cases.docs(spark, rows)).selectExpr("source", "target", "copies * size as taken", "copies")
    for r in found.groupBy("source").agg({"taken": "sum", "target": "max", "copies": "max"}).collect():
        assert abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.06 and r["max(copies)"] <= 2


def test_empty(spark):
    assert m.rates(cases.empty(spark)).count() == 0
    assert m.mix(cases.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = m.mix(cases.docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
