"""Statistics, scores, splits, classifiers and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.operators import metrics, quantiles, scaling, scores, splitting
from gevel.plans import analysis, extraction, prediction, runs, selection, tuning
from gevel.queries import stages
from gevel.queries import standins as S
from gevel.queries.registry import query
from gevel.session import materialize, scratch_dir
from gevel.sources import tables

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FEATURES = ["no_adjacent_bldg", "no_adjacent_of_adja_bldg", "fp_area", "fp_perimeter", "no_neighbours_25m", "price"]
#: With these there are more features than the ten that selection keeps.
MORE = ["no_neighbours_50m", "no_neighbours_75m", "fp_no_vertices", "fp_no_vertices_simple", "fp_length", "fp_width"]
_READY: dict[tuple[str, str], DataFrame] = {}


def numeric(spark, d):
    return S.table(spark, d, "lineitem").select(*NUMERIC, "l_returnflag", "l_orderkey", "l_linenumber")


def classed(spark, d, features=FEATURES) -> DataFrame:
    """Buildings with a class that follows from their place in the row, made noisy.

    Written once per session and read by all queries below.
    """
    held = (spark.sparkContext.applicationId, d)
    if held not in _READY:
        t = S.buildings(spark, d).withColumn("bag_function", F.lit("Residential"))
        shapes = extraction.footprint_shapes(t)
        t = extraction.adjacency(t, [0.1], shapes=shapes)
        t = extraction.neighbours(t, [25, 50, 75], shapes=shapes)
        t = extraction.length_width(extraction.outline(t))
        n, nn = F.col("no_adjacent_bldg"), F.col("no_adjacent_of_adja_bldg")
        kinds = ["detached", "semi", "end", "terraced"]
        which = F.when(n == 0, 0).when((n == 1) & (nn == 1), 1).when(n == 1, 2).otherwise(3)
        noisy = F.when(F.col("p_partkey") % 10 == 3, (which + 1) % 4).otherwise(which)
        extra = S.boxes(spark, d).select("bag_id", "p_partkey", F.col("p_retailprice").alias("price"))
        t = t.join(extra, "bag_id").select(
            "bag_id",
            F.element_at(F.array(*[F.lit(k) for k in kinds]), noisy + 1).alias("building_type"),
            *FEATURES,
            *MORE,
        )
        _READY[held] = materialize(t, "classed")
    return _READY[held].select("bag_id", "building_type", *features)


def guessed(spark, d) -> DataFrame:
    """A rule of thumb as predictions."""
    n = F.col("no_adjacent_bldg")
    rule = F.when(n == 0, "detached").when(n == 1, "semi").otherwise("terraced")
    return classed(spark, d).select("bag_id", F.col("building_type").alias("label"), rule.alias("prediction"))


# The stand-in features under short names in SQL.
CLASSED = """(select bag_id, building_type, n as no_adjacent_bldg, nn as no_adjacent_of_adja_bldg, fp_area,
              fp_perimeter, no_neighbours_25m, price from classed)"""


def each(cols: list[str], body: str, source: str) -> str:
    """One row per column, as SQL."""
    return " union all ".join(
        f"select '{c}' as feature, {body.replace('$', c)} from {source}" for c in cols
    )


@query(
    "a9_describe",
    each(
        NUMERIC,
        """count($) as count, round(avg($), 6) as mean, round(stddev_samp($), 6) as std, min($) as min, max($) as max,
           quantile_cont($, 0.25) as q25, quantile_cont($, 0.5) as q50, quantile_cont($, 0.75) as q75""",
        "lineitem",
    ),
)
def _(spark, d):
    t = analysis.describe(numeric(spark, d), NUMERIC)
    return t.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(
    "a10_correlations",
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from lineitem"
        for i, a in enumerate(NUMERIC)
        for b in NUMERIC[i + 1 :]
    ),
)
def _(spark, d):
    return analysis.correlations(numeric(spark, d), NUMERIC).withColumn("corr", F.round("corr", 6))


@query("a11_skewness", each(NUMERIC, "round(skewness($), 6) as skew", "lineitem"))
def _(spark, d):
    return analysis.skewness(numeric(spark, d), NUMERIC).withColumn("skew", F.round("skew", 6))


@query(
    "a12_histogram",
    " union all ".join(
        f"""select '{c}' as feature, b.i as bin,
                   count(*) filter (where cast(least(floor(({c} - lo) / ((hi - lo) / 10)), 9) as bigint) = b.i) as n
            from lineitem, (select min({c}) as lo, max({c}) as hi from lineitem), range(10) b(i) group by 1, 2"""
        for c in ["l_quantity", "l_extendedprice"]
    ),
)
def _(spark, d):
    return analysis.histogram(numeric(spark, d), ["l_quantity", "l_extendedprice"]).select(
        "feature", "bin", "n"
    )


@query(
    "a13_density",
    """select 'l_quantity' as feature, cast(i as bigint) as i, round(sum(exp(-0.5 * pow((start + i * step - v) / h, 2)))
              / (any_value(rows) * any_value(h) * sqrt(2 * pi())), 6) as density
       from (select l_quantity as v from lineitem), range(200) t(i),
            (select count(*) as rows, stddev_samp(l_quantity) * pow(count(*), -0.2) as h,
                    min(l_quantity) - 0.5 * (max(l_quantity) - min(l_quantity)) as start,
                    2.0 * (max(l_quantity) - min(l_quantity)) / 199 as step from lineitem)
       group by i""",
)
def _(spark, d):
    return analysis.density(numeric(spark, d), ["l_quantity"]).select(
        "feature", F.col("i").cast("bigint").alias("i"), F.round("density", 6).alias("density")
    )


@query(
    "a14_box_summary",
    " union all ".join(
        f"""select '{c}' as feature, q25, q50, q75, min(v) filter (where ok) as whisker_low,
                   max(v) filter (where ok) as whisker_high, count(*) filter (where not ok) as outliers
            from (select {c} as v, q25, q50, q75,
                         {c} between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25) as ok
                  from {s}, (select quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50,
                                    quantile_cont({c}, 0.75) as q75 from {s})) group by 1, 2, 3, 4"""
        for c, s in [("o_totalprice", "orders")]
    ),
)
def _(spark, d):
    return analysis.box_summary(S.table(spark, d, "orders"), ["o_totalprice"])


@query(
    "a14_outliers",
    """select event_id, 'value' as feature, value from events,
              (select quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.75) as q75 from events)
       where value not between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25)""",
)
def _(spark, d):
    return analysis.outliers(S.table(spark, d, "events"), ["value"], ["event_id"])


@query(
    "a15_confusion_matrix",
    """select label, count(*) filter (where prediction = 'detached') as detached,
              count(*) filter (where prediction = 'end') as "end",
              count(*) filter (where prediction = 'semi') as semi,
              count(*) filter (where prediction = 'terraced') as terraced from guessed group by 1""",
)
def _(spark, d):
    return metrics.confusion_matrix(guessed(spark, d), ["detached", "end", "semi", "terraced"])


_REPORT = """
    with c as (select label, prediction, count(*) as n from guessed group by 1, 2),
    per as (select k as class, coalesce(sum(n) filter (where label = k), 0) as support,
                   coalesce(sum(n) filter (where prediction = k), 0) as chosen,
                   coalesce(sum(n) filter (where prediction = k and label = k), 0) as hits
            from (select distinct label as k from c union select distinct prediction from c), c group by 1),
    pr as (select *, case when chosen > 0 then hits / chosen else 0 end as p,
                  case when support > 0 then hits / support else 0 end as r from per),
    f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from pr)
    select class, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from f
    union all select 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
                     round(sum(hits) / sum(support), 6), cast(sum(support) as bigint) from f
    union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), cast(sum(support) as bigint) from f
    union all select 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                     round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from f"""


@query("a16_class_report", _REPORT)
def _(spark, d):
    t = metrics.class_report(guessed(spark, d))
    return t.select(
        "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query("a17_accuracy", "select round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as accuracy from guessed")
def _(spark, d):
    return metrics.accuracy(guessed(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


@query(
    "a18_balanced_accuracy",
    """select round(avg(r), 6) as balanced_accuracy
       from (select label, avg(case when label = prediction then 1.0 else 0.0 end) as r from guessed group by 1)""",
)
def _(spark, d):
    t = metrics.balanced_accuracy(guessed(spark, d))
    return t.select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(
    "m1_stratified_split",
    """select c.bag_id, r <= q + case when place <= total - base then 1 else 0 end as is_test
       from (select bag_id, building_type, row_number() over (partition by building_type order by md5('0|' || bag_id), bag_id) as r
             from classed) c
       join (select *, row_number() over (order by round(0.2 * n - q, 9) desc, building_type) as place,
                    sum(q) over () as base, ceil(round(0.2 * sum(n) over (), 9)) as total
             from (select building_type, count(*) as n, floor(round(0.2 * count(*), 9)) as q from classed group by 1)) k
       using (building_type)""",
)
def _(spark, d):
    t = splitting.mark_test(classed(spark, d), "building_type", "bag_id")
    return t.select("bag_id", "is_test")


@query(
    "m2_stratified_folds",
    """select bag_id, cast((row_number() over (partition by building_type order by md5('0|' || bag_id), bag_id) - 1) % 3 as bigint) as fold
       from classed""",
)
def _(spark, d):
    t = splitting.with_fold(classed(spark, d), "building_type", "bag_id")
    return t.select("bag_id", F.col("fold").cast("bigint").alias("fold"))


@query(
    "m3_robust_scaling",
    f"""select bag_id, round((fp_area - m1) / case when i1 = 0 then 1 else i1 end, 6) as fp_area,
               round((no_adjacent_bldg - m2) / case when i2 = 0 then 1 else i2 end, 6) as no_adjacent_bldg
        from {CLASSED}, (select quantile_cont(fp_area, 0.5) as m1, quantile_cont(fp_area, 0.75) - quantile_cont(fp_area, 0.25) as i1,
                                quantile_cont(n, 0.5) as m2, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) as i2 from classed)""",
)
def _(spark, d):
    cols = ["fp_area", "no_adjacent_bldg"]
    t = classed(spark, d)
    scaled = scaling.robust_scaler(t, cols).transform(t)
    return scaled.select("bag_id", *[F.round(f"scaled_{c}", 6).alias(c) for c in cols])


def _anova_sql(c: str) -> str:
    return f"""
        select '{c}' as feature, round((sum(n * pow(mean - grand, 2)) / (count(*) - 1)) / (sum(n * var) / (sum(n) - count(*))), 4) as score
        from (select building_type, count(*) as n, avg({c}) as mean, var_pop({c}) as var from {CLASSED} group by 1),
             (select avg({c}) as grand from {CLASSED})"""


@query("m4_anova_f", " union all ".join(_anova_sql(c) for c in FEATURES))
def _(spark, d):
    t = scores.anova_f(classed(spark, d), FEATURES, "building_type")
    return t.select("feature", F.round("score", 4).alias("score"))


@query("s4_best_features", f"select * from ({' union all '.join(_anova_sql(c) for c in FEATURES)}) order by score desc limit 3")
def _(spark, d):
    t = scores.best_features(scores.anova_f(classed(spark, d), FEATURES, "building_type"), 3)
    return t.select("feature", F.round("score", 4).alias("score"))


# Nearest-neighbour information over distinct values; digamma as a harmonic number, whose constant cancels.
_MUTUAL = f"""
    with mi_long as (select feature, building_type as y, cast(v as double) as v
                  from (unpivot {CLASSED} on {", ".join(FEATURES)} into name feature value v) where v is not null),
    mi_harmonic as (select i, sum(1.0 / i) over (order by i) as h from range(1, (select count(*) + 1 from classed)) t(i)),
    mi_own0 as (select feature, y, v, count(*) as n_own from mi_long group by all),
    mi_own as (select *, sum(n_own) over (partition by feature, y) as n_class from mi_own0),
    mi_kept as (select *, sum(n_own) over (partition by feature, v) as n_all, least(3, n_class - 1) as k from mi_own where n_class > 1),
    mi_gaps as (select a.feature, a.y, a.v, a.k, abs(b.v - a.v) as gap, b.v as pt,
                    sum(case when a.v = b.v then b.n_own - 1 else b.n_own end)
                        over (partition by a.feature, a.y, a.v order by abs(b.v - a.v), b.v) as upto
             from mi_kept a join mi_kept b using (feature, y) where a.n_own <= a.k),
    mi_kth as (select feature, y, v, arg_min(gap, upto) as r, arg_min(pt, upto) as pt from mi_gaps where upto >= k group by all),
    mi_vals as (select distinct feature, v, n_all from mi_kept),
    mi_near as (select k.feature, k.y, k.v, sum(x.n_all) as m
             from mi_kth k join mi_vals x on x.feature = k.feature
              and x.v > case when pt < k.v then pt else k.v - r end and x.v < case when pt > k.v then pt else k.v + r end
             group by all),
    mi_terms as (
      select kept.feature, n_own, hk.h as own, hc.h as class,
             case when n_own > kept.k then hk.h + ha.h - ho.h else hm.h end as near
      from mi_kept kept left join mi_near n using (feature, y, v)
      asof left join (select i + 1 as i, h from mi_harmonic union all select 1, 0) hk on kept.k >= hk.i
      asof left join (select i + 1 as i, h from mi_harmonic union all select 1, 0) hc on kept.n_class >= hc.i
      asof left join (select i + 1 as i, h from mi_harmonic union all select 1, 0) ha on kept.n_all >= ha.i
      asof left join (select i + 1 as i, h from mi_harmonic union all select 1, 0) ho on kept.n_own >= ho.i
      asof left join (select i + 1 as i, h from mi_harmonic union all select 1, 0) hm on greatest(n.m, 1) >= hm.i)
    select t.feature, round(greatest(any_value(hn.h) + sum(n_own * own) / sum(n_own) - sum(n_own * class) / sum(n_own)
           - sum(n_own * near) / sum(n_own), 0), 6) as score
    from mi_terms t join (select feature, sum(n_own) as n from mi_kept group by 1) s using (feature)
      join (select i + 1 as i, h from mi_harmonic union all select 1, 0) hn on hn.i = s.n
    group by 1"""


@query("m5_mutual_information", _MUTUAL)
def _(spark, d):
    t = scores.mutual_information(classed(spark, d), FEATURES, "building_type", "bag_id")
    return t.select("feature", F.round("score", 6).alias("score"))


@query(
    "m15_prediction_rows",
    """select row_number() over (order by md5('rows|' || bag_id), bag_id) - 1 as row, prediction, label as correct_class,
              prediction = label as correct_prediction from guessed""",
)
def _(spark, d):
    return prediction.prediction_rows(guessed(spark, d))


@query(
    "m16_class_weights",
    """select building_type, round(sum(n) over () / (count(*) over () * n), 6) as weight, n
       from (select building_type, count(*) as n from classed group by 1)""",
)
def _(spark, d):
    t = splitting.balanced_weight(classed(spark, d), "building_type")
    return t.groupBy("building_type", F.round("weight", 6).alias("weight")).agg(
        F.count(F.lit(1)).alias("n")
    )


def halves(spark, d, features=FEATURES):
    return splitting.split(classed(spark, d, features), "building_type", "bag_id")


# A hundred trees, grown as deep as Spark ML goes; a linear machine of a thousand rounds.
FOREST = {"n_estimators": 100, "max_depth": 30}
MACHINE = {"max_iter": 1000}


@query("m6_selection_comparison")
def _(spark, d):
    train, test = halves(spark, d, FEATURES + MORE)
    return selection.compare_selection(train, test, "anova_f", 10, MACHINE)


@query("m7_forest_importance")
def _(spark, d):
    train, _ = halves(spark, d)
    model = prediction.fit_classifier(train, "rf", FOREST)
    return selection.impurity_importance(model, FEATURES, spark)


@query("m8_linear_svm")
def _(spark, d):
    train, test = halves(spark, d)
    return prediction.predict(prediction.fit_classifier(train, "svc", MACHINE), test)


@query("m9_permutation_importance")
def _(spark, d):
    train, test = halves(spark, d)
    model = prediction.fit_classifier(train, "rf", FOREST)
    return selection.permutation_importance(model, test, FEATURES, repeats=5)


@query("s5_features_by_importance")
def _(spark, d):
    train, test = halves(spark, d)
    model = prediction.fit_classifier(train, "rf", FOREST)
    return selection.by_mean_importance(selection.permutation_importance(model, test, FEATURES))


@query("m10_accuracy_gap")
def _(spark, d):
    train, test = halves(spark, d)
    parts = []
    for algorithm, params in (("rf", FOREST), ("svc", MACHINE)):
        model = prediction.fit_classifier(train, algorithm, params)
        gap = selection.accuracy_gap(model, train, test)
        parts.append(gap.select(F.lit(algorithm).alias("algorithm"), "split", "accuracy"))
    return parts[0].unionByName(parts[1])


_TEST = """(select c.bag_id, building_type as label, r <= q + case when place <= total - base then 1 else 0 end as is_test
       from (select bag_id, building_type, row_number() over (partition by building_type order by md5('0|' || bag_id), bag_id) as r
             from classed) c
       join (select *, row_number() over (order by round(0.2 * n - q, 9) desc, building_type) as place,
                    sum(q) over () as base, ceil(round(0.2 * sum(n) over (), 9)) as total
             from (select building_type, count(*) as n, floor(round(0.2 * count(*), 9)) as q from classed group by 1)) k
       using (building_type))"""


@query(
    "m8_predicted_rows",
    f"""select algorithm, bag_id, label, true as known from {_TEST}, (values ('rf'), ('svc')) t(algorithm) where is_test""",
)
def _(spark, d):
    # Every test row once, with its own label, and a prediction among the labels there are.
    train, test = halves(spark, d)
    known = [r[0] for r in train.select("building_type").distinct().collect()]
    parts = []
    for algorithm, params in (("rf", FOREST), ("svc", MACHINE)):
        rows = prediction.predict(prediction.fit_classifier(train, algorithm, params), test)
        parts.append(
            rows.select(F.lit(algorithm).alias("algorithm"), "bag_id", "label", F.col("prediction").isin(known).alias("known"))
        )
    return parts[0].unionByName(parts[1])


@query(
    "m7_importance_checks",
    "select name, cast(i as int) as feature, true as is_share, 1.0::double as total from (values "
    + ", ".join(f"({i}, '{c}')" for i, c in enumerate(FEATURES))
    + ") t(i, name)",
)
def _(spark, d):
    # Shares of one, a row for each feature in the order of the model's vector.
    train, _ = halves(spark, d)
    model = prediction.fit_classifier(train, "rf", FOREST)
    found = selection.impurity_importance(model, FEATURES, spark)
    total = found.agg(F.round(F.sum("score"), 9).alias("total"))
    share = (F.col("score") >= 0) & (F.col("score") <= 1)
    return found.crossJoin(total).select("name", "feature", share.alias("is_share"), "total")


@query(
    "m9_permutation_checks",
    "select name, cast(5 as bigint) as repeats, true as in_range from (values "
    + ", ".join(f"('{c}')" for c in FEATURES)
    + ") t(name)",
)
def _(spark, d):
    # Five repeats of each feature; no drop is larger than the accuracy on the rows as they are.
    train, test = halves(spark, d)
    model = prediction.fit_classifier(train, "rf", FOREST)
    base = metrics.accuracy(prediction.predict(model, test))
    drops = selection.permutation_importance(model, test, FEATURES, repeats=5)
    fits = F.every((F.col("drop") <= F.col("accuracy") + 1e-9) & (F.col("drop") >= F.col("accuracy") - 1 - 1e-9))
    return drops.crossJoin(base).groupBy("name").agg(F.count(F.lit(1)).alias("repeats"), fits.alias("in_range"))


@query("m11_validation_curve")
def _(spark, d):
    train, _ = halves(spark, d)
    curve = tuning.validation_curve(train, "rf", "max_depth", [5, 10, 15, 20, 25, 30])
    return tuning.curve_means(curve)


@query("m12_random_search")
def _(spark, d):
    train, _ = halves(spark, d)
    _, _, tried = tuning.random_search(train, "rf", tuning.GRIDS["rf"], tuning.DRAWS)
    return tried


@query("m13_fit_and_evaluate")
def _(spark, d):
    train, test = halves(spark, d)
    model = prediction.fit_classifier(train, "rf", FOREST)
    return prediction.evaluate(prediction.predict(model, test))["report"]


@query("m14_transfer")
def _(spark, d):
    # Model of one half of the buildings, kept in a file, applied to the other.
    even = F.pmod(F.xxhash64("bag_id"), F.lit(2)) == 0
    train, _ = splitting.split(classed(spark, d).filter(even), "building_type", "bag_id")
    path = scratch_dir(spark, "model")
    prediction.fit_or_load(train, "svc", path, MACHINE)
    return prediction.evaluate(prediction.transfer(path, classed(spark, d).filter(~even)))["report"]


@query(
    "io8_result_csv",
    each(
        FEATURES,
        """count($) as count, round(avg($), 6) as mean, round(stddev_samp($), 6) as std, cast(min($) as double) as min,
           cast(max($) as double) as max, quantile_cont(cast($ as double), 0.25) as q25,
           quantile_cont(cast($ as double), 0.5) as q50, quantile_cont(cast($ as double), 0.75) as q75""",
        CLASSED,
    ),
)
def _(spark, d):
    path = scratch_dir(spark, "results")
    stats = analysis.describe(classed(spark, d), FEATURES)
    tables.write_csv(stats, path)
    back = spark.read.schema(stats.schema).csv(path, header=True)
    return back.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("io8_score_csv", " union all ".join(_anova_sql(c) for c in FEATURES))
def _(spark, d):
    path = scratch_dir(spark, "scores")
    found = scores.anova_f(classed(spark, d), FEATURES, "building_type")
    tables.write_csv(found, path)
    back = spark.read.schema(found.schema).csv(path, header=True)
    return back.select("feature", F.round("score", 4).alias("score"))


@query(
    "io8_prediction_csv",
    """select row_number() over (order by md5('rows|' || bag_id), bag_id) - 1 as row, prediction, label as correct_class,
              prediction = label as correct_prediction from guessed""",
)
def _(spark, d):
    path = scratch_dir(spark, "predictions")
    tables.write_csv(prediction.prediction_rows(guessed(spark, d)), path)
    return spark.read.schema(runs.PREDICTIONS).csv(path, header=True)


def areas(spark, d) -> dict[str, DataFrame]:
    """The study buildings as two areas, by the last digit of their id, written once."""
    t = materialize(stages.all_features(spark, d), "areas")
    odd = F.substring("bag_id", -1, 1).cast("int") % 2
    return {"area1": t.filter(odd == 0), "area2": t.filter(odd == 1)}


def _area_sql(area: str, other: str, digit: int) -> str:
    """Rows that each selection of an area is tried on: a fifth of its own, and all of the other area."""
    parts = []
    for name in ("anova", "mutual_info", "impurity", "permutation"):
        needs = "bag_no_dwellings is not null" if "bag_no_dwellings" in prediction.PRESETS[(area, name)] else "true"
        own, far = (f"count(*) filter (where odd = {x} and {needs})" for x in (digit, 1 - digit))
        parts += [
            f"select '{name}' as selection, 'test' as target, cast(ceil(round(0.2 * {own}, 9)) as bigint) as rows from area_rows",
            f"select '{name}', '{other}', {far} from area_rows",
        ]
    union = " union all ".join(parts)
    return f"""with area_rows as (select building_type, bag_no_dwellings, cast(right(bag_id, 1) as int) % 2 as odd
            from ({stages.FEATURES_SQL}) where building_type is not null)
        select *, true as confusion_agrees, true as support_agrees, true as in_range from ({union})"""


def _area(spark, d, area):
    # All four selections, on the area's own test rows and on the other area; results as their files say.
    done = runs.run_area(area, areas(spark, d), scratch_dir(spark, "runs"), params=FOREST)
    t = runs.summary(spark, done)
    inside = [F.col(c).between(0, 1) for c in ("accuracy", "balanced_accuracy")]
    return t.select("selection", "target", "rows", "confusion_agrees", "support_agrees", (inside[0] & inside[1]).alias("in_range"))


@query("m14_area1_runs", _area_sql("area1", "area2", 0))
def _(spark, d):
    return _area(spark, d, "area1")


@query("m14_area2_runs", _area_sql("area2", "area1", 1))
def _(spark, d):
    return _area(spark, d, "area2")


@query("io9_model_file")
def _(spark, d):
    train, test = halves(spark, d)
    path = scratch_dir(spark, "model")
    prediction.fit_or_load(train, "rf", path, FOREST)
    again = prediction.fit_or_load(train, "rf", path, FOREST)
    return prediction.predict(again, test)


@query(
    "quantiles_exact",
    each(
        ["l_extendedprice"],
        "p as prob, quantile_cont($, p) as value",
        "lineitem, (values (0.0), (0.1), (0.5), (0.99), (1.0)) t(p) group by p",
    ).replace("quantile_cont(l_extendedprice, p)", "case p when 0.0 then quantile_cont(l_extendedprice, 0.0) when 0.1 then quantile_cont(l_extendedprice, 0.1) when 0.5 then quantile_cont(l_extendedprice, 0.5) when 0.99 then quantile_cont(l_extendedprice, 0.99) else quantile_cont(l_extendedprice, 1.0) end").replace("p as prob", "cast(p as double) as prob"),
)
def _(spark, d):
    return quantiles.exact_quantiles(
        numeric(spark, d), ["l_extendedprice"], [0.0, 0.1, 0.5, 0.99, 1.0]
    )
