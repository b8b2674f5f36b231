"""Fit, predict, evaluate, keep and carry over classifiers."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.operators import metrics
from gevel.operators.ranking import rank_by_hash
from gevel.operators.scaling import robust_scaler, scaled_names
from gevel.operators.splitting import balanced_weight, by_class, class_counts
from gevel.sources.tables import exists

KEY, LABEL = "bag_id", "building_type"

# Columns dropped for their correlation, and the features each selection keeps.
CORRELATED = [
    "actual_volume_lod1", "convex_hull_volume_lod1", "convex_hull_volume_lod2", "wall_area_lod1",
    "roof_area_lod1", "height_max_lod1",
]
PRESETS = {
    ("area1", "anova"): ["no_adjacent_bldg", "no_adjacent_of_adja_bldg", "no_neighbours_50m", "bag_no_dwellings", "obb_width_lod1", "actual_volume_lod2", "wall_area_lod2"],
    ("area1", "mutual_info"): ["no_adjacent_bldg", "no_adjacent_of_adja_bldg", "no_neighbours_50m", "bag_construction_year", "fp_area", "obb_width_lod1", "actual_volume_lod2"],
    ("area1", "impurity"): ["no_adjacent_bldg", "no_adjacent_of_adja_bldg", "no_neighbours_25m", "bag_construction_year", "obb_width_lod1", "actual_volume_lod2", "height_max_lod2"],
    ("area1", "permutation"): ["no_adjacent_bldg", "no_adjacent_of_adja_bldg", "no_neighbours_25m", "bag_construction_year", "bag_no_dwellings", "obb_width_lod1", "wall_area_lod2"],
    ("area2", "anova"): ["no_adjacent_bldg", "bag_no_dwellings", "fp_perimeter", "obb_width_lod1", "obb_length_lod1", "wall_area_lod2", "height_max_lod2"],
    ("area2", "mutual_info"): ["bag_no_dwellings", "fp_area", "fp_perimeter", "obb_width_lod1", "obb_length_lod1", "actual_volume_lod2", "roof_area_lod2"],
    ("area2", "impurity"): ["no_adjacent_bldg", "no_adjacent_of_adja_bldg", "bag_no_dwellings", "fp_area", "obb_width_lod1", "actual_volume_lod2", "height_max_lod2"],
    ("area2", "permutation"): ["no_adjacent_bldg", "no_adjacent_of_adja_bldg", "bag_no_dwellings", "fp_area", "obb_width_lod1", "obb_length_lod1", "wall_area_lod2"],
}


def preset(table: DataFrame, area: str, selection: str) -> DataFrame:
    """Key, label and the features of a selection."""
    return table.select(KEY, LABEL, *PRESETS[(area, selection)])


def feature_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in (KEY, LABEL)]


# What our parameter names are in Spark ML.
FOREST_PARAMS = {
    "n_estimators": "numTrees",
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "bootstrap": "bootstrap",
}
MAX_DEPTH = 30


FOREST_NAMES = [*FOREST_PARAMS, "criterion", "max_features", "class_weight"]
SVM_NAMES = ["C", "tol", "max_iter", "class_weight"]
# Known settings without a counterpart in Spark ML.
REFUSED = ["min_samples_split", "loss", "dual"]


def check_names(params: dict, known: list[str]) -> None:
    """A setting that would have no effect is an error."""
    unknown = sorted(set(params) - set(known))
    if unknown:
        why = "have no counterpart in Spark ML" if set(unknown) <= set(REFUSED) else "are not known"
        raise ValueError(f"the parameters {unknown} {why}")


class ForestModel(RandomForestClassificationModel):
    """A fitted forest whose trees stay in the JVM.

    Setting up a model in Python looks at all its attributes, and ``trees`` would make an
    object for each tree every time, which for a thousand trees takes longer than the fit.
    """

    trees = ()


class Forest(RandomForestClassifier):
    def _create_model(self, java_model) -> ForestModel:
        return ForestModel(java_model)


def forest(params: dict | None = None) -> RandomForestClassifier:
    """A random forest; trees grow to depth 30 at most, and a deeper setting is an error."""
    params = dict(params or {})
    check_names(params, FOREST_NAMES)
    if (params.get("max_depth") or 0) > MAX_DEPTH:
        raise ValueError(f"max_depth {params['max_depth']} is beyond the {MAX_DEPTH} that Spark ML grows")
    model = Forest(seed=0, numTrees=100, maxDepth=MAX_DEPTH, cacheNodeIds=True)
    for name, target in FOREST_PARAMS.items():
        if params.get(name) is not None:
            model.set(model.getParam(target), params[name])
    if params.get("criterion"):
        model.setImpurity("gini" if params["criterion"] == "gini" else "entropy")
    if params.get("max_features"):
        model.setFeatureSubsetStrategy(str(params["max_features"]))
    return model


def linear_svm(rows: int, params: dict | None = None) -> OneVsRest:
    """One linear support-vector machine per class (hinge loss)."""
    params = params or {}
    check_names(params, SVM_NAMES)
    base = LinearSVC(
        regParam=1.0 / (params.get("C", 1.0) * max(rows, 1)),
        tol=float(params.get("tol", 1e-4)),
        maxIter=int(params.get("max_iter", 1000)),
        standardization=False,
    )
    return OneVsRest(classifier=base, parallelism=4)


def fit_classifier(
    train: DataFrame, algorithm: str, params: dict | None = None, cols: list[str] | None = None
) -> PipelineModel:
    """Scaler, classifier and label names as one model that can be saved.

    ``algorithm`` is ``rf`` or ``svc``.
    """
    params = params or {}
    cols = cols or feature_columns(train)
    scaler = robust_scaler(train, cols)
    assembler = VectorAssembler(inputCols=scaled_names(cols), outputCol="features")
    prepared = assembler.transform(scaler.transform(train))
    return _fit_prepared(prepared, algorithm, params, [scaler, assembler])


def _fit_prepared(prepared: DataFrame, algorithm: str, params: dict, ahead: list) -> PipelineModel:
    counts = class_counts(prepared, LABEL)
    labels = list(counts)
    index = {c: float(i) for i, c in enumerate(labels)}
    data = prepared.withColumn("label_index", by_class(LABEL, index)).filter("label_index is not null")
    if algorithm == "rf":
        estimator = forest(params)
    elif algorithm == "svc":
        estimator = linear_svm(sum(counts.values()), params)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    estimator.setFeaturesCol("features").setLabelCol("label_index").setPredictionCol("prediction_index")
    if params.get("class_weight"):
        data = balanced_weight(data, LABEL)
        estimator.setWeightCol("weight")
    names = IndexToString(inputCol="prediction_index", outputCol="prediction", labels=labels)
    return PipelineModel(stages=[*ahead, estimator.fit(data), names])


def predict(model: PipelineModel, table: DataFrame) -> DataFrame:
    """``(bag_id, label, prediction)``."""
    return model.transform(table).select(KEY, F.col(LABEL).alias("label"), "prediction")


def evaluate(predictions: DataFrame) -> dict[str, DataFrame]:
    """Confusion matrix, report, accuracy and balanced accuracy."""
    truth = set(class_counts(predictions, "label")) | set(class_counts(predictions, "prediction"))
    return {
        "confusion": metrics.confusion_matrix(predictions, sorted(truth)),
        "report": metrics.class_report(predictions),
        "accuracy": metrics.accuracy(predictions),
        "balanced_accuracy": metrics.balanced_accuracy(predictions),
    }


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """Numbered rows for the CSV of predictions: prediction, truth and whether they agree."""
    ranked = rank_by_hash(predictions, [], "rows", KEY, "__r")
    return ranked.select(
        (F.col("__r") - 1).alias("row"),
        "prediction",
        F.col("label").alias("correct_class"),
        (F.col("prediction") == F.col("label")).alias("correct_prediction"),
    )


def fit_or_load(train: DataFrame, algorithm: str, path: str, params: dict | None = None) -> PipelineModel:
    """The model saved at ``path``; fitted and saved there first if there is none.

    A model is saved beside its place and then renamed, so that what is there is whole.
    """
    if not exists(train.sparkSession, path):
        beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        fit_classifier(train, algorithm, params).write().save(beside)
        jvm = train.sparkSession.sparkContext._jvm
        source, target = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(train.sparkSession.sparkContext._jsc.hadoopConfiguration())
        # A second writer may have been faster; its model then counts.
        if exists(train.sparkSession, path) or not fs.rename(source, target):
            fs.delete(source, True)
    return PipelineModel.load(path)


def transfer(path: str, other: DataFrame) -> DataFrame:
    """Predictions of a saved model, with the scaling of its own training rows, for another area."""
    return predict(PipelineModel.load(path), other)
