"""Spark ML pipelines for remaining life and failure warning, and the adaptive protocol."""
from __future__ import annotations

import math

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from pulsegate.operators import metrics, splits
from pulsegate.operators.attribution import explain_rows, forest_nodes
from pulsegate.operators.forests import GrownForest, binning
from pulsegate.operators.labels import HORIZON_LABEL
from pulsegate.operators.serving import alerts_to_explain, latest_per_server, recent_alerts
from pulsegate.schema import BASE_FEATURES, TARGET
from pulsegate.staging import FEWEST_ROWS, shared_folder, stage, tasks_for

# Model settings.
SEED = 20260824
FOREST = {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 5}
BOOSTED_RUL = {"maxIter": 80, "maxDepth": 5, "stepSize": 0.05, "maxBins": 32}
BOOSTED = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.05, "minInstancesPerNode": 5}
BASELINE_FOREST = {"numTrees": 200, "maxDepth": 20}
RIDGE_GRID = [0.0001, 0.001, 0.01, 0.1, 1.0]
# How Spark grows a forest, not what: rows keep the node they reached, and more nodes share a pass.
GROWING = {"cacheNodeIds": True, "maxMemoryInMB": 512, "checkpointInterval": 20}


def assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def spread(frame: DataFrame) -> DataFrame:
    """Rows to fit on or to score, dealt evenly over tasks by their number, not their file size.

    A fit passes over its rows once or more a level and a score walks every tree, but a written
    table of 100,000 narrow rows is one file, thus one task. Every core gets rows; in a fit a task
    makes a table of all open nodes that has to be merged, so more tasks come only with
    ``MOST_ROWS`` each. Small tables stay as they are.
    """
    tasks = tasks_for(frame.sparkSession, frame.count())
    return frame.repartition(tasks) if tasks > 1 else frame


def linear_rul(features: list[str]) -> Pipeline:
    """Standardised inputs and ridge regression of the remaining life."""
    return Pipeline(stages=[
        assembled(features),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        LinearRegression(featuresCol="scaled", labelCol="label", regParam=0.1,
                         elasticNetParam=0.0, maxIter=100)])


class GroupedBoosting(Estimator):
    """Boosted trees, grown on one weighted row per cell of binned features.

    A boosted tree only asks which of ``maxBins`` bins a feature is in, and takes a pass over its
    rows a level. So rows are binned first, by cuts found on all of them, and those alike in all
    bins become one row that weighs as many: a pass costs what the cells cost, and their number
    has a bound that the number of rows does not move. The trees are those of the single rows: all
    rows of a cell get the same prediction, and squared loss asks of their labels only the mean, as
    what they differ by inside a cell is in no split's gain. Other losses get a row per label. The
    model scores single rows. Up to ``FEWEST_ROWS`` rows are fitted as they are.
    """

    def __init__(self, learner: type, features: list[str], label: str, **settings):
        super().__init__()
        self.learner, self.features, self.label = learner, features, label
        self.settings = {"labelCol": label, "seed": SEED, **settings}

    def _fit(self, frame: DataFrame) -> PipelineModel:
        rows = frame.select(*self.features, self.label).persist()
        try:
            total, least = rows.count(), self.settings.get("minInstancesPerNode", 1)
            if total <= max(FEWEST_ROWS, 2 * least):
                return Pipeline(stages=[
                    assembled(self.features), self.learner(**self.settings)]).fit(rows)
            bins = binning(rows, self.features, self.settings.get("maxBins", 32))
            # a sum has no attributes, so that trees take bins as numbers and not as categories
            places = [f"_{name}_place" for name in self.features]
            numbered = SQLTransformer(statement="SELECT *, {} FROM __THIS__".format(", ".join(
                f"`{b}` + 0 AS `{place}`" for b, place in zip(bins.getOutputCols(), places))))
            cells = self._cells(numbered.transform(bins.transform(rows)), places)
        finally:
            rows.unpersist()
        count = cells.count()
        learner = self.learner(**{
            **self.settings, "weightCol": "_rows",
            # every bin that has a cell is a candidate: Spark looks at maxBins ** 2 rows for them
            "maxBins": max(math.isqrt(count) + 1, 2),
            # of rows, not of cells
            "minInstancesPerNode": 1, "minWeightFractionPerNode": (least - 0.5) / total})
        grown = Pipeline(stages=[assembled(places), learner]).fit(spread(cells))
        return PipelineModel([bins, numbered, *grown.stages])

    def _cells(self, binned: DataFrame, names: list[str]) -> DataFrame:
        rows = F.count("*").cast("double").alias("_rows")
        if self.learner is GBTRegressor and self.settings.get("lossType") in (None, "squared"):
            # a missing label must be refused, not left out of the mean
            mean = F.avg(F.coalesce(F.col(self.label).cast("double"), F.lit(float("nan"))))
            cells = binned.groupBy(*names).agg(mean.alias(self.label), rows)
        else:
            cells = binned.groupBy(*names, self.label).agg(rows)
        return stage(cells, "cells")


def boosted_rul(features: list[str], **settings) -> Estimator:
    return GroupedBoosting(GBTRegressor, features, "label", **{**BOOSTED_RUL, **settings})


def predict_rul(model: PipelineModel, frame: DataFrame, keep: list[str]) -> DataFrame:
    """Predictions floored at zero."""
    return model.transform(frame).select(
        *keep, F.greatest(F.lit(0.0), "prediction").alias("predicted_rul"))


def forest(features: list[str], label: str, weight: str | None = None, **settings) -> Estimator:
    classifier = RandomForestClassifier(labelCol=label, seed=SEED,
                                        **{**FOREST, **GROWING, **settings})
    if weight:
        classifier.setWeightCol(weight)
    return GrownForest(assembled(features), classifier)


def boosted(features: list[str], label: str, **settings) -> Estimator:
    return GroupedBoosting(GBTClassifier, features, label, **{**BOOSTED, **settings})


def ridge_logistic(features: list[str], label: str, folds: int = 10,
                   grid: list[float] = RIDGE_GRID, max_iter: int = 200) -> Pipeline:
    """Logistic regression with the penalty chosen on the folds named in column ``fold``."""
    logistic = LogisticRegression(labelCol=label, elasticNetParam=0.0, maxIter=max_iter,
                                  standardization=True)
    search = CrossValidator(
        estimator=logistic, numFolds=folds, foldCol="fold",
        estimatorParamMaps=ParamGridBuilder().addGrid(logistic.regParam, grid).build(),
        evaluator=BinaryClassificationEvaluator(labelCol=label), parallelism=2)
    return Pipeline(stages=[assembled(features), search])


def scored_by(model: PipelineModel, frame: DataFrame, name: str = "p1") -> DataFrame:
    """The frame with the positive-class probability as one plain column."""
    return (model.transform(frame)
            .withColumn(name, vector_to_array("probability")[1]).select(*frame.columns, name))


def with_class_weight(frame: DataFrame, label: str) -> DataFrame:
    """Weights that make both classes count the same; the class table has two rows."""
    counts = frame.groupBy(label).agg(F.count("*").alias("_n"))
    total = frame.agg(F.count("*")).scalar()
    weights = counts.withColumn("class_weight", total / (2.0 * F.col("_n"))).drop("_n")
    return frame.join(F.broadcast(weights), label)


def baseline_forest(features: list[str], label: str, **settings) -> Estimator:
    """Forest on class-balanced weights; train on ``with_class_weight`` output."""
    return forest(features, label, "class_weight", **{"minInstancesPerNode": 1,
                                                      **BASELINE_FOREST, **settings})


def cross_validated(make: Estimator, train: DataFrame, label: str, folds: int,
                    threshold: float = 0.5) -> DataFrame:
    """Hold each fold out once; metrics per fold from the scored rows of all.

    The scores of a fold are written: a scoring task unpacks every model of its plan.
    """
    scored = None
    for fold in range(folds):
        model = make.fit(spread(train.where(F.col("fold") != fold)))
        held = stage(scored_by(model, spread(train.where(F.col("fold") == fold))).select(
            "fold", label, "p1"), "held-out")
        scored = held if scored is None else scored.unionByName(held)
    return metrics.metrics_at(scored, "p1", threshold, label, ["fold"])


def compare_models(estimators: dict[str, Estimator], train: DataFrame, test: DataFrame,
                   label: str = HORIZON_LABEL, threshold: float = 0.5) -> DataFrame:
    """The same rows, features, label and threshold for every model; one metric row each."""
    result, train, test = None, spread(train), spread(test)
    for name, estimator in estimators.items():
        scored = scored_by(estimator.fit(train), test).select(label, "p1")
        row = (metrics.binary_summary(scored, "p1", threshold, label)
               .withColumn("model", F.lit(name)))
        result = row if result is None else result.unionByName(row)
    return result


def save_model(model: PipelineModel, folder: str, name: str) -> str:
    """Save below a folder and return the path relative to it."""
    model.write().overwrite().save(f"{folder.rstrip('/')}/models/{name}")
    return f"models/{name}"


def load_model(folder: str, reference: str) -> PipelineModel:
    return PipelineModel.load(f"{folder.rstrip('/')}/{reference}")


class AdaptiveRun:
    """Static, retrained, weighted and calibrated variants of one forest.

    ``labelled`` carries day, split and is_recent. Only complete rows enter; training keeps
    all positives and a stable share of negatives; the threshold is chosen on the calibration
    split alone and the evaluation days are held out.
    """

    def __init__(self, labelled: DataFrame, windows: dict, drift_detected: bool,
                 features: list[str] = BASE_FEATURES, label: str = TARGET,
                 ablation: bool = True, negative_share: float = splits.NEGATIVE_SHARE,
                 **settings):
        self.features, self.label, self.windows = features, label, windows
        self._evaluated = None
        context = ["event_id", "event_time", "server_id", "day", "split", "is_recent"]
        rows = splits.complete_rows(labelled.select(*context, *features, label), features, label)
        self.rows = stage(rows.where("split IS NOT NULL"), "adaptive-rows")
        self.drift_detected = drift_detected

        sampled = splits.keep_positives(self.rows, label, negative_share)
        before = sampled.where(F.col("split") == "pre_drift_train")
        adaptive = spread(splits.with_recency_weight(
            splits.adaptive_training(sampled, drift_detected), windows["feedback"],
            windows["recency_weight"]))
        plain = forest(features, label, **settings)
        self.static = plain.fit(spread(before))
        self.retrained = plain.fit(adaptive) if drift_detected and ablation else None
        weight = "sample_weight" if drift_detected else None
        self.adaptive = forest(features, label, weight, **settings).fit(adaptive)

        held = scored_by(self.adaptive, self._split("feedback_calibration"))
        best = metrics.best_f1(metrics.threshold_curve(
            metrics.score_points(held, "p1", label))).first()
        if best is None or best["threshold"] is None:
            raise ValueError("no calibration rows to choose a threshold on")
        self.threshold, self.calibration_f1 = best["threshold"], best["f1"]

    def _split(self, name: str) -> DataFrame:
        return spread(self.rows.where(F.col("split") == name))

    def evaluated(self) -> DataFrame:
        """Evaluation rows with one probability column per model, scored once."""
        if self._evaluated is None:
            scored = scored_by(self.static, self._split("evaluation"), "p_static")
            if self.retrained is not None:
                scored = scored_by(self.retrained, scored, "p_retrained")
            self._evaluated = stage(scored_by(self.adaptive, scored, "p_adaptive"), "evaluated")
        return self._evaluated

    def variants(self) -> dict[str, tuple[str, float]]:
        named = {"static_rf": ("p_static", 0.5), "weighted_retraining": ("p_adaptive", 0.5),
                 "full_adaptive": ("p_adaptive", self.threshold)}
        if self.retrained is not None:
            named["unweighted_retraining"] = ("p_retrained", 0.5)
        return named

    def variant_report(self) -> DataFrame:
        return metrics.variant_metrics(self.evaluated(), self.variants(), self.label)

    def stability(self) -> DataFrame:
        """Metrics of the static and the calibrated variant per evaluation window."""
        windows = metrics.stability_windows(
            self.evaluated(), self.windows["evaluation"], self.windows["stability_window_days"])
        keys = ["window_start_day", "window_end_day"]
        chosen = {k: v for k, v in self.variants().items() if k in ("static_rf", "full_adaptive")}
        stacked = metrics.variants_long(windows, chosen, [*keys, self.label])
        return metrics.metrics_at(stacked, "score", F.col("threshold"), self.label,
                                  [*keys, "variant"])

    def health_snapshot(self) -> DataFrame:
        """Newest recent row per server with its score."""
        recent = self._split("evaluation").where("is_recent")
        return scored_by(self.adaptive, latest_per_server(recent))

    def threshold_alerts(self, limit: int | None = None) -> DataFrame:
        recent = self.evaluated().where("is_recent").withColumnRenamed("p_adaptive", "p1")
        context = [c for c in recent.columns if not c.startswith("p_")]
        return recent_alerts(recent.select(*context), "p1", self.threshold, limit)

    def explanations(self, limit: int | None = None) -> DataFrame:
        """Attributions of all (or the first) evaluation alerts, from the saved forest's nodes."""
        scored = self.evaluated().withColumnRenamed("p_adaptive", "p1")
        alerts = alerts_to_explain(scored, "p1", self.threshold, limit)
        chosen = alerts.select("event_id", "event_time", "server_id", "p1", *self.features)
        return explain_rows(chosen, saved_nodes(self.adaptive, chosen), self.features)


def saved_nodes(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Node table of the forest inside a fitted pipeline."""
    trees = next(s for s in model.stages if isinstance(s, RandomForestClassificationModel))
    path = f"{shared_folder(frame.sparkSession)}/models/{trees.uid}"
    trees.write().overwrite().save(path)
    return forest_nodes(frame.sparkSession, path)
