"""Random forests grown on binned rows: every task brings the rows together with some trees.

The forest is the one that Spark's learner grows: bootstrap by Poisson draws, a few features tried
at every node, cuts between at most ``maxBins`` bins, Gini impurity, and sibling leaves with the same
prediction merged. Spark takes a pass over all rows for every few open nodes, so a deep forest takes
thousands of passes. Here rows are binned and packed once, a byte a feature, and a task grows its
trees to the end.
"""
from __future__ import annotations

import math
import uuid
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from pulsegate.staging import FEWEST_ROWS, shared_folder, stage, tasks_for

# Packed rows of one task: with 14 features these and their draws take up to 160 bytes each.
MOST_PACKED = 4_000_000
# Histogram cells that are filled at once while a level is split.
HISTOGRAM = 1 << 21
NODE = ("treeID INT, id INT, prediction DOUBLE, impurity DOUBLE, zeros DOUBLE, ones DOUBLE, "
        "rows BIGINT, gain DOUBLE, left INT, right INT, feature INT, threshold DOUBLE")


class GrownForest(Estimator):
    """``RandomForestClassifier`` for two classes, its trees grown by ``grown_trees``.

    Fits a pipeline of assembler and Spark's own forest model. Rows that are alike in all bins,
    label and weight become one packed row that is drawn Poisson(n) times, as n single rows would
    be. Up to ``FEWEST_ROWS`` rows, more than ``MOST_PACKED`` packed ones, and rows or settings that
    are not plain (missing or infinite values, other labels than 0 and 1) go to Spark's learner.
    """

    def __init__(self, assembler: VectorAssembler, learner: RandomForestClassifier):
        super().__init__()
        self.assembler, self.learner = assembler, learner

    def _fit(self, frame: DataFrame) -> PipelineModel:
        features, learner = self.assembler.getInputCols(), self.learner
        label = learner.getLabelCol()
        weight = learner.getWeightCol() if learner.isSet("weightCol") else None
        frame = frame.select(*features, *dict.fromkeys([label, *([weight] if weight else [])]))
        rows = frame.persist()
        try:
            kept = None
            if plain(rows, features, label, weight):
                bins = binning(rows, features, learner.getMaxBins())
                kept = packed_rows(rows, bins, label, weight)
            if kept is None or kept.count() > MOST_PACKED:
                return Pipeline(stages=[self.assembler, learner]).fit(rows)
        finally:
            rows.unpersist()
        nodes = grown_trees(kept, bins, learner)
        return PipelineModel([self.assembler, as_model(nodes, learner, len(features))])


def binning(frame: DataFrame, features: list[str], bins: int) -> Bucketizer:
    """Cuts of every feature into at most ``bins`` bins of about equal numbers of rows.

    A feature with no more values than bins has a bin for each; a value that is more than a bin's
    share by itself gets its own.
    """
    seen = frame.agg(*[F.approx_count_distinct(n).alias(n) for n in features], F.greatest(
        F.lit(0.0), *[F.max(F.abs(n)) for n in features]).alias("_end")).first()
    if seen["_end"] == math.inf:
        raise ValueError("features must not be infinite")
    few = {}
    for name in (n for n in features if seen[n] <= 2 * bins):
        values = sorted(r[0] for r in frame.select(F.col(name).cast("double")).distinct().collect()
                        if r[0] is not None and not math.isnan(r[0]))
        if len(values) <= bins:
            few[name] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    many = [n for n in features if n not in few]
    shares = [k / bins for k in range(1, bins)]
    found = dict(zip(many, frame.approxQuantile(many, shares, 0.03 / bins) if many else []))
    splits = []
    for name in features:
        cuts = set(few.get(name, []))
        for value, times in Counter(found.get(name, [])).items():
            cuts |= {value, math.nextafter(value, math.inf)} if times > 1 else {value}
        # a bucketizer wants at least one cut
        splits.append([-math.inf, *sorted(cuts or {0.0}), math.inf])
    return Bucketizer(splitsArray=splits, inputCols=features, handleInvalid="error",
                      outputCols=[f"_{name}_bin" for name in features])


def plain(rows: DataFrame, features: list[str], label: str, weight: str | None) -> bool:
    """Are there enough rows, all with finite features, labels 0 and 1, and weights above 0?"""
    def odd(name: str, wanted: Column) -> Column:
        return ~F.coalesce(wanted, F.lit(False))

    number = {name: F.col(name).cast("double") for name in [*features, *([weight] if weight else [])]}
    tests = [odd(name, F.abs(value) < math.inf) for name, value in number.items()]
    tests.append(odd(label, F.col(label).isin(0, 1)))
    if weight:
        tests.append(odd(weight, number[weight] > 0))
    bad = tests[0]
    for test in tests[1:]:
        bad = bad | test
    found = rows.agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad"),
                     F.count_distinct(label).alias("labels")).first()
    return found["rows"] > FEWEST_ROWS and found["bad"] == 0 and found["labels"] == 2


def packed_rows(rows: DataFrame, bins: Bucketizer, label: str, weight: str | None) -> DataFrame:
    """One written row per combination of bins, label and weight, with its number of rows."""
    # adding 0 makes -0.0 a plain 0, which a bucketizer would put lower
    plain_rows = rows.select(
        *[(F.col(name).cast("double") + F.lit(0.0)).alias(name) for name in bins.getInputCols()],
        F.col(label).cast("tinyint").alias("_label"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_weight"))
    keys = [*[F.col(name).cast("smallint").alias(name) for name in bins.getOutputCols()],
            "_label", "_weight"]
    return stage(bins.transform(plain_rows).groupBy(*keys).agg(F.count("*").alias("_rows")), "cells")


def grown_trees(packed: DataFrame, bins: Bucketizer, learner: RandomForestClassifier) -> DataFrame:
    """Node table of the forest: blocks of packed rows go to every task, trees to one each."""
    names = bins.getOutputCols()
    spark, trees = packed.sparkSession, learner.getNumTrees()
    keys = [*names, "_label", "_weight"]
    # dealt and ordered by content, so that a fit can be repeated
    ordered = packed.repartition(tasks_for(spark, packed.count()), *keys).sortWithinPartitions(*keys)
    wide = "uint8" if max(len(s) for s in bins.getSplitsArray()) <= 257 else "uint16"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, batch in enumerate(batches):
            yield pd.DataFrame({
                "place": [number], "cells": [batch[names].to_numpy(wide).tobytes()],
                "labels": [batch["_label"].to_numpy("uint8").tobytes()],
                "times": [batch["_rows"].to_numpy("int64").tobytes()],
                "weights": [batch["_weight"].to_numpy("float64").tobytes()]})

    blocks = stage(ordered.mapInPandas(
        pack, "place INT, cells BINARY, labels BINARY, times BINARY, weights BINARY")
        .withColumn("part", F.spark_partition_id()), "packed")
    groups = min(trees, 2 * spark.sparkContext.defaultParallelism)
    # trees differ little in their time, so each task gets as many
    dealt = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    settings = {"depth": learner.getMaxDepth(), "least": max(learner.getMinInstancesPerNode(), 1),
                "tried": math.ceil(math.sqrt(len(names))), "width": max(
                    len(s) - 1 for s in bins.getSplitsArray())}
    cuts, seed = bins.getSplitsArray(), learner.getSeed()

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                found.setdefault(row[-1], []).append(row)
        for group, members in sorted(found.items()):
            members.sort(key=lambda row: (row[5], row[0]))
            cells, labels, times, weights = (
                np.frombuffer(b"".join(row[at] for row in members), kind)
                for at, kind in ((1, wide), (2, "uint8"), (3, "int64"), (4, "float64")))
            members.clear()
            cells = cells.reshape(len(labels), len(names))
            for tree in range(group, trees, groups):
                draw = np.random.default_rng([seed % (1 << 63), tree])
                yield node_table(tree, grown(cells, labels, times, weights, draw, **settings), cuts)

    return stage(dealt.repartitionById(groups, F.col("_group")).mapInPandas(grow, NODE), "trees")


def grown(cells: np.ndarray, labels: np.ndarray, times: np.ndarray, weights: np.ndarray,
          draw: np.random.Generator, depth: int, least: int, tried: int, width: int) -> dict:
    """One tree, level by level; nodes are numbered from the root downwards.

    ``cells`` [rows, features] are bins below ``width``. Rows stand in the order of their nodes.
    """
    drawn = draw.poisson(times)
    chosen = np.flatnonzero(drawn)
    x, y, count = cells[chosen], labels[chosen], drawn[chosen].astype(float)
    weight = weights[chosen]
    # mostly a class has one weight; then counts by class say it all
    by_class = np.array([weight[y == k][0] if (y == k).any() else 1.0 for k in (0, 1)])
    heavy = None if (weight == by_class[y]).all() else count * weight
    features, levels = x.shape[1], []
    counts = np.bincount(y, count, 2)[None, :]
    sums = counts * by_class if heavy is None else np.bincount(y, heavy, 2)[None, :]
    # nodes of this level; which of them are still to be split, and how many rows those have
    is_open, sizes = np.ones(1, bool), np.array([len(y)])
    for level in range(depth + 1):
        nodes = len(counts)
        record = {"sums": sums, "rows": counts.sum(axis=1), "feature": np.full(nodes, -1), "gain": np.zeros(nodes),
                  "cut": np.zeros(nodes, int), "left": np.full(nodes, -1)}
        levels.append(record)
        at = np.flatnonzero(is_open)
        if level == depth or not len(at) or not len(y):
            break
        feature, cut, gain, left_counts, left_sums = best_splits(
            x, y, count, heavy, by_class, sizes, counts[at], sums[at], least, width,
            draw.random((len(at), features)).argpartition(min(tried, features) - 1, axis=1)[:, :tried])
        split = gain > 0
        if not split.any():
            break
        where = at[split]
        record["feature"][where], record["cut"][where] = feature[split], cut[split]
        record["gain"][where] = gain[split]
        record["left"][where] = 2 * np.arange(len(where))
        left, right = left_counts[split], counts[where] - left_counts[split]
        counts = np.stack([left, right], axis=1).reshape(-1, 2)
        if heavy is None:
            sums = counts * by_class
        else:
            # a class without rows has no weight, whatever a difference leaves
            left, right = left_sums[split], sums[where] - left_sums[split]
            sums = np.where(counts > 0, np.stack([left, right], axis=1).reshape(-1, 2), 0.0)
        is_open = (impurity(sums) > np.finfo(float).eps) & (counts.sum(axis=1) >= 2 * least)
        x, y, count, heavy, sizes = parted(x, y, count, heavy, sizes, split, feature, cut, is_open)
    return merged(levels)


def impurity(sums: np.ndarray) -> np.ndarray:
    share = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
    return 1.0 - (share ** 2).sum(axis=1)


def best_splits(x, y, count, heavy, by_class, sizes, counts, sums, least, width, tried):
    """Feature, bin, gain and left side of the best cut of every open node."""
    nodes = len(sizes)
    feature, cut = np.zeros(nodes, int), np.zeros(nodes, int)
    gain, left_counts, left_sums = np.zeros(nodes), np.zeros((nodes, 2)), np.zeros((nodes, 2))
    ends = np.cumsum(sizes)
    step = max(HISTOGRAM // (2 * width), 1)
    for first in range(0, nodes, step):
        last = min(first + step, nodes)
        rows = slice(ends[first] - sizes[first], ends[last - 1])
        own, some = sizes[first:last], np.arange(last - first)
        base = np.repeat(some * (2 * width), own) + y[rows]
        flat, offsets = x[rows].ravel(), np.arange(rows.stop - rows.start) * x.shape[1]
        weight = sums[first:last].sum(axis=1)[:, None]
        before = (sums[first:last] ** 2).sum(axis=1)[:, None] / weight

        def below(keys, added):
            """Sums by node, bin and class over this bin and those below, without the last bin."""
            cells = np.bincount(keys, added[rows], len(some) * width * 2)
            return cells.reshape(-1, width, 2)[:, :-1].cumsum(axis=1)

        for j in range(tried.shape[1]):
            keys = base + 2 * flat[offsets + np.repeat(tried[first:last, j], own)].astype(np.int64)
            low = below(keys, count)
            high = counts[first:last, None, :] - low
            fine = np.minimum(low.sum(axis=2), high.sum(axis=2)) >= least
            if heavy is None:
                low_sums, high_sums = low * by_class, high * by_class
            else:
                low_sums = below(keys, heavy)
                high_sums = sums[first:last, None, :] - low_sums
            with np.errstate(divide="ignore", invalid="ignore"):
                after = sum((side ** 2).sum(axis=2) / side.sum(axis=2)
                            for side in (low_sums, high_sums))
                won = np.where(fine, (after - before) / weight, 0.0)
            best = won.argmax(axis=1)
            better = np.flatnonzero(won[some, best] > gain[first:last])
            to, here = first + better, (better, best[better])
            feature[to], cut[to], gain[to] = tried[to, j], best[better], won[here]
            left_counts[to], left_sums[to] = low[here], low_sums[here]
    return feature, cut, gain, left_counts, left_sums


def parted(x, y, count, heavy, sizes, split, feature, cut, is_open):
    """Rows of the open children, in the order of these; the rest is done with."""
    node = np.repeat(np.arange(len(sizes)), sizes)
    right = x[np.arange(len(y)), feature[node]] > cut[node]
    # the child's place among the children, or -1
    places = np.where(split, 2 * (np.cumsum(split) - 1), -1)
    child = np.where(split[node], places[node] + right, -1)
    stays = np.flatnonzero((child >= 0) & is_open[child])
    child, right = child[stays], right[stays]
    sizes = np.bincount(child, minlength=len(is_open))
    starts = np.cumsum(sizes) - sizes
    # rows of one parent are neighbours: count those before each that go the same way
    target = np.empty(len(stays), np.int64)
    for side in (False, True):
        same = np.flatnonzero(right == side)
        own = sizes[int(side)::2]
        target[same] = np.arange(len(same)) + np.repeat(starts[int(side)::2] - (np.cumsum(own) - own), own)
    order = np.empty(len(stays), np.int64)
    order[target] = stays
    return (x[order], y[order], count[order], None if heavy is None else heavy[order],
            sizes[is_open])


def merged(levels: list[dict]) -> dict:
    """The tree as one table; sibling leaves that predict the same are merged, as in Spark."""
    starts = np.cumsum([0, *[len(level["rows"]) for level in levels]])
    whole = {name: np.concatenate([level[name] for level in levels]) for name in levels[0]}
    prediction = (whole["sums"][:, 1] > whole["sums"][:, 0]).astype(float)
    left = whole["left"]
    for n in range(len(levels)):
        mine = slice(starts[n], starts[n + 1])
        left[mine] = np.where(left[mine] >= 0, left[mine] + starts[n + 1], -1)
    for n in reversed(range(len(levels))):
        inner = np.flatnonzero(left[starts[n]:starts[n + 1]] >= 0) + starts[n]
        child = left[inner]
        same = ((left[child] < 0) & (left[child + 1] < 0)
                & (prediction[child] == prediction[child + 1]))
        left[inner[same]] = -1
    kept = np.zeros(len(left), bool)
    kept[0] = True
    for n in range(len(levels)):
        inner = np.flatnonzero(kept[starts[n]:starts[n + 1]] & (left[starts[n]:starts[n + 1]] >= 0))
        child = left[inner + starts[n]]
        kept[child] = kept[child + 1] = True
    number = np.cumsum(kept) - 1
    inner = left >= 0
    left = np.where(inner, number[left], -1)
    return {"prediction": prediction[kept], "sums": whole["sums"][kept], "rows": whole["rows"][kept],
            "gain": np.where(inner, whole["gain"], -1.0)[kept], "left": left[kept],
            "feature": np.where(inner, whole["feature"], -1)[kept], "cut": whole["cut"][kept]}


def node_table(tree: int, nodes: dict, cuts: list[list[float]]) -> pd.DataFrame:
    """Nodes with cuts as Spark's thresholds: a row goes left when it is at most the threshold."""
    inner = nodes["left"] >= 0
    highest = np.full((len(cuts), max(map(len, cuts))), np.inf)
    for n, some in enumerate(cuts):
        highest[n, :len(some)] = some
    threshold = np.nextafter(highest[nodes["feature"], nodes["cut"] + 1], -np.inf)
    return pd.DataFrame({
        "treeID": tree, "id": np.arange(len(inner)), "prediction": nodes["prediction"],
        "impurity": impurity(nodes["sums"]), "zeros": nodes["sums"][:, 0], "ones": nodes["sums"][:, 1],
        "rows": nodes["rows"].astype(np.int64), "gain": nodes["gain"], "left": nodes["left"],
        "right": np.where(inner, nodes["left"] + 1, -1), "feature": nodes["feature"],
        "threshold": np.where(inner, threshold, 0.0)})


def as_model(nodes: DataFrame, learner: RandomForestClassifier,
             features: int) -> RandomForestClassificationModel:
    """Spark's forest model over these nodes: a saved stump forest whose nodes are replaced."""
    spark = nodes.sparkSession
    two = spark.createDataFrame([(Vectors.dense([float(k)] * features), float(k), 1.0) for k in (0, 1)],
                                ["features", learner.getLabelCol(), "_weight"])
    stump = learner.copy()
    if learner.isSet("weightCol"):
        two = two.withColumnRenamed("_weight", learner.getWeightCol())
    model = stump.fit(two.coalesce(1))
    path = f"{shared_folder(spark)}/models/grown-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    made = F.struct(
        "id", "prediction", "impurity", F.array("zeros", "ones").alias("impurityStats"),
        F.col("rows").alias("rawCount"), "gain", F.col("left").alias("leftChild"),
        F.col("right").alias("rightChild"), F.struct(
            F.col("feature").alias("featureIndex"),
            F.when(F.col("left") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>"))
            .alias("leftCategoriesOrThreshold"),
            F.lit(-1).alias("numCategories")).alias("split"))
    nodes.select("treeID", made.alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
