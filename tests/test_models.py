import itertools
import math
import time

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from pulsegate.operators import attribution, forests, metrics, models, splits
from pulsegate.plans.common import split_rows
from pulsegate.plans.views import WINDOWS, Tables
from pulsegate.schema import BASE_FEATURES

FOLDER = "/root/testdata/sf0.001"
SMALL = {"numTrees": 4, "maxDepth": 4, "minInstancesPerNode": 2}


def toy(spark, n=400):
    a, b, c = (F.pmod(F.col("id") * k, F.lit(m)).cast("double")
               for k, m in ((1, 7), (3, 11), (5, 13)))
    return spark.range(n).select(
        F.col("id").cast("string").alias("event_id"), a.alias("a"), b.alias("b"), c.alias("c"),
        ((a * b + c) > 25).cast("int").alias("y"))


@pytest.fixture(scope="module")
def fitted(spark):
    frame = toy(spark).cache()
    return frame, models.forest(["a", "b", "c"], "y", **SMALL).fit(frame)


def tree_value(leaves, x, known):
    """Expected output of a tree when only the features in ``known`` are given."""
    total = 0.0
    for value, _, path in leaves:
        part = value
        for f, (low, high, share) in path.items():
            part *= float(low < x[f] <= high) if f in known else share
        total += part
    return total


def test_attributions_are_shapley_values_and_add_up(spark, fitted):
    frame, model = fitted
    nodes = models.saved_nodes(model, frame)
    some = models.scored_by(model, frame).orderBy("event_id").limit(40)
    rows = attribution.explain_rows(some, nodes, ["a", "b", "c"]).collect()
    table = nodes.toPandas()
    forest = [attribution.tree_leaves(n) for _, n in table.groupby("treeID")]
    for row in rows:
        parts = [row.a_contribution, row.b_contribution, row.c_contribution]
        assert sum(parts) + row.BiasTerm == pytest.approx(row.p1, abs=1e-9)
    for row in rows[:8]:
        x = [row.a, row.b, row.c]
        for i, name in enumerate("abc"):
            want = 0.0
            others = [j for j in range(3) if j != i]
            for size in range(3):
                for known in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(2 - size) / 6
                    want += weight * np.mean([
                        tree_value(t, x, {*known, i}) - tree_value(t, x, set(known))
                        for t in forest])
            assert row[f"{name}_contribution"] == pytest.approx(want, abs=1e-9)


def test_how_rows_are_spread_does_not_change_attributions(spark, fitted):
    frame, model = fitted
    nodes = models.saved_nodes(model, frame)
    some = frame.limit(50)
    whole, apart = (attribution.explain_rows(some, nodes, ["a", "b", "c"], rows).orderBy(
        "event_id").collect() for rows in (8192, 7))
    assert len(whole) == len(apart) == 50
    for one, two in zip(whole, apart):
        assert one.event_id == two.event_id and one.BiasTerm == pytest.approx(two.BiasTerm)
        for name in ("a", "b", "c"):
            assert one[f"{name}_contribution"] == pytest.approx(two[f"{name}_contribution"])
    assert attribution.explain_rows(some.limit(0), nodes, ["a", "b", "c"]).count() == 0


def test_top_contributors(spark):
    frame = spark.createDataFrame([("e2", 0.8, 0.35, -0.9, -0.1)],
                                  "event_id STRING, p1 DOUBLE, cpu DOUBLE, mem DOUBLE, "
                                  "BiasTerm DOUBLE")
    best = attribution.top_contributors(frame, 1).first().top_contributors
    assert [(c.feature, c.value) for c in best] == [("mem", -0.9)]
    assert [r.feature for r in attribution.top_features(frame, 5).collect()] == ["mem", "cpu"]


def test_model_round_trip(spark, fitted, folder):
    frame, model = fitted
    reference = models.save_model(model, folder, "forest")
    assert reference == "models/forest"
    again = models.load_model(folder, reference)
    one = models.scored_by(model, frame).select("event_id", "p1")
    assert one.exceptAll(models.scored_by(again, frame).select("event_id", "p1")).isEmpty()


def test_class_weights_balance(spark):
    sums = (models.with_class_weight(toy(spark), "y").groupBy("y")
            .agg(F.sum("class_weight").alias("w")).collect())
    assert sums[0].w == pytest.approx(sums[1].w)


def test_rul_predictions_are_not_negative(spark):
    frame = toy(spark).withColumn("label", F.col("a") - 3.0)
    model = models.linear_rul(["a", "b"]).fit(frame)
    low = models.predict_rul(model, frame, ["event_id"]).agg(F.min("predicted_rul")).first()[0]
    assert low == 0.0


def test_adaptive_protocol(spark):
    rows = split_rows(Tables(spark, FOLDER))
    run = models.AdaptiveRun(rows, WINDOWS, True, BASE_FEATURES, **SMALL)
    report = {r.variant: r for r in run.variant_report().collect()}
    assert set(report) == {"static_rf", "unweighted_retraining", "weighted_retraining",
                           "full_adaptive"}
    evaluation = run.rows.where("split = 'evaluation'").count()
    for r in report.values():
        assert r.tp + r.fp + r.fn + r.tn == evaluation
    assert report["weighted_retraining"].pr_auc == report["full_adaptive"].pr_auc
    assert run.rows.where("day BETWEEN 18 AND 21 AND split = 'evaluation'").count() == 0
    explained = run.explanations(20)
    off = explained.select(F.abs(
        sum((F.col(f"{f}_contribution") for f in BASE_FEATURES), F.col("BiasTerm"))
        - F.col("p1")).alias("d")).agg(F.max("d")).first()[0]
    assert off is None or off < 1e-9


def test_without_drift_nothing_is_retrained(spark):
    rows = split_rows(Tables(spark, FOLDER))
    run = models.AdaptiveRun(rows, WINDOWS, False, BASE_FEATURES, **SMALL)
    assert run.retrained is None
    both = run.evaluated().where("p_static <> p_adaptive")
    assert both.isEmpty()


def test_split_key_is_checked(spark):
    frame = spark.createDataFrame([], "event_id STRING, day INT")
    with pytest.raises(ValueError):
        splits.with_split(frame, WINDOWS, split_key="rack_id")


def test_tabulated_patterns_and_integrals_give_the_same_contributions():
    made = np.random.default_rng(5)
    rows = made.random((600, 12))
    for size in (1, 2, 6, 11):
        feature = np.array([made.permutation(12)[:size] for _ in range(5)])
        low, high = made.random((2, 5, size)) * 0.5 + [[[0.0]], [[0.5]]]
        table = (made.random(5), feature, low, high, made.random((5, size)) * 0.9 + 0.05)
        whole, apart = np.zeros((2, 600, 12))
        attribution.add_contributions(rows, table, whole)
        for n in range(600):
            attribution.add_contributions(rows[n:n + 1], table, apart[n:n + 1])
        assert np.allclose(whole, apart, rtol=0, atol=1e-12)
        # by the definition, for one row: all orders of the path's features, by set size
        if size <= 6:
            want = np.zeros(12)
            for value, path, lo, hi, share in zip(*table):
                known = (rows[0][path] > lo) & (rows[0][path] <= hi)
                for i in range(size):
                    rest = [j for j in range(size) if j != i]
                    for k in range(size):
                        weight = 1.0 / (size * math.comb(size - 1, k))
                        for some in itertools.combinations(rest, k):
                            part = np.prod([known[j] if j in some else share[j] for j in rest])
                            want[path[i]] += value * weight * part * (known[i] - share[i])
            assert np.allclose(whole[0], want, rtol=0, atol=1e-12)


def test_deep_leaves_are_explained_within_time():
    """A forest of a million rows has leaves that the per-subset sums took minutes for."""
    made = np.random.default_rng(6)
    feature = np.array([made.permutation(14)[:8] for _ in range(512)])
    table = (made.random(512), feature, made.random((512, 8)) * 0.5,
             made.random((512, 8)) * 0.5 + 0.5, made.random((512, 8)) * 0.9 + 0.05)
    totals = np.zeros((8192, 14))
    started = time.process_time()
    attribution.add_contributions(made.random((8192, 14)), table, totals)
    # sums over set sizes took some 2 microseconds a row and leaf, so 8 s
    assert time.process_time() - started < 4.0 and np.abs(totals).sum() > 0


def test_leaves_of_many_features_are_looked_up():
    """With more rows than patterns a leaf's values are tabulated, whatever its features."""
    made = np.random.default_rng(7)
    feature = np.array([made.permutation(14)[:11] for _ in range(256)])
    low = np.where(made.random((256, 11)) < 0.3, -np.inf, made.random((256, 11)) * 0.3)
    high = np.where(made.random((256, 11)) < 0.3, np.inf, made.random((256, 11)) * 0.3 + 0.7)
    table = (made.random(256), feature, low, high, made.random((256, 11)) * 0.9 + 0.05)
    rows, (totals, apart) = made.random((16_384, 14)), np.zeros((2, 16_384, 14))
    started = time.process_time()
    attribution.add_contributions(rows, table, totals)
    looked_up = time.process_time() - started
    for n in range(0, 16_384, 64):
        attribution.add_contributions(rows[n:n + 64], table, apart[n:n + 64])
    integrated = time.process_time() - started - looked_up
    assert np.allclose(totals, apart, rtol=0, atol=1e-9)
    assert looked_up < integrated * 0.6


def test_training_rows_fill_the_cores_whatever_their_files(spark, folder):
    spark.range(200_000).selectExpr("id", "id % 2 AS y").coalesce(1).write.parquet(f"{folder}/one")
    rows = spark.read.parquet(f"{folder}/one")
    cores = spark.sparkContext.defaultParallelism
    dealt = models.spread(rows)
    assert rows.rdd.getNumPartitions() == 1
    assert dealt.rdd.getNumPartitions() == min(20, cores)
    assert dealt.agg(F.count_distinct("id")).first()[0] == dealt.count() == 200_000
    few = models.spread(rows.limit(10_000))
    assert few.rdd.getNumPartitions() == 1


def drawn(spark, n):
    """Three features of 30, 23 and 9 values and labels that they don't settle."""
    def draw(seed, values):
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(values)).cast("double")
    rows = spark.range(n).select("id", draw(1, 30).alias("a"), (draw(2, 23) - 4).alias("b"),
                                 (draw(3, 9) / 7).alias("c"), draw(4, 1000).alias("other"))
    level = F.col("a") * F.col("b") + F.col("c") * 17
    return rows.withColumns({"label": level + F.col("other") / 100,
                             "y": (level + F.col("other") / 10 > 110).cast("int")})


@pytest.mark.parametrize("kind, label, settings", [
    (GBTRegressor, "label", {}), (GBTRegressor, "label", {"lossType": "absolute"}),
    (GBTClassifier, "y", {"minInstancesPerNode": 40})])
def test_boosting_passes_over_cells_and_grows_the_trees_of_single_rows(
        spark, monkeypatch, kind, label, settings):
    settings = {"maxIter": 3, "maxDepth": 4, **settings}
    frame, features, cells = drawn(spark, 12_500).cache(), ["a", "b", "c"], []
    monkeypatch.setattr(models, "stage", lambda rows, name: cells.append(rows.cache()) or rows)
    grouped = models.GroupedBoosting(kind, features, label, **settings).fit(frame)
    single = Pipeline(stages=[models.assembled(features), kind(
        labelCol=label, seed=models.SEED, **settings)]).fit(frame)
    assert cells[0].agg(F.sum("_rows")).first()[0] == 12_500
    if "lossType" not in settings:
        assert cells[0].count() < 9_500
    wanted = vector_to_array("probability")[1] if kind is GBTClassifier else F.col("prediction")
    one, two = (m.transform(frame).select("id", wanted.alias("p")) for m in (grouped, single))
    apart = one.alias("one").join(two.alias("two"), "id").agg(
        F.count("*").alias("rows"), F.max(F.abs(F.col("one.p") - F.col("two.p"))).alias("off"),
        F.count_distinct("one.p").alias("values")).first()
    assert apart.rows == 12_500 and apart.off < 1e-9 and apart.values > 10


def test_boosting_refuses_missing_labels_and_infinite_features(spark):
    frame = drawn(spark, 12_500)
    one = F.col("id") == 77
    for name, bad in (("label", None), ("label", math.nan), ("b", math.nan), ("b", math.inf)):
        with pytest.raises(Exception, match="MUST NOT|NaN|infinite"):
            models.boosted_rul(["a", "b"], maxIter=1).fit(frame.withColumn(
                name, F.when(one, F.lit(bad).cast("double")).otherwise(F.col(name))))


def test_bins_are_even_and_a_heavy_value_has_its_own(spark):
    frame = spark.range(20_000).select(
        F.col("id").cast("double").alias("even"),
        F.when(F.col("id") % 4 == 0, 5_000.0).otherwise(F.col("id") / 2).alias("heavy"),
        (F.col("id") % 3).alias("few"), F.lit(2.5).alias("same"))
    bins = models.binning(frame, ["even", "heavy", "few", "same"], 32)
    rows = bins.transform(frame)
    sizes = [r["count"] for r in rows.groupBy("_even_bin").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 20_000 / 32 * 1.2
    alone = rows.where("heavy = 5000").select("_heavy_bin").distinct()
    assert alone.count() == 1
    assert rows.join(alone, "_heavy_bin").where("heavy <> 5000").isEmpty()
    assert rows.select("few", "_few_bin").distinct().count() == 3
    assert rows.select("_same_bin").distinct().count() == 1


class Unchanged:
    """Draws that take every row once, and all features at a node in their order."""

    def poisson(self, times):
        return times

    def random(self, shape):
        return np.tile(np.arange(shape[1]), (shape[0], 1))


@pytest.mark.parametrize("weights", [None, "by_class", "by_row"])
def test_a_grown_tree_is_the_tree_of_single_rows(spark, weights):
    frame = drawn(spark, 12_500).withColumns({
        "c": F.round(F.col("c") * 7), "b": F.col("b") + 4,
        "by_class": F.col("y") * 2.5 + 1, "by_row": F.pmod("id", F.lit(3)) + 1.0}).cache()
    features, settings = ["a", "b", "c"], {"maxDepth": 5, "minInstancesPerNode": 40}
    single = DecisionTreeClassifier(labelCol="y", **settings)
    if weights:
        single.setWeightCol(weights)
    tree = Pipeline(stages=[models.assembled(features), single]).fit(frame)
    rows = models.scored_by(tree, frame).toPandas()
    cells, times = np.unique(np.column_stack([
        rows[["a", "b", "c", "y"]], rows[weights] if weights else np.ones(len(rows))]),
        axis=0, return_counts=True)
    found = forests.grown(cells[:, :3].astype("uint8"), cells[:, 3].astype("uint8"), times,
                          cells[:, 4], Unchanged(), 5, 40, 3, 32)
    assert found["rows"][0] == 12_500 and len(found["rows"]) == tree.stages[-1].numNodes
    at = np.zeros(len(rows), int)
    for _ in range(5):
        inner = found["left"][at] >= 0
        here = rows[features].to_numpy()[np.arange(len(rows)), found["feature"][at]]
        at = np.where(inner, found["left"][at] + (here > found["cut"][at]), at)
    share = found["sums"][:, 1] / found["sums"].sum(axis=1)
    assert np.allclose(share[at], rows["p1"], rtol=0, atol=1e-9)


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return action(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_a_deep_forest_takes_no_more_passes_than_a_flat_one(spark):
    frame = drawn(spark, 24_000).withColumn("w", F.col("y") + 1.0)
    train, test = frame.where("id % 2 = 0").cache(), frame.where("id % 2 = 1").cache()
    jobs, found = {}, {}
    for depth in (2, 12):
        make = models.forest(["a", "b", "c"], "y", "w", numTrees=6, maxDepth=depth)
        found[depth], jobs[depth] = jobs_of(spark, f"depth-{depth}", lambda: make.fit(train))
    assert jobs[12] <= jobs[2] + 2
    spark_made = Pipeline(stages=[make.assembler, make.learner]).fit(train)
    one, two = (metrics.binary_summary(models.scored_by(m, test), "p1", 0.5, "y").first()
                for m in (found[12], spark_made))
    assert one.roc_auc == pytest.approx(two.roc_auc, abs=0.01)
    assert one.accuracy == pytest.approx(two.accuracy, abs=0.01)
    again = make.fit(train)
    nodes = [models.saved_nodes(m, train).orderBy("treeID", "id").collect()
             for m in (found[12], again)]
    assert nodes[0] == nodes[1]


@pytest.mark.parametrize("name, bad", [("y", None), ("a", math.nan), ("w", -1.0)])
def test_a_grown_forest_refuses_what_spark_refuses(spark, name, bad):
    frame = drawn(spark, 12_500).withColumn("w", F.lit(1.0))
    make = models.forest(["a", "b"], "y", "w", numTrees=2, maxDepth=2)
    kind = dict(frame.dtypes)[name]
    with pytest.raises(Exception, match="MUST NOT|NaN|null|[Nn]egative"):
        make.fit(frame.withColumn(name, F.when(F.col("id") == 77, F.lit(bad).cast(kind)).otherwise(
            F.col(name))))


def test_scores_of_folds_are_read_without_their_models(spark):
    train = toy(spark).withColumn("fold", F.pmod(F.col("event_id").cast("int"), F.lit(3)))
    report = models.cross_validated(models.forest(["a", "b", "c"], "y", **SMALL), train, "y", 3)
    assert "UDF" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.tp + r.fp + r.fn + r.tn for r in report.collect()) == 400
