import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import Window, functions as F

from pulsegate import staging
from pulsegate.functions.scores import ks_p_value
from pulsegate.operators import (drift, features, labels, metrics, prefix, serving, splits,
                                 workload)
from tests.rows import BASE, telemetry

START = dt.datetime(2025, 1, 1)


def minutes(n):
    return START + dt.timedelta(minutes=n)


def test_running_totals_equal_a_plain_window(spark):
    rng = random.Random(7)
    rows = [(g, float(p), rng.randint(0, 9)) for g in ("a", "b", None)
            for p in rng.sample(range(1000), 200)]
    frame = spark.createDataFrame(rows, "g STRING, p DOUBLE, v BIGINT")
    for descending in (False, True):
        order = F.desc("p") if descending else F.asc("p")
        plain = frame.withColumn("run", F.sum("v").over(
            Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
        got = prefix.running_totals(frame, ["g"], "p", ["v"], descending, chunks=7)
        same = got.select("g", "p", "run_v").exceptAll(plain.select("g", "p", "run"))
        assert same.isEmpty() and got.count() == 600
        assert got.where("g = 'a'").select("total_v").distinct().first()[0] == sum(
            v for g, _, v in rows if g == "a")


def test_global_rank_splits_ties(spark):
    frame = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(
        F.col("id") / 500.0).alias("p"), F.col("id"))
    got = prefix.global_rank(frame, [F.desc("p"), F.asc("id")], chunks=5)
    want = frame.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("p"), F.asc("id"))).cast("bigint"))
    assert got.select("id", "rank").exceptAll(want.select("id", "rank")).isEmpty()


def test_first_rows_are_exact(spark):
    frame = spark.range(300).select((F.col("id") % 10).alias("a"), F.col("id").alias("b"))
    got = sorted((r.a, r.b) for r in serving.first_rows(frame, 47, ["a", "b"], 4).collect())
    assert got == sorted((n % 10, n) for n in range(300))[:47]
    assert serving.first_rows(frame, 1000, ["a", "b"], 4).count() == 300


def series_of(spark, rows):
    return workload.with_elapsed(spark.createDataFrame(
        rows, "event_minute TIMESTAMP, stream_units DOUBLE, batch_units DOUBLE, "
              "is_burst BOOLEAN"))


def test_backlog_equals_the_lowest_start(spark):
    """Backlog is the largest surplus of any stretch that ends now, or nothing."""
    rng = random.Random(17)
    rows = [(minutes(n), rng.uniform(0, 160), rng.uniform(0, 30), False) for n in range(150)]
    got = {r.event_minute: r.baseline_backlog for r in workload.unified_backlog(
        series_of(spark, rows), 90.0, chunks=5).collect()}
    surplus = [s + b - 90.0 for _, s, b, _ in rows]
    for n, (at, *_) in enumerate(rows):
        want = max(0.0, *(sum(surplus[k:n + 1]) for k in range(n + 1)))
        assert got[at] == pytest.approx(want, abs=1e-6)


def test_recovery(spark):
    rows = [(minutes(0), 20.0, 20.0, False), (minutes(1), 150.0, 90.0, True),
            (minutes(2), 30.0, 20.0, False), (minutes(3), 10.0, 30.0, False),
            (minutes(4), 20.0, 20.0, False)]
    trace = workload.unified_backlog(series_of(spark, rows), 100.0)
    row = workload.recovery_minutes(trace, "baseline_backlog").first()
    assert row.last_burst == minutes(1) and row.recovery_minutes == 3
    never = workload.unified_backlog(series_of(spark, rows[:4]), 100.0)
    assert workload.recovery_minutes(never, "baseline_backlog").first().recovery_minutes is None
    with pytest.raises(ValueError):
        workload.capacity_plan(series_of(spark, rows), 0.0)


def windows_frame(spark, reference, current):
    rows = ([("f", "reference", float(v)) for v in reference]
            + [("f", "current", float(v)) for v in current])
    return spark.createDataFrame(rows, "feature STRING, window STRING, value DOUBLE")


def test_ks_on_equal_and_shifted_data(spark):
    same = drift.ks_by_feature(windows_frame(spark, range(100), range(100))).first()
    assert same.ks_d == 0.0 and same.p_value == 1.0
    moved = drift.ks_by_feature(windows_frame(spark, range(100), range(100, 200)))
    row = moved.first()
    assert row.ks_d > 0.9 and row.p_value < 0.05
    assert drift.drift_gate(moved).first().drift_detected is True


def test_ks_equals_the_definition(spark):
    rng = random.Random(5)
    a = [rng.randint(0, 30) for _ in range(80)]
    b = [rng.randint(5, 40) for _ in range(50)]
    want = max(abs(sum(x <= v for x in a) / 80 - sum(x <= v for x in b) / 50) for v in a + b)
    got = drift.ks_by_feature(windows_frame(spark, a, b), chunks=5).first()
    assert got.ks_d == pytest.approx(want)


def test_p_value_column(spark):
    row = spark.range(1).select(
        ks_p_value(F.lit(0.0), F.lit(10), F.lit(10)).alias("zero"),
        ks_p_value(F.lit(0.3), F.lit(100), F.lit(100)).alias("mid")).first()
    assert row.zero == 1.0 and 0 < row.mid < 0.01


SCORES = [(.9, 1), (.7, 1), (.6, 0), (.2, 0), (.1, 0)]


def scores_frame(spark, rows):
    return spark.createDataFrame(rows, "p1 DOUBLE, failure_within_30min INT")


def test_perfect_ranking(spark):
    points = metrics.score_points(scores_frame(spark, SCORES), "p1")
    areas = metrics.areas(points).first()
    assert areas.roc_auc == 1.0 and areas.pr_auc == 1.0
    best = metrics.best_f1(metrics.threshold_curve(points)).first()
    assert (best.threshold, best.f1) == (0.7, 1.0)
    start = metrics.precision_recall_points(points).where("threshold IS NULL").first()
    assert (start.recall, start.precision) == (0.0, 1.0)


def test_areas_with_ties_equal_pair_counting(spark):
    rng = random.Random(11)
    rows = [(rng.randint(0, 9) / 10, rng.randint(0, 1)) for _ in range(200)]
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    points = metrics.score_points(scores_frame(spark, rows), "p1", chunks=3)
    assert metrics.areas(points).first().roc_auc == pytest.approx(wins / len(pos) / len(neg))


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_only(spark, label):
    frame = scores_frame(spark, [(0.3, label), (0.8, label)])
    assert metrics.areas(metrics.score_points(frame, "p1")).first().roc_auc is None
    row = metrics.metrics_at(frame, "p1", 0.5).first()
    assert row.accuracy == 0.5
    assert (row.recall is None) == (label == 0)


def test_binary_summary_contract(spark):
    row = metrics.binary_summary(scores_frame(spark, SCORES), "p1", 0.5).first()
    assert row.requested_threshold == 0.5 and row.threshold == 0.6
    assert (row.tp, row.fp, row.fn, row.tn) == (2, 1, 0, 2)
    assert row.roc_auc == 1.0


def test_missing_subset_fails(spark):
    table = spark.createDataFrame([("FD001",)], "subset STRING")
    expected = spark.createDataFrame([("FD001",), ("FD002",)], "subset STRING")
    with pytest.raises(ValueError, match="FD002"):
        metrics.require_members(table, expected, "subset")


def test_prediction_changes_are_found(spark):
    before = spark.createDataFrame([(1, 0.5), (2, 0.6)], "id INT, p DOUBLE")
    after = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.1)], "id INT, p DOUBLE")
    row = metrics.prediction_changes(before, after, "id", ["p"]).first()
    assert (row.only_baseline, row.only_candidate, row.changed_rows) == (0, 1, 1)
    assert row.identical is False
    assert metrics.prediction_changes(before, before, "id", ["p"]).first().identical is True
    assert metrics.differing_rows(before, after).count() == 3


def test_incident_bounds(spark):
    events = telemetry(spark, [{"event_id": str(n), "event_time": minutes(n)}
                               for n in (0, 10, 30, 40)])
    incidents = spark.createDataFrame([(BASE["server_id"], minutes(40))],
                                      "server_id STRING, incident_time TIMESTAMP")
    got = {r.event_id: r.lead_minutes for r in
           labels.lead_minutes(events, incidents, 30.0, chunks=3).collect()}
    assert got == {"0": None, "10": 30.0, "30": 10.0, "40": None}
    flagged = labels.future_incident(events, incidents, 30.0, chunks=3)
    assert {r.event_id: r.future_incident for r in flagged.collect()} == {
        "0": 0, "10": 1, "30": 1, "40": 0}


def test_rolling_features_look_back_inclusively(spark):
    rows = [{"event_id": str(n), "event_time": minutes(n), "error_rate": n / 100.0}
            for n in range(30)]
    got = {r.event_id: r for r in
           features.add_history_features(telemetry(spark, rows)).collect()}
    for n in range(30):
        five = [k / 100 for k in range(max(0, n - 4), n + 1)]
        fifteen = [k / 100 for k in range(max(0, n - 14), n + 1)]
        row = got[str(n)]
        assert row.error_rate_mean_5m == pytest.approx(sum(five) / len(five))
        assert row.error_rate_max_15m == max(fifteen)
        assert row.error_rate_delta_15m == pytest.approx(
            n / 100 - sum(fifteen) / len(fifteen))


@pytest.mark.parametrize("short, long", [(0, 1), (7, 40), (300, 100_000)])
def test_rolling_features_equal_brute_force(spark, short, long):
    """Frames of one second, of parts of a block and longer than the data; null times and keys."""
    rng = random.Random(2)
    rows = [{"event_id": str(n),
             "server_id": "hot" if n % 3 == 0 else None if n % 10 == 1 else f"s{n % 5}",
             "event_time": None if n % 29 == 0 else START + dt.timedelta(
                 seconds=rng.randint(0, 900)),
             "error_rate": rng.choice([0.0, 0.5, 0.25, None]), "queue_depth": float(n % 13)}
            for n in range(240)]
    got = {r.event_id: r for r in features.rolling_features(
        telemetry(spark, rows), None, short, long).collect()}
    assert len(got) == 240
    for row in rows:
        at = row["event_time"]

        def around(seconds, source):
            return [r[source] for r in rows if r["server_id"] == row["server_id"]
                    and r[source] is not None and (
                        r["event_time"] is None if at is None else r["event_time"] is not None
                        and 0 <= (at - r["event_time"]).total_seconds() <= seconds)]

        near, far, queue = around(short, "error_rate"), around(long, "error_rate"), around(
            long, "queue_depth")
        own = got[row["event_id"]]
        assert own.error_rate_mean_5m == (
            pytest.approx(sum(near) / len(near)) if near else None)
        assert own.error_rate_max_15m == max(far, default=None)
        assert own.queue_depth_mean_15m == pytest.approx(sum(queue) / len(queue))


def test_tasks_of_rolling_windows_follow_from_the_rows(spark, monkeypatch, capsys):
    rows = [{"event_id": str(n), "server_id": f"s{n % 3}",
             "event_time": START + dt.timedelta(seconds=7 * n), "error_rate": n % 10 / 10}
            for n in range(300)]
    frame, names = telemetry(spark, rows), ["error_rate_delta_15m"]

    def rolled():
        return {r.event_id: r for r in features.add_history_features(
            frame, 240, 840, names).collect()}

    whole = rolled()
    monkeypatch.setattr(staging, "MOST_ROWS", 50)
    # 300 seconds, each as the end of a frame and as the beginning of one
    features.add_history_features(frame, 240, 840, names).explain()
    assert "hashpartitioning(server_id" in (plan := capsys.readouterr().out)
    assert "_block" in plan and ", 12), REPARTITION_BY_NUM" in plan
    apart = rolled()
    for n in range(300):
        near = [k % 10 / 10 for k in range(n % 3, n + 1, 3) if 7 * (n - k) <= 840]
        for got in (whole, apart):
            assert got[str(n)].error_rate_delta_15m == pytest.approx(
                n % 10 / 10 - sum(near) / len(near), abs=1e-9)
    assert set(whole["0"].asDict()) - set(frame.columns) == {
        "error_rate_mean_15m", "error_rate_delta_15m"}


@pytest.mark.parametrize("chunks", [1, 3, 16])
def test_exact_quantile(spark, chunks):
    """Ties, NULLs, one value, negative values, a group with most of the rows."""
    rng = random.Random(8)
    rows = [("hot", float(rng.randint(-3, 3))) for _ in range(400)]
    rows += [("wide", rng.uniform(-1e6, 1e6)) for _ in range(57)] + [("one", 4.5), ("two", 1.0),
                                                                     ("two", 2.0)]
    rows += [("hot", None), ("none", None), (None, 1.0), (None, 3.0)]
    frame = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(5)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.q for r in prefix.exact_quantile(
            frame, ["g"], "v", share, "q", chunks).collect()}
        assert set(got) == {"hot", "wide", "one", "two", None}
        for g, value in got.items():
            own = sorted(v for h, v in rows if h == g and v is not None)
            place = (len(own) - 1) * share
            low = int(place)
            high = min(low + 1, len(own) - 1)
            assert value == pytest.approx(own[low] + (own[high] - own[low]) * (place - low))


@pytest.mark.parametrize("chunks", [1, 4, 25])
def test_grouped_rank(spark, chunks):
    """A group that spans chunks, NULL groups, and ties that get different ranks."""
    rng = random.Random(5)
    rows = [("hot" if n % 3 else None if n % 5 == 0 else f"g{n % 7}", rng.randint(0, 40), n)
            for n in range(300)]
    frame = spark.createDataFrame(rows, "g STRING, v INT, n INT").repartition(6)
    got = prefix.grouped_rank(frame, ["g"], [F.col("v").desc()], chunks).collect()
    assert len(got) == 300
    for g in {r.g for r in got}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [r.v for r in own] == sorted((v for h, v, _ in rows if h == g), reverse=True)
        assert {r.total for r in own} == {len(own)}


def test_folds_of_a_hot_label(spark):
    frame = spark.range(1003).selectExpr("IF(id % 100 = 0, 1, 0) AS y", "CAST(id AS STRING) AS k")
    got = splits.stratified_folds(frame, "y", "k", 10)
    assert got.columns == ["y", "k", "fold"] and got.count() == 1003
    sizes = {}
    for r in got.groupBy("y", "fold").count().collect():
        sizes.setdefault(r.y, []).append(r["count"])
    assert all(max(own) - min(own) <= 1 for own in sizes.values())
    again = splits.stratified_folds(frame.repartition(9), "y", "k", 10)
    assert got.exceptAll(again).isEmpty()


def test_windows_are_resolved_and_checked():
    got = splits.resolve_windows({"evaluation": [6, 9]}, {"recency_weight": None})
    assert got["evaluation"] == [6, 9] and got["recency_weight"] == 4.0
    for bad in ({"feedback": [3, 5]}, {"evaluation": [9, 8]}, {"recency_weight": 0},
                {"stability_window_days": 0}):
        with pytest.raises(ValueError):
            splits.resolve_windows(None, bad)
    assert splits.recent_days([22, 30], 2) == [29, 30]
    assert splits.recent_days([30, 30], 2) == [30, 30]


def test_training_set_needs_drift(spark):
    frame = spark.createDataFrame([("pre_drift_train",), ("feedback_train",)], "split STRING")
    assert splits.adaptive_training(frame, True).count() == 2
    assert splits.adaptive_training(frame, False).count() == 1


def test_sampling_does_not_depend_on_partitions(spark):
    frame = spark.range(2000).select(F.col("id").cast("string").alias("event_id"),
                                     (F.col("id") % 50 == 0).cast("int").alias("y"))
    once = splits.keep_positives(frame.repartition(3), "y")
    again = splits.keep_positives(frame.repartition(7), "y")
    assert once.exceptAll(again).isEmpty()
    assert once.where("y = 1").count() == 40 and 80 < once.count() < 320


def test_folds_are_balanced(spark):
    frame = spark.range(1003).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    sizes = splits.stratified_folds(frame, "y", "id", 10).groupBy("y", "fold").count()
    spread = sizes.groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in spread)


def test_health_and_alert_views(spark):
    rows = [("e1", minutes(0), "srv-1", 0.2), ("e2", minutes(1), "srv-2", 0.8)]
    frame = spark.createDataFrame(
        rows, "event_id STRING, event_time TIMESTAMP, server_id STRING, p1 DOUBLE")
    view = serving.health_view(serving.latest_per_server(frame), "p1", 0.7)
    summary = serving.health_summary(view).first()
    assert (summary.servers, summary.normal, summary.failure_warning) == (2, 1, 1)
    assert view.where("rank = 1").first().server_id == "srv-2"
    assert serving.alert_view(frame, "p1", 0.9, 200).count() == 0
    one = serving.alert_view(frame, "p1", 0.1, 1).first()
    assert (one.event_id, one.total_alerts, one.truncated) == ("e2", 2, True)
    assert not any(r.truncated for r in serving.alert_view(frame, "p1", 0.1).collect())
    with pytest.raises(ValueError):
        serving.alert_view(frame, "p1", 0.7, 0)


def test_empty_alert_table_is_an_answer(spark):
    empty = spark.createDataFrame([], "event_id STRING")
    other = spark.createDataFrame([("e",)], "event_id STRING")
    assert serving.first_available([("alerts", empty), ("snapshot", other)]).count() == 0
    assert serving.first_available([("alerts", None), ("snapshot", other)]).first().source \
        == "snapshot"
    assert serving.first_non_empty([("alerts", empty), ("snapshot", other)]).first().source \
        == "snapshot"


def test_empty_inputs(spark):
    no_scores = metrics.score_points(scores_frame(spark, []), "p1")
    areas = metrics.areas(no_scores).first()
    assert areas.roc_auc is None and areas.pr_auc is None
    assert metrics.best_f1(metrics.threshold_curve(no_scores)).first().threshold is None
    assert metrics.downsample_curve(metrics.threshold_curve(no_scores)).count() == 0
    gate = drift.drift_gate(drift.ks_by_feature(windows_frame(spark, [], []))).first()
    assert gate.max_ks_d is None and gate.drift_detected is False
    series = series_of(spark, [])
    assert workload.unified_backlog(series, 10.0).count() == 0
    assert features.add_history_features(telemetry(spark, [])).count() == 0
    one_sided = drift.ks_by_feature(windows_frame(spark, range(5), [])).first()
    assert one_sided.ks_d is None and one_sided.p_value is None


def test_many_marks_of_one_server(spark):
    """The next incident is found for a server that holds most of the rows."""
    events = spark.range(20_000).select(
        F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9))
        .alias("server_id"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("event_time"),
        F.col("id").cast("string").alias("event_id"))
    incidents = (events.where("event_id LIKE '%77'")
                 .select("server_id", F.col("event_time").alias("incident_time")).distinct())
    got = labels.lead_minutes(events, incidents, 10.0, chunks=9)
    pairs = events.join(incidents, "server_id", "left").withColumn(
        "gap", (F.unix_timestamp("incident_time") - F.unix_timestamp("event_time")) / 60.0)
    want = pairs.groupBy("event_id").agg(
        F.min(F.when(F.col("gap").between(1e-9, 10.0), F.col("gap"))).alias("lead_minutes"))
    columns = ["event_id", F.round("lead_minutes", 6).alias("lead_minutes")]
    assert got.select(*columns).exceptAll(want.select(*columns)).isEmpty()
    assert got.count() == 20_000
