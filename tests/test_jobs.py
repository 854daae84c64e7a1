import pathlib

import pytest
from pyspark.sql import functions as F

from pulsegate.plans import jobs
from pulsegate.plans.views import START, WINDOWS, Tables
from pulsegate.schema import TELEMETRY_FIELDS
from pulsegate.sources import message_log, readers, sinks

FOLDER = "/root/testdata/sf0.001"
SMALL = {"numTrees": 3, "maxDepth": 3, "minInstancesPerNode": 2}


def ndjson(spark, folder):
    path = f"{folder}/telemetry"
    Tables(spark, FOLDER).telemetry().select(*TELEMETRY_FIELDS).write.json(path)
    return readers.telemetry_files(spark, path)


def test_quality_and_routing_job(spark, folder):
    jobs.quality_and_routing(ndjson(spark, folder), f"{folder}/out", "6 hours", "hour", 0.02)
    reports = {p.name: spark.read.json(str(p)) for p in
               pathlib.Path(f"{folder}/out/reports").iterdir()}
    quality = reports["quality"].first()
    assert quality.received == 1010 and quality.accepted + quality.quarantined == 1010
    assert reports["routing"].first().routed_rows == quality.accepted
    assert reports["routing_losses"].first().lossless is True
    assert reports["paths"].count() == 9 and reports["quality_rules"].count() == 16
    assert reports["queue_peaks"].first().max_backlog_units > 0
    assert readers.telemetry_files(spark, f"{folder}/out/accepted").count() == quality.accepted
    assert spark.read.parquet(f"{folder}/out/quarantine").count() == quality.quarantined


def test_adaptive_job(spark, folder):
    jobs.adaptive_cycle(ndjson(spark, folder), f"{folder}/out", WINDOWS, ([1, 10], [15, 17]),
                        START, True, "server_id", 0.02, 0.99, **SMALL)
    drift = spark.read.json(f"{folder}/out/reports/drift").first()
    assert drift.max_ks_d > 0
    variants = spark.read.json(f"{folder}/out/reports/variants")
    assert {"static_rf", "full_adaptive"} <= {r.variant for r in variants.collect()}
    assert spark.read.parquet(f"{folder}/out/server_health_snapshot").count() > 0
    assert pathlib.Path(f"{folder}/out/models/adaptive/metadata").is_dir()


def trajectories(spark, path, offset):
    """Text lines of 26 numbers for units of different length."""
    lines = (spark.range(12).withColumn("cycle", F.explode(F.sequence(
        F.lit(1), (F.col("id") * 3 + 40 - offset).cast("int"))))
        .select(F.concat_ws("  ", (F.col("id") + 1).cast("string"), F.col("cycle").cast("string"),
                            *[F.round(F.pmod(F.col("cycle") * n + F.col("id"), F.lit(17)) / 3, 3)
                              .cast("string") for n in range(1, 25)]).alias("value")))
    lines.write.text(path)
    return readers.trajectory_files(spark, path)


def test_life_jobs(spark, folder):
    train = trajectories(spark, f"{folder}/train", 0)
    test = trajectories(spark, f"{folder}/test", 15)
    pathlib.Path(f"{folder}/rul.txt").write_text("15\n" * 12)
    truth = readers.rul_labels(spark, f"{folder}/rul.txt")
    jobs.remaining_life(train, test, truth, f"{folder}/out")
    report = spark.read.json(f"{folder}/out/linear/metrics").first()
    assert report.test_engines == 12 and report.rmse >= report.mae
    with pytest.raises(ValueError, match="differ"):
        jobs.remaining_life(train, test, truth.where("unit_id < 12"), f"{folder}/bad")
    jobs.failure_horizon(train, test, truth, f"{folder}/cls", 30, 2, SMALL,
                         {"maxIter": 2, "maxDepth": 2}, [0.01, 0.1])
    table = spark.read.json(f"{folder}/cls/comparison")
    assert {r.model for r in table.collect()} == {
        "logistic_regression", "random_forest", "gradient_boosting"}
    assert spark.read.json(f"{folder}/cls/distribution/test").first().engines == 12


def test_stream_job_from_log_to_log(spark, folder):
    """Messages in, accepted and quarantined messages out, over restarts."""
    rows = Tables(spark, FOLDER).telemetry().select(*TELEMETRY_FIELDS)
    message_log.append(sinks.as_messages(rows), f"{folder}/in", "all")
    for _ in range(3):
        source = jobs.telemetry_stream(spark, f"{folder}/state", log=f"{folder}/in", cap=400)
        query = jobs.stream_telemetry(source, f"{folder}/out", f"{folder}/state", None,
                                      f"{folder}/logs")
        query.awaitTermination(240)
        assert query.exception() is None
    metrics = readers.stream_metrics(spark, f"{folder}/out/metrics").collect()
    assert sum(m.received for m in metrics) == 1010 and len(metrics) == 3
    for topic, counted in (("predictions", "accepted"), ("quarantine", "quarantined")):
        assert message_log.messages(spark, f"{folder}/logs/{topic}").count() == sum(
            m[counted] for m in metrics)
    for wrong in ({}, {"inbox": "a", "log": "b"}, {"kafka": "host:9092"}):
        with pytest.raises(ValueError):
            jobs.telemetry_stream(spark, f"{folder}/state", **wrong)
