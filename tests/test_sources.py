import json
import pathlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulsegate.operators import quality, routing
from pulsegate.schema import TELEMETRY_FIELDS, TRAJECTORY_COLUMNS
from pulsegate.sources import readers, registry, scenario, sinks
from pulsegate.staging import shared_folder, stage
from tests.rows import gate_set, telemetry
from tests.test_streaming import line


def write(path, text):
    target = pathlib.Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    return str(target)


def test_trajectory_text(spark, folder):
    good = " 1   2 " + "  ".join(str(n / 10) for n in range(24)) + " \n"
    row = readers.trajectory_files(spark, write(f"{folder}/good.txt", good)).first()
    assert (row.unit_id, row.cycle, row.setting_1, row.sensor_21) == (1, 2, 0.0, 2.3)
    assert len(row) == len(TRAJECTORY_COLUMNS) == 26
    for name, text in (("short", " ".join(["1"] * 25)), ("word", " ".join(["1"] * 25 + ["x"]))):
        bad = readers.trajectory_files(spark, write(f"{folder}/{name}.txt", good + text + "\n"))
        with pytest.raises(PySparkException):
            bad.select("sensor_21").collect()


def test_rul_labels_follow_line_order(spark, folder):
    path = write(f"{folder}/rul.txt", "112 \n98\n69\n")
    assert [(r.unit_id, r.actual_rul) for r in
            readers.rul_labels(spark, path).orderBy("unit_id").collect()] == [
        (1, 112.0), (2, 98.0), (3, 69.0)]


def test_telemetry_files(spark, folder):
    text = "".join(line(r) + "\n" for r in gate_set())
    write(f"{folder}/t/event_date=2025-01-01/a.ndjson", text)
    write(f"{folder}/t/b.json", "{bad\n")
    explicit = readers.telemetry_files(spark, f"{folder}/t", "*.ndjson")
    assert explicit.columns == TELEMETRY_FIELDS and explicit.count() == 8
    kept = readers.telemetry_files(spark, f"{folder}/t", keep_corrupt=True)
    assert [r[readers.CORRUPT] for r in
            kept.cache().where(f"{readers.CORRUPT} IS NOT NULL").collect()] == ["{bad"]
    inferred = readers.telemetry_files_inferred(spark, f"{folder}/t/event_date=2025-01-01")
    assert inferred.count() == 8 and dict(inferred.dtypes)["event_time"] == "string"
    found = [r.path for r in readers.telemetry_sources(spark, f"{folder}/t").collect()]
    assert [p.rsplit("/", 1)[1] for p in found] == ["b.json", "a.ndjson"]
    pathlib.Path(f"{folder}/none").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.telemetry_sources(spark, f"{folder}/none")


def test_reports_and_metrics_may_be_missing(spark, folder):
    assert readers.report(spark, f"{folder}/absent.json") is None
    assert readers.report(spark, write(f"{folder}/bad.json", "{oops")) is None
    good = readers.report(spark, write(f"{folder}/good.json", '{"a": {"b": 1}}'))
    assert good.first().a.b == 1
    assert readers.stream_metrics(spark, f"{folder}/absent").count() == 0
    write(f"{folder}/m/part-1.json", '{"batch_id": 3, "received": 5}\nbroken\n')
    assert [r.batch_id for r in
            readers.stream_metrics(spark, f"{folder}/m").collect()] == [3]


def test_registry(spark):
    assert registry.versions() == [1, 2]
    assert len(registry.required_keys(1)) == 24 and len(registry.required_keys(2)) == 26
    with pytest.raises(KeyError):
        registry.required_keys(3)
    raw = spark.createDataFrame([(1, '{"event_id": null}'), (7, "{}")],
                                "schema_version INT, raw_json STRING")
    got = {r.schema_version: r for r in
           quality.registry_gaps(raw, registry.registry_table(spark)).collect()}
    assert len(got[1].missing_keys) == 23 and got[7].registered is False


def test_evidence_sinks(spark, folder):
    judged = quality.classify_quality(telemetry(spark, gate_set()))
    sinks.write_accepted_evidence(judged, f"{folder}/accepted")
    sinks.write_quarantine_evidence(judged, f"{folder}/quarantine")
    routed = routing.route_tasks(quality.accepted(judged))
    sinks.write_routing_audit(routed, f"{folder}/audit")
    assert readers.telemetry_files(spark, f"{folder}/accepted").count() == 2
    assert spark.read.parquet(f"{folder}/quarantine").columns == sinks.QUARANTINE_COLUMNS
    audit = spark.read.parquet(f"{folder}/audit")
    assert sorted(audit.columns) == sorted(sinks.AUDIT_COLUMNS)
    assert (pathlib.Path(folder) / "audit" / "route=stream").is_dir()
    documents = sinks.prediction_documents(routing.risk_scored(judged))
    assert len(documents.columns) == 7
    sinks.write_documents(routing.risk_scored(quality.accepted(judged)), "json",
                          {"path": f"{folder}/documents"})
    assert spark.read.json(f"{folder}/documents").count() == 2
    message = sinks.as_messages(documents).first()
    assert message.key in ("n7-web-4", "n7-web-5") and "risk_probability" in json.loads(message.value)


def test_artefacts_are_not_overwritten(spark, folder):
    empty = spark.createDataFrame([], "event_id STRING, p1 DOUBLE")
    sinks.write_artefact(empty, f"{folder}/alerts")
    assert spark.read.parquet(f"{folder}/alerts").columns == ["event_id", "p1"]
    with pytest.raises(PySparkException):
        sinks.write_artefact(empty, f"{folder}/alerts")
    rows = spark.createDataFrame([("a", 0.5)], "event_id STRING, p1 DOUBLE")
    sinks.write_split_csv(rows, f"{folder}/csv", ["event_id", "p1"])
    with pytest.raises(PySparkException):
        sinks.write_split_csv(rows, f"{folder}/csv", ["event_id", "p1"])
    back = readers.prepared_csv(spark, f"{folder}/csv", "event_id STRING, p1 DOUBLE")
    assert [tuple(r) for r in back.collect()] == [("a", 0.5)]


def test_reports_traces_and_capped_files(spark, folder):
    frame = spark.range(10).coalesce(1)
    sinks.write_report(frame.agg(F.struct(F.max("id").alias("m")).alias("s")), f"{folder}/r")
    assert spark.read.json(f"{folder}/r").first().s.m == 9
    sinks.write_trace(frame, f"{folder}/trace")
    assert spark.read.option("header", True).csv(f"{folder}/trace").count() == 10
    sinks.capped_files(frame, f"{folder}/capped", 3)
    assert len(list(pathlib.Path(f"{folder}/capped").glob("*.parquet"))) == 4


def test_validated_reads_prune_by_day(spark, folder):
    judged = quality.accepted(quality.classify_quality(telemetry(spark, gate_set())))
    sinks.write_validated(judged, f"{folder}/v")
    day = readers.validated_events(spark, f"{folder}/v").where("event_date = '2024-05-17'")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and day.count() == 2


CONFIG = {
    "scenario": "concept_drift_v2", "start_time": "2025-01-01T00:00:00Z",
    "logical_servers": 2, "days": 7, "sample_interval_minutes": 1, "schema_v2_start_day": 4,
    "drift_start_day": 5, "failure_horizon_minutes": 30, "precursor_window_minutes": 30,
    "quality_error_rate": 0.02, "late_event_rate": 0.01,
    "burst_windows": [{"start_day": 2, "start_hour": 18, "duration_minutes": 60,
                       "multiplier": 5}]}


def test_scenario(spark, folder):
    path = write(f"{folder}/s.json", json.dumps(CONFIG))
    loaded = scenario.load_scenario(spark, path)
    assert loaded.defect_rates == {"range": 0.01, "completeness": 0.01, "temporal": 0.01}
    assert loaded.drift_days() == ([1, 3], [5, 7])
    for change in ({"days": 0}, {"scenario": "x"}, {"drift_start_day": 9},
                   {"quality_defect_rates": {"odd": 0.1}},
                   {"quality_defect_rates": {"range": 1.0}}, {"drift_transition_days": -1}):
        with pytest.raises(ValueError):
            scenario.scenario_from(json.dumps({**CONFIG, **change}))


def test_staged_tables_go_to_the_named_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    staged = stage(spark.range(5), "t")
    assert staged.count() == 5 and f"{named}/staged/" in staged.inputFiles()[0]


def test_unreadable_metric_lines_are_counted_and_kept(spark, folder):
    metrics = pathlib.Path(f"{folder}/metrics/batch-1")
    metrics.mkdir(parents=True)
    lines = ['{"batch_id": 1, "received": 5}', '{"batch_id": 2, "recei', '{"batch_id": "x"}', "",
             '{"batch_id": 3}']
    (metrics / "part.json").write_text("\n".join(lines) + "\n")
    path = f"{folder}/metrics"
    assert sorted(r.batch_id for r in readers.stream_metrics(spark, path).collect()) == [1, 3]
    assert readers.keep_unreadable_metrics(spark, path, f"{folder}/side") == 2
    kept = spark.read.parquet(f"{folder}/side").collect()
    assert sorted(r.line for r in kept) == sorted(lines[1:3])
    assert all(r.file.endswith("part.json") for r in kept)
    assert readers.keep_unreadable_metrics(spark, f"{folder}/none", f"{folder}/empty") == 0
