import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegate.operators import quality, routing
from pulsegate.schema import TELEMETRY
from tests.rows import BASE, defect, gate_set, telemetry

each_partitioning = pytest.mark.parametrize("parts", [1, 7, 40])


@each_partitioning
def test_every_category_is_caught(spark, parts):
    rows = gate_set()
    judged = quality.classify_quality(telemetry(spark, rows).repartition(parts)).collect()
    good = sorted(r.event_id for r in judged if r.is_valid)
    assert good == ["a-good", "b-good"] and len(judged) == len(rows)
    found = quality.category_report(quality.classify_quality(telemetry(spark, rows).repartition(parts)))
    assert sorted(r.category for r in found.collect()) == sorted(
        {r["injected_defect_category"] for r in rows if "injected_defect_category" in r})


@each_partitioning
def test_edge_rows(spark, parts):
    at = BASE["event_time"]
    rows = [
        {"event_id": None}, {"event_id": None, "source_sequence": 2},
        {"event_id": "v", "schema_version": None},
        {"event_id": "lo", "cpu_util_pct": 0.0}, {"event_id": "hi", "cpu_util_pct": 100.0},
        {"event_id": "ten", "ingest_time": at + dt.timedelta(minutes=10)},
        {"event_id": "over", "ingest_time": at + dt.timedelta(minutes=10, microseconds=1)},
        {"event_id": "tol", "timeout_rate": BASE["error_rate"] + 1e-9},
        {"event_id": "lone", "duplicate_ordinal": 1},
        {"event_id": "same", "source_sequence": 1}, {"event_id": "same", "source_sequence": 2},
        {"event_id": "disk", "disk_util_pct": None},
    ]
    judged = quality.classify_quality(telemetry(spark, rows).repartition(parts))
    got = sorted((r.event_id or "", r.quality_failure_type) for r in judged.collect())
    assert got == sorted([
        ("", "missing_required_field"), ("", "missing_required_field"),
        ("v", "missing_required_field"), ("lo", ""), ("hi", ""), ("ten", ""),
        ("over", "event_too_late"), ("tol", ""), ("lone", "duplicate_event"),
        ("same", ""), ("same", "duplicate_event"), ("disk", "")])


@each_partitioning
def test_one_id_with_a_third_of_all_rows_keeps_exactly_one(spark, parts):
    event_id = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("e"), F.col("id")))
    frame = spark.range(0, 6000, 1, 8).select(*[
        (event_id if f.name == "event_id" else F.lit(BASE.get(f.name)).cast(f.dataType))
        .alias(f.name) for f in TELEMETRY])
    marked = quality.mark_repeats(frame.repartition(parts))
    hot = marked.where("event_id = 'hot'")
    assert marked.count() == 6000
    assert hot.where("NOT _is_repeat").count() == 1
    assert marked.where("event_id <> 'hot' AND _is_repeat").count() == 0


@each_partitioning
def test_first_arrival_stays(spark, parts):
    rows = [{"event_id": f"e{n % 7}" if n < 50 else f"e{n}", "source_sequence": 100 - n,
             "ingest_time": BASE["ingest_time"] + dt.timedelta(seconds=n % 5)}
            for n in range(60)] + [{"event_id": None}] * 3
    frame = telemetry(spark, rows)
    columns = ["event_id", "source_sequence", "_is_repeat"]
    want = [(r["event_id"], r["source_sequence"]) for r in sorted(
        (r for r in rows if r["event_id"]),
        key=lambda r: (r["ingest_time"], r["source_sequence"]))]
    first = {}
    for event_id, sequence in want:
        first.setdefault(event_id, sequence)
    got = quality.mark_repeats(frame.repartition(parts)).select(*columns).collect()
    assert len(got) == 63
    for row in got:
        assert row._is_repeat == (row.event_id is not None
                                  and first[row.event_id] != row.source_sequence)


def test_equal_arrival_keys_leave_the_same_survivor(spark):
    rows = [{"event_id": "tied", "cpu_util_pct": float(n)} for n in range(20)]
    kept = {parts: [r.cpu_util_pct for r in quality.mark_repeats(
        telemetry(spark, rows).repartition(parts)).where("NOT _is_repeat").collect()]
        for parts in (1, 7, 200)}
    assert len(kept[1]) == 1 and kept[1] == kept[7] == kept[200]


def test_clean_rows_count_as_category_false_alarms(spark):
    rows = [defect("a", "range", cpu_util_pct=120.0), {"event_id": "b", "cpu_util_pct": 130.0},
            {"event_id": "c"}]
    judged = quality.classify_quality(telemetry(spark, rows))
    fixed = {r.category: r for r in quality.category_report(judged).collect()}
    legacy = {r.category: r for r in quality.category_report(judged, True).collect()}
    assert (fixed["range"].tp, fixed["range"].fp) == (1, 1)
    assert (legacy["range"].tp, legacy["range"].fp) == (1, 0)


def test_reports_on_empty_input(spark):
    judged = quality.classify_quality(telemetry(spark, []))
    report = quality.quality_report(judged).first()
    assert report.received == 0 and report.precision == 0.0
    routed = routing.routing_report(routing.route_tasks(judged)).first()
    assert routed.routed_rows == 0 and routed.routing_accuracy is None


def test_router_edges(spark):
    rows = [
        {"event_id": "1", "criticality": "HIGH", "task_type": None, "latency_sla_ms": None},
        {"event_id": "2", "criticality": None, "task_type": "model_feedback"},
        {"event_id": "3", "latency_sla_ms": 1001},
        {"event_id": "4", "criticality": None, "task_type": None, "latency_sla_ms": None,
         "expected_route": None},
        {"event_id": "5", "task_type": "audit_compaction", "latency_sla_ms": 1001}]
    got = {r.event_id: (r.route_rule_id, r.route_correct) for r in
           routing.route_tasks(telemetry(spark, rows)).collect()}
    assert got == {"1": ("R1_HIGH_CRITICALITY", True), "2": ("R2_TIGHT_SLA", True),
                   "3": ("R3_STREAM_TASK", True), "4": ("R5_DEFAULT_BATCH", None),
                   "5": ("R4_DELAY_TOLERANT", False)}


def test_contract_asks_for_keys_not_values(spark):
    raw = spark.createDataFrame([('{"event_id": null, "schema_version": 2}',), ("not json",)],
                                "raw_json STRING")
    row = quality.contract_report(raw).first()
    assert row["rows"] == 2 and row.missing_required == 2 and row.v2_missing_extension == 1
    assert row.passed is False
