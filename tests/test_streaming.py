import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F

from pulsegate.operators import quality, workload
from pulsegate.plans import roundtrip
from pulsegate.plans.views import Tables
from pulsegate.sources import message_log, readers
from pulsegate.streaming import gate_stream, state
from tests.rows import BASE, gate_set


def line(row):
    filled = {**BASE, **row}
    return json.dumps({k: v.isoformat() + "Z" if isinstance(v, dt.datetime) else v
                       for k, v in filled.items() if v is not None})


def drop_files(folder, batches):
    import pathlib
    inbox = pathlib.Path(folder)
    inbox.mkdir(parents=True, exist_ok=True)
    for n, rows in enumerate(batches):
        (inbox / f"batch-{n:03d}.json").write_text("\n".join(rows) + "\n")
        # the file source takes older files first
        os.utime(inbox / f"batch-{n:03d}.json", (1_000_000 + n, 1_000_000 + n))
    return str(inbox)


def run(spark, folder, batches, max_files=100):
    inbox = drop_files(f"{folder}/inbox", batches)
    out = gate_stream.GateSinks(f"{folder}/out")
    query = gate_stream.run_gate(readers.telemetry_inbox(spark, inbox, max_files), out,
                              f"{folder}/checkpoint", every=None)
    query.awaitTermination(240)
    assert query.exception() is None
    return inbox, out, query


def test_stream_accepts_what_batch_accepts(spark, folder):
    lines = [line(r) for r in gate_set()]
    inbox, out, query = run(spark, folder, [lines[:4], lines[4:] + ["{broken"]])
    batch = quality.accepted(quality.classify_quality(readers.telemetry_files(spark, inbox)))
    streamed = gate_stream.validated_table(spark, out)
    assert sorted(r.event_id for r in streamed.collect()) == sorted(
        r.event_id for r in batch.collect()) == ["a-good", "b-good"]
    broken = spark.read.json(out.path("quarantine")).where("unreadable_text IS NOT NULL")
    assert [r.unreadable_text for r in broken.collect()] == ["{broken"]
    metrics = readers.stream_metrics(spark, out.path("metrics")).first()
    assert (metrics.received, metrics.accepted, metrics.quarantined) == (9, 2, 7)
    assert sum(b["rows"] for b in gate_stream.batch_rates(query)) == 9


def test_admission_control_makes_batches(spark, folder):
    _, out, _ = run(spark, folder, [[line({"event_id": f"e{n}"})] for n in range(3)], 1)
    assert readers.stream_metrics(spark, out.path("metrics")).count() == 3
    assert gate_stream.validated_table(spark, out).select("batch_id").distinct().count() == 3


def test_replayed_batch_is_written_once(spark, folder):
    inbox = drop_files(f"{folder}/inbox", [[line(r) for r in gate_set()]])
    batch = readers.telemetry_files(spark, inbox)
    out = gate_stream.GateSinks(f"{folder}/out")
    for _ in range(2):
        gate_stream.process_batch(batch, 5, out)
    assert gate_stream.validated_table(spark, out).count() == 2
    assert spark.read.json(out.path("quarantine")).count() == 6
    assert readers.stream_metrics(spark, out.path("metrics")).count() == 1


def test_published_rows_are_encoded_once(spark, folder):
    inbox = drop_files(f"{folder}/inbox", [[line(r) for r in gate_set()]])
    sent = {}
    out = gate_stream.GateSinks(
        f"{folder}/out", lambda name, rows: sent.update({name: (rows.columns, rows.collect())}))
    gate_stream.process_batch(readers.telemetry_files(spark, inbox), 1, out)
    assert {name: len(rows) for name, (_, rows) in sent.items()} == {
        "quarantine": 6, "predictions": 2}
    columns, rows = sent["predictions"]
    assert columns == ["key", "value"]
    assert {json.loads(r.value)["event_id"] for r in rows} == {"a-good", "b-good"}
    assert {r.key for r in rows} == {json.loads(r.value)["server_id"] for r in rows}


def collect_stream(spark, frame, folder, mode="append"):
    seen = []
    query = (frame.writeStream.outputMode(mode)
             .foreachBatch(lambda b, n: seen.extend(r.asDict() for r in b.collect()))
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert query.exception() is None
    return seen


def test_repeat_in_a_later_batch_is_flagged(spark, folder):
    inbox = drop_files(f"{folder}/inbox", [
        [line({"event_id": "a"}), line({"event_id": "b"}), line({"event_id": None})],
        [line({"event_id": "a"}), line({"event_id": "c"}), line({"event_id": None})]])
    flagged = state.flag_repeats(readers.telemetry_inbox(spark, inbox, 1))
    rows = collect_stream(spark, flagged, folder)
    assert sorted((r["event_id"] or "", r[state.REPEAT_SEEN]) for r in rows) == [
        ("", False), ("", False), ("a", False), ("a", True), ("b", False), ("c", False)]


def test_repeats_can_be_dropped(spark, folder):
    inbox = drop_files(f"{folder}/inbox", [[line({"event_id": "a"})], [line({"event_id": "a"})]])
    rows = collect_stream(
        spark, state.drop_repeats(readers.telemetry_inbox(spark, inbox, 1)), folder)
    assert len(rows) == 1


def test_windows_on_a_stream_equal_batch(spark, folder):
    at = BASE["event_time"]
    rows = [line({"event_id": str(n), "event_time": at + dt.timedelta(minutes=n)})
            for n in range(30)]
    inbox = drop_files(f"{folder}/inbox", [rows[:20], rows[20:]])
    streamed = collect_stream(spark, state.windowed_workload(
        state.drop_repeats(readers.telemetry_inbox(spark, inbox, 1)), lateness=None), folder)
    batch = {r.window_start: r.records for r in workload.window_aggregate(
        readers.telemetry_files(spark, inbox)).collect()}
    assert len(streamed) >= 3
    for row in streamed:
        assert batch[row["window_start"]] == row["records"]


def test_message_parsing_keeps_raw_text(spark):
    messages = spark.createDataFrame(
        [(bytearray(line({"event_id": "a"}).encode()), 0, 1), (bytearray(b"{nope"), 0, 2)],
        "value BINARY, partition INT, offset BIGINT").withColumn(
            "timestamp", F.current_timestamp())
    rows = {r.kafka_offset: r for r in readers.parse_messages(messages).collect()}
    assert rows[1].event_id == "a" and rows[1].cpu_util_pct == BASE["cpu_util_pct"]
    assert rows[2].raw_json == "{nope" and rows[2][readers.CORRUPT] == "{nope"


def later(minutes, **row):
    return line({"event_time": BASE["event_time"] + dt.timedelta(minutes=minutes),
                 "ingest_time": BASE["ingest_time"] + dt.timedelta(minutes=minutes), **row})


def test_repeat_two_hours_and_two_batches_later_is_quarantined(spark, folder):
    """Stream and batch agree over three batches, and a replay changes nothing."""
    batches = [[later(0, event_id="a"), later(0, event_id="b"), later(0, event_id="c")],
               [later(60, event_id="d"), later(60, event_id="d", source_sequence=2)],
               [later(120, event_id="a", source_sequence=7), later(120, event_id="e"),
                later(120, event_id=None)]]
    inbox, out, _ = run(spark, folder, batches, 1)

    def answer():
        return (sorted((r.event_id, r.batch_id) for r in gate_stream.validated_table(
                    spark, out).collect()),
                sorted((r.event_id or "", r.quality_failure_type) for r in spark.read.json(
                    out.path("quarantine")).collect()))

    accepted, rejected = answer()
    assert accepted == [("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 2)]
    assert rejected == [("", "missing_required_field"), ("a", "duplicate_event"),
                        ("d", "duplicate_event")]
    whole = quality.classify_quality(readers.telemetry_files(spark, inbox))
    assert sorted(r.event_id for r in quality.accepted(whole).collect()) == [n for n, _ in accepted]
    for replayed in (2, 0):
        batch = readers.telemetry_files(spark, f"{inbox}/batch-{replayed:03d}.json")
        gate_stream.process_batch(batch, replayed, out)
        assert answer() == (accepted, rejected)


def test_ids_are_kept_for_as_many_days_as_asked(spark, folder):
    out = gate_stream.GateSinks(f"{folder}/out", keep_days=2)
    day = 24 * 60
    batches = [[later(0, event_id="old"), later(3 * day, event_id="new")],
               [later(4 * day, event_id="old"), later(4 * day, event_id="new")]]
    inbox = drop_files(f"{folder}/inbox", batches)
    for n in range(2):
        gate_stream.process_batch(readers.telemetry_files(
            spark, f"{inbox}/batch-{n:03d}.json"), n, out)
    assert sorted((r.event_id, r.batch_id) for r in gate_stream.validated_table(
        spark, out).collect()) == [("new", 0), ("old", 0), ("old", 1)]


def test_metric_row_counts_what_was_written(spark, folder):
    inbox = drop_files(f"{folder}/inbox", [[line(r) for r in gate_set()]])
    out = gate_stream.GateSinks(f"{folder}/out")
    gate_stream.process_batch(readers.telemetry_files(spark, inbox), 3, out)
    metrics = readers.stream_metrics(spark, out.path("metrics")).first()
    assert (metrics.batch_id, metrics.received, metrics.accepted, metrics.quarantined) == (
        3, 8, 2, 6)
    assert gate_stream.validated_table(spark, out).count() == metrics.accepted


def test_replayed_batch_publishes_once(spark, folder):
    """One document and one message per event in every kind of sink."""
    inbox = drop_files(f"{folder}/inbox", [[line(r) for r in gate_set()]])
    sent = []
    out = gate_stream.GateSinks(
        f"{folder}/out", lambda name, rows: sent.extend((name, r.value) for r in rows.collect()),
        ("parquet", {"path": f"{folder}/documents"}), f"{folder}/logs")
    for _ in range(3):
        gate_stream.process_batch(readers.telemetry_files(spark, inbox), 4, out)
    assert sorted(name for name, _ in sent) == ["predictions"] * 2 + ["quarantine"] * 6
    assert spark.read.parquet(f"{folder}/documents").count() == 2
    logged = message_log.messages(spark, f"{folder}/logs/predictions").collect()
    assert {json.loads(r.value)["event_id"] for r in logged} == {"a-good", "b-good"}
    assert len(logged) == 2 and message_log.messages(
        spark, f"{folder}/logs/quarantine").count() == 6


def test_message_log_addresses_offsets(spark, folder):
    log = f"{folder}/log"
    for n in range(3):
        rows = spark.range(n * 100, n * 100 + 100).selectExpr(
            "IF(id % 10 = 0, NULL, CONCAT('k', id % 7)) AS key", "CAST(id AS STRING) AS value")
        message_log.append(rows.repartition(3), log, f"batch-{n}")
        message_log.append(rows, log, f"batch-{n}")
    found = message_log.messages(spark, log).collect()
    assert sorted(int(r.value) for r in found) == list(range(300))
    partitions = {}
    for r in found:
        partitions.setdefault(r.partition, []).append(r.offset)
        assert r.key is not None or r.partition == 0
    assert all(sorted(own) == list(range(len(own))) for own in partitions.values())
    assert len({(r.key, r.partition) for r in found if r.key}) == 7
    end = message_log.ends(message_log.Storage(log).manifests())
    assert sum(end.values()) == 300


def test_gate_over_a_message_log_with_restarts(spark, folder):
    """Three runs from one checkpoint, a capped number of messages each, nothing lost or doubled."""
    log = f"{folder}/log"
    lines = [later(n, event_id=f"e{n % 20}", source_sequence=n) for n in range(24)] + ["{broken"]
    for n in range(0, 25, 5):
        message_log.append(spark.createDataFrame(
            [(f"k{m % 3}", text) for m, text in enumerate(lines[n:n + 5])],
            "key STRING, value STRING"), log, str(n))
    out, batches = gate_stream.GateSinks(f"{folder}/out"), []
    for _ in range(4):
        source = readers.parse_messages(message_log.message_stream(
            spark, log, f"{folder}/consumer", 10))
        query = gate_stream.run_gate(source, out, f"{folder}/checkpoint", every=None)
        query.awaitTermination(240)
        assert query.exception() is None
        batches += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    metrics = readers.stream_metrics(spark, out.path("metrics")).collect()
    assert sum(m.received for m in metrics) == 25 and len(metrics) >= 3
    assert max(m.received for m in metrics) <= 20
    assert sorted(r.event_id for r in gate_stream.validated_table(spark, out).collect()) == sorted(
        f"e{n}" for n in range(20))
    rejected = spark.read.json(out.path("quarantine"))
    assert rejected.where("quality_failure_type LIKE '%duplicate_event%'").count() == 4
    assert rejected.where("unreadable_text IS NOT NULL").count() == 1


def test_inbox_of_more_rows_has_more_files_and_three_batches(spark, monkeypatch):
    table = Tables(spark, "/root/testdata/sf0.001")
    rows, seen = table.telemetry().count(), []
    monkeypatch.setattr(roundtrip, "INBOX_ROWS", rows // 10)
    read = readers.telemetry_inbox
    monkeypatch.setattr(roundtrip.readers, "telemetry_inbox", lambda s, path, most: seen.append(
        (len(glob.glob(f"{path}/*.json")), most)) or read(s, path, most))
    assert roundtrip.stream_outcome(table).count() == rows
    assert seen == [(12, 4)]
