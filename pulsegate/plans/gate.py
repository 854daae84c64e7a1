"""Queries over the quality gate: Q1-Q21, A1-A4, U5, S2, S11, K4."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegate.functions.gate_rules import REPEAT_FLAG, RULES
from pulsegate.operators import quality
from pulsegate.operators.routing import routing_losses as row_losses
from pulsegate.plans.common import classified
from pulsegate.plans.registry import RULE_SQL, query
from pulsegate.plans.views import Tables
from pulsegate.sources import readers, registry as schema_registry, sinks

ROW_KEY = ["event_id", "source_sequence"]


def _register_rule(number: int, rule) -> None:
    short = rule.rule_id
    view = "ranked" if short == "duplicate_event" else "telemetry"
    sql = f"SELECT event_id, source_sequence FROM {view} WHERE {RULE_SQL[short]}"

    def build(t: Tables):
        frame = t.telemetry()
        if short == "duplicate_event":
            frame = quality.mark_repeats(frame)
        return frame.where(rule.fires()).select(*ROW_KEY)

    query(f"q{number}_{short}", sql, (view,))(build)


for _number, _rule in enumerate(RULES, start=1):
    _register_rule(_number, _rule)


@query("q13_duplicate_event_two_pass",
       f"SELECT event_id, source_sequence FROM ranked WHERE {RULE_SQL['duplicate_event']}",
       ("ranked",))
def duplicate_event_two_pass(t):
    """The same rows when they arrive in another partitioning."""
    return (quality.mark_repeats(t.telemetry().repartition(7)).where(REPEAT_FLAG)
            .select(*ROW_KEY))


@query("q17_rule_evidence", """
    SELECT event_id, source_sequence, reasons AS quality_failure_type, categories,
      CAST(rule_count AS INT) AS quality_rule_count FROM classified""", ("classified",))
def rule_evidence(t):
    return classified(t).select(
        *ROW_KEY, "quality_failure_type",
        F.concat_ws("|", "detected_defect_categories").alias("categories"),
        "quality_rule_count")


@query("q18_quality_action", """
    SELECT event_id, source_sequence, is_valid,
      CASE WHEN is_valid THEN 'accept' ELSE 'quarantine' END AS quality_action,
      COALESCE(ingest_time > event_time + INTERVAL '10' MINUTE, FALSE) AS late_event_flag,
      CAST(event_time AS DATE) AS event_date FROM classified""", ("classified",))
def quality_action(t):
    return classified(t).select(*ROW_KEY, "is_valid", "quality_action", "late_event_flag",
                                "event_date")


@query("q19_quarantine_split", """
    SELECT 'accepted' AS side, event_id, source_sequence FROM classified WHERE is_valid
    UNION ALL
    SELECT 'quarantined', event_id, source_sequence FROM classified WHERE NOT is_valid""",
       ("classified",))
def quarantine_split(t):
    frame = classified(t)
    return (quality.accepted(frame).select(F.lit("accepted").alias("side"), *ROW_KEY)
            .unionByName(quality.quarantined(frame)
                         .select(F.lit("quarantined").alias("side"), *ROW_KEY)))


_V1 = ["event_id", "event_time", "ingest_time", "schema_version", "data_center_id", "rack_id",
       "server_id", "service_name", "cpu_util_pct", "memory_util_pct", "disk_util_pct",
       "disk_iops", "disk_queue_depth", "network_in_mbps", "network_out_mbps",
       "request_rate_rps", "response_p50_ms", "response_p95_ms", "error_rate", "timeout_rate",
       "queue_depth", "active_connections", "software_version", "config_version"]


def _absent(names):
    cases = ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in names)
    return f"concat_ws('|', {cases})"


@query("q20_registry_check", f"""
    SELECT event_id, source_sequence, schema_version IN (1, 2) AS registered,
      CASE WHEN schema_version = 1 THEN {_absent(_V1)}
           WHEN schema_version = 2 THEN {_absent(_V1 + ["cache_hit_ratio", "gc_pause_ms"])}
           ELSE '' END AS missing_keys
    FROM telemetry""", ("telemetry",))
def registry_check(t):
    raw = readers.as_raw_json(t.telemetry(), [*ROW_KEY, "schema_version"])
    checked = quality.registry_gaps(raw, schema_registry.registry_table(t.spark))
    return checked.select(*ROW_KEY, "registered",
                          F.concat_ws("|", "missing_keys").alias("missing_keys"))


_CONTRACT = ["event_id", "event_time", "ingest_time", "schema_version", "server_id",
             "cpu_util_pct", "memory_util_pct", "response_p95_ms", "error_rate", "queue_depth",
             "failure_within_30min", "is_injected_defect", "expected_quality_action",
             "duplicate_ordinal", "task_type", "criticality", "latency_sla_ms",
             "expected_route", "workload_units", "source_sequence"]
_TRUTH = ", ".join(
    f"count(*) FILTER (WHERE is_injected_defect AND injected_defect_category = '{c}')"
    f" AS truth_{c}"
    for c in ("schema", "range", "temporal", "completeness", "cross_field"))


@query("q21_contract_check", f"""
    SELECT *, "rows" > 0 AND schema_v1 > 0 AND schema_v2 > 0 AND route_stream > 0
      AND route_batch > 0 AND truth_schema > 0 AND truth_range > 0 AND truth_temporal > 0
      AND truth_completeness > 0 AND truth_cross_field > 0
      AND invalid_quality_action = 0 AND invalid_route = 0 AS passed
    FROM (SELECT count(*) AS "rows",
      count(*) FILTER (WHERE schema_version = 1) AS schema_v1,
      count(*) FILTER (WHERE schema_version = 2) AS schema_v2,
      count(*) FILTER (WHERE {" OR ".join(f"{n} IS NULL" for n in _CONTRACT)})
        AS missing_required,
      count(*) FILTER (WHERE schema_version = 2
        AND (cache_hit_ratio IS NULL OR gc_pause_ms IS NULL)) AS v2_missing_extension,
      count(*) FILTER (WHERE NOT COALESCE(cpu_util_pct BETWEEN 0 AND 100, FALSE))
        AS invalid_cpu,
      CAST(sum(failure_within_30min) AS BIGINT) AS positive_labels,
      count(*) FILTER (WHERE COALESCE(expected_quality_action, '')
        NOT IN ('accept', 'quarantine')) AS invalid_quality_action,
      count(*) FILTER (WHERE COALESCE(expected_route, '') NOT IN ('stream', 'batch'))
        AS invalid_route,
      {_TRUTH},
      count(*) FILTER (WHERE expected_route = 'stream') AS route_stream,
      count(*) FILTER (WHERE expected_route = 'batch') AS route_batch
      FROM telemetry)""", ("telemetry",))
def contract_check(t):
    return quality.contract_report(readers.as_raw_json(t.telemetry(), []))


@query("s2_parse_json", """
    SELECT event_id, props AS raw_json, CAST(json_extract(props, '$.k') AS BIGINT) AS k
    FROM events""")
def parse_json(t):
    messages = t.table("events").select(
        F.col("event_id"), F.col("props").cast("binary").alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"))
    parsed = readers.parse_messages(messages, "k BIGINT")
    return parsed.select(F.col("kafka_offset").alias("event_id"), "raw_json", "k")


@query("s11_schema_registry", """
    SELECT schema_version, count(*) AS "rows",
      max(CASE schema_version WHEN 1 THEN 24 WHEN 2 THEN 26 END) AS required_fields
    FROM telemetry GROUP BY schema_version""", ("telemetry",))
def registry_versions(t):
    counts = t.telemetry().groupBy("schema_version").agg(F.count("*").alias("rows"))
    versions = schema_registry.registry_table(t.spark).select(
        F.col("version").alias("schema_version"), F.size("required").alias("required_fields"))
    return counts.join(versions, "schema_version", "left")


@query("k4_message_encoding")
def message_encoding(t):
    return sinks.as_messages(t.telemetry())


@query("a1_batch_counters", """
    SELECT count(*) AS received, count(*) FILTER (WHERE is_valid) AS accepted,
      count(*) FILTER (WHERE NOT is_valid) AS quarantined FROM classified""", ("classified",))
def batch_counters(t):
    return quality.batch_counters(classified(t))


@query("a2_detection_report", """
    SELECT *, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall,
      round(tn / (tn + fp), 6) AS clean_record_preservation
    FROM (SELECT count(*) AS received, count(*) FILTER (WHERE is_valid) AS accepted,
      count(*) FILTER (WHERE NOT is_valid) AS quarantined,
      count(*) FILTER (WHERE is_injected_defect) AS injected_defects,
      count(*) FILTER (WHERE is_injected_defect AND NOT is_valid) AS tp,
      count(*) FILTER (WHERE NOT is_injected_defect AND NOT is_valid) AS fp,
      count(*) FILTER (WHERE is_injected_defect AND is_valid) AS fn,
      count(*) FILTER (WHERE NOT is_injected_defect AND is_valid) AS tn
      FROM classified)""", ("classified",))
def detection_report(t):
    ratios = ["precision", "recall", "clean_record_preservation"]
    report = quality.quality_report(classified(t))
    return report.withColumns({name: F.round(name, 6) for name in ratios})


_CATEGORY_SQL = """
    SELECT category, truth_count, tp, fp, fn,
      round(COALESCE(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
      round(COALESCE(tp / nullif(tp + fn, 0), 0), 6) AS recall
    FROM (SELECT category, count(*) FILTER (WHERE truth) AS truth_count,
      count(*) FILTER (WHERE truth AND caught) AS tp,
      count(*) FILTER (WHERE NOT truth AND caught) AS fp,
      count(*) FILTER (WHERE truth AND NOT caught) AS fn
      FROM (SELECT c.category, {truth} AS truth,
              list_contains(string_split(k.categories, '|'), c.category) AS caught
            FROM classified k CROSS JOIN (VALUES ('schema'), ('range'), ('temporal'),
              ('completeness'), ('cross_field')) c(category))
      GROUP BY category)"""


def _category_rounded(frame):
    return frame.withColumns({"precision": F.round("precision", 6),
                              "recall": F.round("recall", 6)})


@query("a3_category_detection", _CATEGORY_SQL.format(
    truth="COALESCE(k.injected_defect_category = c.category, FALSE)"), ("classified",))
def category_detection(t):
    return _category_rounded(quality.category_report(classified(t)))


@query("a3_category_detection_legacy", _CATEGORY_SQL.format(
    truth="(k.injected_defect_category = c.category)"), ("classified",))
def category_detection_legacy(t):
    return _category_rounded(quality.category_report(classified(t), legacy_nulls=True))


@query("a4_rule_counts", """
    SELECT rule_id, count(*) AS failures
    FROM (SELECT unnest(string_split(reasons, '|')) AS rule_id FROM classified
          WHERE NOT is_valid) GROUP BY rule_id""", ("classified",))
def rule_counts(t):
    return quality.rule_counts(classified(t))


@query("u5_gate_lossless", """
    SELECT count(*) AS received, CAST(0 AS BIGINT) AS lost,
      CAST(0 AS BIGINT) AS added FROM telemetry""", ("telemetry",))
def gate_lossless(t):
    received = t.telemetry().select(*ROW_KEY)
    judged = classified(t)
    kept = (quality.accepted(judged).select(*ROW_KEY)
            .unionByName(quality.quarantined(judged).select(*ROW_KEY)))
    return row_losses(received, kept, ROW_KEY).select(
        F.col("accepted_rows").alias("received"), F.col("lost_rows").alias("lost"),
        F.col("added_rows").alias("added"))
