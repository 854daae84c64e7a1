"""The quality rules as data: category, rule id and the condition under which it fires.

A rule fires only when its condition is TRUE; NULL means it does not fire.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from pulsegate.schema import GATE_REQUIRED

REPEAT_FLAG = "_is_repeat"


class Rule(NamedTuple):
    category: str
    rule_id: str
    condition: str

    def fires(self) -> Column:
        return F.expr(self.condition)


def _any_null(names: list[str]) -> str:
    return " OR ".join(f"{name} IS NULL" for name in names)


# Rule ids, categories, bounds and their order.
RULES = [
    Rule("schema", "unsupported_schema", "schema_version NOT IN (1, 2)"),
    Rule("schema", "v2_required_field_missing",
         f"schema_version = 2 AND ({_any_null(['cache_hit_ratio', 'gc_pause_ms'])})"),
    Rule("range", "cpu_out_of_range", "cpu_util_pct NOT BETWEEN 0 AND 100"),
    Rule("range", "memory_out_of_range", "memory_util_pct NOT BETWEEN 0 AND 100"),
    Rule("range", "disk_out_of_range", "disk_util_pct NOT BETWEEN 0 AND 100"),
    Rule("range", "error_rate_out_of_range", "error_rate NOT BETWEEN 0 AND 1"),
    Rule("range", "timeout_rate_out_of_range", "timeout_rate NOT BETWEEN 0 AND 1"),
    Rule("range", "negative_queue_depth", "queue_depth < 0"),
    Rule("range", "cache_hit_out_of_range",
         "schema_version = 2 AND cache_hit_ratio NOT BETWEEN 0 AND 1"),
    Rule("temporal", "ingest_before_event", "ingest_time < event_time"),
    Rule("temporal", "event_too_late", "ingest_time > event_time + INTERVAL '10' MINUTE"),
    Rule("completeness", "missing_required_field", _any_null(GATE_REQUIRED)),
    Rule("completeness", "duplicate_event", REPEAT_FLAG),
    Rule("cross_field", "p95_below_p50", "response_p95_ms < response_p50_ms"),
    Rule("cross_field", "timeout_exceeds_error_rate", "timeout_rate > error_rate + 1e-9D"),
    Rule("cross_field", "negative_active_connections", "active_connections < 0"),
]


def fired_rules(rules: list[Rule]) -> Column:
    """Ids of the rules that fire, in rule order."""
    cases = ", ".join(f"CASE WHEN {r.condition} THEN '{r.rule_id}' END" for r in rules)
    return F.expr(f"array_compact(array({cases}))")


def fired_categories(fired: str, rules: list[Rule]) -> Column:
    """Distinct categories behind an array column of fired rule ids, in category order."""
    members: dict[str, list[str]] = {}
    for rule in rules:
        members.setdefault(rule.category, []).append(f"'{rule.rule_id}'")
    cases = ", ".join(
        f"CASE WHEN arrays_overlap({fired}, array({', '.join(ids)})) THEN '{category}' END"
        for category, ids in members.items())
    return F.expr(f"array_compact(array({cases}))")
