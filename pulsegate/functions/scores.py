"""Scalar column functions: risk, routing, penalties, labels and ratios."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Intercept and weights of the transparent risk score.
RISK_INTERCEPT = -6.0
RISK_WEIGHTS = {"cpu_util_pct": 0.035, "memory_util_pct": 0.018, "response_p95_ms": 0.003,
                "error_rate": 7.0, "queue_depth": 0.025}
RISK_ALERT = 0.5

# Task classes of the router.
STREAM_TASKS = ["health_monitor", "incident_response", "incident_enrichment"]
BATCH_TASKS = ["capacity_analytics", "model_feedback", "audit_compaction"]
TIGHT_SLA_MS = 1000


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def risk_probability() -> Column:
    terms = " + ".join(f"{name} * {weight}D" for name, weight in RISK_WEIGHTS.items())
    return F.expr(f"1.0D / (1.0D + exp(-({RISK_INTERCEPT}D + {terms})))")


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL when the whole is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(share(part, whole), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    """Value within [low, high]; NULL stays NULL, which least and greatest alone would skip."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def count_of(condition: Column) -> Column:
    """Number of rows where the condition is TRUE (0 on empty input)."""
    return F.count_if(condition)


def epoch_micros(name: str) -> Column:
    """Microseconds since the epoch for either timestamp type (UTC session)."""
    return F.unix_micros(F.col(name).cast("timestamp"))


# The ordered routing rules, their routes and reasons.
ROUTES = [
    ("lower(coalesce(criticality, '')) = 'high'",
     "R1_HIGH_CRITICALITY", "stream", "high criticality requires immediate analysis"),
    (f"latency_sla_ms <= {TIGHT_SLA_MS}",
     "R2_TIGHT_SLA", "stream", "latency SLA is at most 1000 ms"),
    (f"task_type IN {tuple(STREAM_TASKS)}",
     "R3_STREAM_TASK", "stream", "task type is latency sensitive"),
    (f"task_type IN {tuple(BATCH_TASKS)}",
     "R4_DELAY_TOLERANT", "batch", "task type permits deferred execution"),
    ("true", "R5_DEFAULT_BATCH", "batch", "no stream rule matched"),
]


def route_rule() -> Column:
    """Number of the first routing rule that applies, from 1."""
    cases = " ".join(f"WHEN {rule[0]} THEN {n}" for n, rule in enumerate(ROUTES, start=1))
    return F.expr(f"CASE {cases} END")


def route_detail(number: str, position: int) -> Column:
    """Rule id (1), route (2) or reason (3) of the routing rule with that number."""
    values = ", ".join(f"'{rule[position]}'" for rule in ROUTES)
    return F.expr(f"elt({number}, {values})")


def asymmetric_penalty(error: Column) -> Column:
    """Late predictions (error > 0) cost more than early ones."""
    return F.expm1(F.when(error < 0, -error / 13.0).otherwise(error / 10.0))


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Two-sided asymptotic p-value of the two-sample KS statistic; 1 when D is 0."""
    effective = F.try_divide(n.cast("double") * m, n + m)
    root = F.sqrt(effective)
    scaled = (root + 0.12 + F.try_divide(F.lit(0.11), root)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 2.0).otherwise(-2.0)
        * F.exp(-2.0 * k * k * scaled * scaled))
    return F.when(d == 0, 1.0).otherwise(clamp(series, 0.0, 1.0))


def rul_band(rul: Column) -> Column:
    return (F.when(rul <= 30, "0-30").when(rul <= 60, "31-60")
            .when(rul <= 120, "61-120").otherwise("121+"))


def hash_unit(name: str) -> Column:
    """Stable pseudo-random number in [0, 1) from a key, the same on every run."""
    return F.pmod(F.xxhash64(name), F.lit(1_000_000)) / 1_000_000.0


def hex_digit(name: str, position: int = 1) -> Column:
    """One md5 hex digit of a key as 0..15; portable to engines without xxhash64."""
    digit = F.substring(F.md5(F.col(name).cast("string")), position, 1)
    return F.conv(digit, 16, 10).cast("int")
