"""Scenario configuration: parameters and small window tables, validated on the driver."""
from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegate.schema import QUALITY_CATEGORIES

# Supported scenarios.
SCENARIOS = [
    "covariate_shift_v1",
    "concept_drift_v2",
    "concept_drift_30d_v3",
    "concept_drift_30d_v4",
]


@dataclass
class Scenario:
    name: str
    start_time: str
    days: int
    interval_minutes: int
    logical_servers: int
    schema_v2_start_day: int
    drift_start_day: int
    drift_transition_days: int
    horizon_minutes: int
    precursor_minutes: int
    defect_rates: dict[str, float]
    burst_windows: list[dict] = field(default_factory=list)
    incident_windows: list[dict] = field(default_factory=list)
    experiment_windows: dict = field(default_factory=dict)
    history_features: bool = False
    feedback_split_key: str = "event_id"

    def check(self) -> "Scenario":
        positive = ("days", "interval_minutes", "logical_servers", "horizon_minutes",
                    "precursor_minutes")
        problems = [f"{name} must be positive" for name in positive if getattr(self, name) <= 0]
        if self.name not in SCENARIOS:
            problems.append(f"unsupported scenario {self.name}")
        for name in ("schema_v2_start_day", "drift_start_day"):
            if not 1 <= getattr(self, name) <= self.days:
                problems.append(f"{name} lies outside the experiment")
        if self.drift_transition_days < 0:
            problems.append("drift_transition_days cannot be negative")
        unknown = set(self.defect_rates) - set(QUALITY_CATEGORIES)
        if unknown:
            problems.append(f"unsupported quality categories {sorted(unknown)}")
        rates = list(self.defect_rates.values())
        if any(rate < 0 for rate in rates) or sum(rates) >= 1:
            problems.append("defect rates must be non-negative and sum to less than one")
        if problems:
            raise ValueError("; ".join(problems))
        return self

    def drift_days(self) -> tuple[list[int], list[int]]:
        windows = self.experiment_windows
        return (windows.get("drift_reference", [1, 3]), windows.get("drift_current", [5, 7]))

def scenario_from(text: str) -> Scenario:
    """Scenario from its JSON text; defect rates fall back to the two older rate fields."""
    raw = json.loads(text)
    rates = raw.get("quality_defect_rates")
    if rates is None:
        half = float(raw["quality_error_rate"]) / 2
        rates = {"range": half, "completeness": half, "temporal": float(raw["late_event_rate"])}
    return Scenario(
        name=raw.get("scenario", SCENARIOS[0]), start_time=raw["start_time"],
        days=int(raw["days"]), interval_minutes=int(raw["sample_interval_minutes"]),
        logical_servers=int(raw["logical_servers"]),
        schema_v2_start_day=int(raw["schema_v2_start_day"]),
        drift_start_day=int(raw["drift_start_day"]),
        drift_transition_days=int(raw.get("drift_transition_days", 0)),
        horizon_minutes=int(raw["failure_horizon_minutes"]),
        precursor_minutes=int(raw.get("precursor_window_minutes", 90)),
        defect_rates={k: float(v) for k, v in rates.items()},
        burst_windows=list(raw.get("burst_windows", [])),
        incident_windows=list(raw.get("incident_windows", [])),
        experiment_windows=dict(raw.get("experiment_windows", {})),
        history_features=bool(raw.get("history_features", False)),
        feedback_split_key=raw.get("feedback_split_key", "event_id")).check()


def load_scenario(spark: SparkSession, path: str) -> Scenario:
    """Read one configuration file from any file system Spark can reach."""
    return scenario_from(spark.read.text(path, wholetext=True).first()["value"])
