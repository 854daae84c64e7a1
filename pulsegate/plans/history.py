"""Queries on rolling features, days, splits and samples: W5-W8, P0-P12, U1, U2, U4, A23, A30."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegate.functions.scores import hex_digit
from pulsegate.operators import features, splits
from pulsegate.plans.common import accepted, rounded, scored, split_rows
from pulsegate.plans.registry import query
from pulsegate.plans.views import WINDOWS
from pulsegate.schema import BASE_FEATURES, TARGET

KEY = ["event_id", "source_sequence"]
DAY = 86_400
SHORT, LONG = DAY, 3 * DAY


def _over(expression: str, seconds: int) -> str:
    return (f"{expression} OVER (PARTITION BY server_id ORDER BY "
            f"CAST(floor(epoch(event_time)) AS BIGINT) "
            f"RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)")


def _register_rolling(key: str, names: list[str]) -> None:
    parts = []
    for name in names:
        how, source, span = features.ROLLING[name]
        width = SHORT if span == "short" else LONG
        function = "max" if how == "max" else "avg"
        parts.append(f"round({_over(f'{function}({source})', width)}, 6) AS {name}")
    sql = f"SELECT event_id, source_sequence, {', '.join(parts)} FROM accepted"

    def build(t):
        rolled = features.rolling_features(accepted(t), names, SHORT, LONG)
        return rounded(rolled.select(*KEY, *names), *names)

    query(key, sql, ("accepted",))(build)


_register_rolling("w5_rolling_5m", ["error_rate_mean_5m", "response_p95_mean_5m"])
_register_rolling("w6_rolling_15m", [
    "error_rate_mean_15m", "response_p95_mean_15m", "timeout_rate_mean_15m",
    "queue_depth_mean_15m", "cpu_util_mean_15m"])
_register_rolling("w7_rolling_max", ["error_rate_max_15m"])


@query("w8_rolling_delta", f"""
    SELECT event_id, source_sequence,
      round(error_rate - {_over('avg(error_rate)', LONG)}, 6) AS error_rate_delta_15m,
      round(response_p95_ms - {_over('avg(response_p95_ms)', LONG)}, 6)
        AS response_p95_delta_15m FROM accepted""", ("accepted",))
def rolling_delta(t):
    names = list(features.DELTAS)
    frame = features.add_history_features(accepted(t), SHORT, LONG, names)
    # differences of equal numbers may come out as a tiny negative; write zero plainly
    return frame.select(*KEY, *[(F.round(n, 6) + 0.0).alias(n) for n in names])


@query("p0_experiment_day", "SELECT event_id, source_sequence, day FROM scored", ("scored",))
def experiment_day(t):
    return scored(t).select(*KEY, "day")


@query("p1_day_splits", """
    SELECT event_id, split, day BETWEEN 29 AND 30 AS is_recent FROM splits""", ("splits",))
def day_splits(t):
    return split_rows(t).select("event_id", "split", "is_recent")


@query("p3_feedback_split", """
    SELECT event_id, substr(md5(event_id), 1, 1) < 'b' AS for_training FROM splits
    WHERE day BETWEEN 18 AND 21""", ("splits",))
def feedback_split(t):
    return (split_rows(t).where(F.col("split").startswith("feedback"))
            .select("event_id", (F.col("split") == "feedback_train").alias("for_training")))


def _unit(name="event_id"):
    return hex_digit(name, 1) / 16.0 + hex_digit(name, 2) / 256.0


_UNIT = ("((instr('0123456789abcdef', substr(md5(event_id), 1, 1)) - 1) / 16.0E0"
         " + (instr('0123456789abcdef', substr(md5(event_id), 2, 1)) - 1) / 256.0E0)")


@query("p4_keep_positives", f"""
    SELECT event_id, failure_within_30min FROM accepted WHERE failure_within_30min = 1
      OR (failure_within_30min = 0 AND {_UNIT} < 0.08)""", ("accepted",))
def keep_positives(t):
    return splits.keep_positives(accepted(t), unit=_unit()).select("event_id", TARGET)


@query("p5_recency_weight", """
    SELECT event_id, CASE WHEN day BETWEEN 18 AND 21 THEN 4.0E0 ELSE 1.0E0 END
      AS sample_weight FROM scored""", ("scored",))
def recency_weight(t):
    weighted = splits.with_recency_weight(scored(t), WINDOWS["feedback"], 4.0)
    return weighted.select("event_id", "sample_weight")


_FEATURES_WITH_CACHE = [*BASE_FEATURES, "cache_hit_ratio"]


@query("p6_complete_rows", """
    SELECT event_id, source_sequence FROM telemetry WHERE cpu_util_pct IS NOT NULL
      AND memory_util_pct IS NOT NULL AND disk_util_pct IS NOT NULL
      AND response_p50_ms IS NOT NULL AND error_rate IS NOT NULL
      AND cache_hit_ratio IS NOT NULL AND failure_within_30min IS NOT NULL""",
       ("telemetry",))
def complete_rows(t):
    return splits.complete_rows(t.telemetry(), _FEATURES_WITH_CACHE).select(*KEY)


@query("p7_three_way_split", f"""
    SELECT event_id, CASE WHEN {_UNIT} < 0.6 THEN 'train' WHEN {_UNIT} < 0.8
      THEN 'validation' ELSE 'test' END AS part FROM accepted""", ("accepted",))
def three_way_split(t):
    return splits.three_way_split(accepted(t), _unit()).select("event_id", "part")


@query("p8_stratified_folds", """
    SELECT event_id, failure_within_30min, CAST((row_number() OVER (
      PARTITION BY failure_within_30min ORDER BY md5(event_id), event_id) - 1) % 10 AS INT)
      AS fold FROM accepted""", ("accepted",))
def stratified_folds(t):
    return splits.stratified_folds(accepted(t), TARGET, "event_id", 10).select(
        "event_id", TARGET, "fold")


@query("p11_surrogate_id", """
    SELECT event_id, source_sequence, md5(concat_ws(':', 'telemetry', server_id,
      CAST(source_sequence AS VARCHAR))) AS surrogate_id FROM telemetry""", ("telemetry",))
def surrogate_id(t):
    return splits.surrogate_event_id(t.telemetry(), "telemetry", [
        "server_id", "source_sequence"]).select(*KEY, "surrogate_id")


@query("p12_recent_window", "SELECT event_id FROM splits WHERE day BETWEEN 29 AND 30",
       ("splits",))
def recent_window(t):
    return split_rows(t).where("is_recent").select("event_id")


@query("a30_split_counts", """
    SELECT split, count(*) AS "rows", CAST(sum(failure_within_30min) AS BIGINT)
      AS positive_rows FROM splits GROUP BY split""", ("splits",))
def split_counts(t):
    return splits.split_counts(split_rows(t))


@query("a23_split_priors", """
    SELECT split, n AS "rows", positive_rows, round(positive_rows / n, 6) AS positive_rate,
      round((positive_rows / n) / max(CASE WHEN split = 'evaluation'
        THEN positive_rows / n END) OVER (), 6) AS prior_multiple
    FROM (SELECT split, count(*) AS n, CAST(sum(failure_within_30min) AS BIGINT)
      AS positive_rows FROM splits WHERE split IS NOT NULL GROUP BY split)""", ("splits",))
def split_priors(t):
    return rounded(splits.split_priors(split_rows(t)), "positive_rate", "prior_multiple")


@query("u1_adaptive_training", """
    SELECT event_id, split FROM splits WHERE split IN ('pre_drift_train', 'feedback_train')""",
       ("splits",))
def adaptive_training(t):
    return splits.adaptive_training(split_rows(t), True).select("event_id", "split")


@query("u2_drop_repeats", "SELECT DISTINCT event_id FROM telemetry", ("telemetry",))
def drop_repeats(t):
    return t.telemetry().dropDuplicates(["event_id"]).select("event_id")


@query("u4_split_overlap", """
    SELECT count(DISTINCT event_id) AS ids, CAST(0 AS BIGINT) AS ids_in_two_splits FROM splits
    WHERE split IS NOT NULL""", ("splits",))
def split_overlap(t):
    return splits.split_overlap_counts(split_rows(t))
