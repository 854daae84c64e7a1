"""Whole jobs from source to reports, and a command line for them.

    python -m pulsegate.plans.jobs quality --source telemetry/ --out results/
    python -m pulsegate.plans.jobs adaptive --source telemetry/ --config scenario.json --out ...
    python -m pulsegate.plans.jobs rul --train t.txt --test t.txt --labels r.txt --out ...
    python -m pulsegate.plans.jobs horizon --train t.txt --test t.txt --labels r.txt --out ...
    python -m pulsegate.plans.jobs stream --inbox inbox/ --out results/ --checkpoint state/
    python -m pulsegate.plans.jobs stream --kafka host:9092 --topic telemetry --out ...
    python -m pulsegate.plans.jobs stream --log logs/telemetry --publish logs/ --out ...
"""
from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegate.operators import (drift, features, labels, metrics, models, quality, routing,
                                 splits, workload)
from pulsegate.schema import BASE_FEATURES, HISTORY_FEATURES, TRAJECTORY_FEATURES
from pulsegate.session import build_session
from pulsegate.sources import message_log, readers, scenario, sinks
from pulsegate.staging import stage
from pulsegate.streaming import gate_stream


def queue_reports(series: DataFrame, multiplier: float = 1.10) -> dict[str, DataFrame]:
    """Capacity plan and the shared queue: trace, peaks and recovery."""
    timed = stage(workload.with_elapsed(series), "workload-series")
    plan = stage(workload.capacity_plan(timed, multiplier), "capacity-plan")
    if plan.where("capacity IS NOT NULL").isEmpty():
        raise ValueError("no steps outside bursts to derive a capacity from")
    unified = workload.unified_backlog(timed, plan.select("capacity").scalar())
    return {"capacity_plan": plan,
            "queue_peaks": workload.backlog_peaks(unified, "baseline_backlog", "baseline_delay"),
            "queue_recovery": workload.recovery_minutes(unified, "baseline_backlog"),
            "queue_trace": unified.select("event_minute", "baseline_backlog", "baseline_delay")}


def quality_and_routing(source: DataFrame, out: str, width: str = "5 minutes",
                        grain: str = "minute", multiplier: float = 1.10,
                        evidence: bool = True) -> None:
    """Gate, route, compare paths, model the queues, and write reports and evidence."""
    # written once, so that every report reads only the columns it needs
    judged = stage(quality.classify_quality(source), "classified")
    kept = quality.accepted(judged)
    routed = routing.route_tasks(kept)
    reports = {
        "quality": quality.quality_report(judged),
        "quality_categories": quality.category_report(judged),
        "quality_rules": quality.rule_counts(judged),
        "routing": routing.routing_report(routed),
        "routing_losses": routing.routing_losses(kept, routed, ["event_id", "source_sequence"]),
        "paths": workload.path_comparison(routed, width),
        **queue_reports(workload.workload_series(routed, grain), multiplier)}
    trace = reports.pop("queue_trace")
    for name, report in reports.items():
        sinks.write_report(report, f"{out}/reports/{name}")
    sinks.write_trace(trace, f"{out}/queue_trace")
    if evidence:
        sinks.write_accepted_evidence(judged, f"{out}/accepted")
        sinks.write_quarantine_evidence(judged, f"{out}/quarantine")
        sinks.write_routing_audit(routed, f"{out}/routing_audit")


def adaptive_cycle(source: DataFrame, out: str, windows: dict, drift_days: tuple,
                   start: str | None = None, history: bool = True,
                   split_key: str = "event_id", threshold: float = drift.EFFECT_THRESHOLD,
                   alpha: float = drift.ALPHA, recent: int = 2, explain: int | None = None,
                   alerts: int | None = None, **settings) -> None:
    """Accepted rows to drift gate, splits, model variants, alerts and attributions."""
    # the gate leaves one accepted row per id, so no further dedup is needed
    kept = stage(quality.accepted(quality.classify_quality(source)), "accepted")
    if start is None:
        start = str(splits.experiment_origin(kept).first()[0])
    dated = splits.with_experiment_day(kept, start)
    by_feature = stage(drift.ks_by_feature(drift.drift_windows(dated, *drift_days)), "drift")
    gate = drift.drift_gate(by_feature, threshold, alpha)
    sinks.write_report(by_feature, f"{out}/reports/drift_features")
    sinks.write_report(gate, f"{out}/reports/drift")
    detected = bool(gate.first()["drift_detected"])

    names = BASE_FEATURES + (HISTORY_FEATURES if history else [])
    rows = features.add_history_features(dated) if history else dated
    labelled = splits.with_split(rows, windows, recent, split_key=split_key)
    run = models.AdaptiveRun(labelled, windows, detected, names, **settings)
    sinks.write_report(splits.split_priors(run.rows), f"{out}/reports/splits")
    sinks.write_report(run.variant_report(), f"{out}/reports/variants")
    sinks.write_report(run.stability(), f"{out}/reports/stability")
    sinks.write_report(metrics.evaluation_by(run.evaluated()), f"{out}/reports/evaluation")
    curve = metrics.threshold_curve(metrics.score_points(run.evaluated(), "p_adaptive"))
    sinks.write_report(metrics.downsample_curve(curve), f"{out}/reports/threshold_curve")
    sinks.write_artefact(run.health_snapshot(), f"{out}/server_health_snapshot", True)
    sinks.write_artefact(run.threshold_alerts(alerts), f"{out}/threshold_alerts", True)
    sinks.write_artefact(run.explanations(explain), f"{out}/alert_attributions", True)
    models.save_model(run.adaptive, out, "adaptive")


def remaining_life(train: DataFrame, test: DataFrame, truth: DataFrame, out: str,
                   model: str = "linear", cap: float = 125.0, **settings) -> None:
    """Fit on run-to-failure units, score the last cycle of each test unit.

    Raises when test units and labels do not match one to one.
    """
    capped = truth.withColumn("actual_rul", F.least("actual_rul", F.lit(cap)))
    unmatched = labels.unmatched_units(test, capped)
    if not unmatched.isEmpty():
        raise ValueError(f"units and labels differ, e.g. {unmatched.first()}")
    prepared = stage(labels.life_target(train, cap), "rul-train")
    pipeline = (models.linear_rul(TRAJECTORY_FEATURES) if model == "linear"
                else models.boosted_rul(TRAJECTORY_FEATURES, **settings))
    fitted = pipeline.fit(prepared)
    predicted = models.predict_rul(fitted, labels.at_last_cycle(test), ["unit_id"])
    errors = stage(labels.rul_errors(predicted, capped), "rul-errors")
    sinks.write_artefact(errors, f"{out}/{model}/predictions", True)
    sinks.write_report(labels.regression_report(errors), f"{out}/{model}/metrics")


def failure_horizon(train: DataFrame, test: DataFrame, truth: DataFrame, out: str,
                    horizon: int = 30, folds: int = 10, forest: dict | None = None,
                    boosted: dict | None = None, grid: list[float] | None = None) -> None:
    """Three classifiers on the same rows, label, features and threshold."""
    rul = truth.select("unit_id", F.col("actual_rul").cast("bigint")
                       .alias("rul_at_final_cycle"))
    key = F.concat_ws("-", "unit_id", "cycle")
    fitting = stage(splits.stratified_folds(
        labels.horizon_target(train, horizon).withColumn("row_key", key),
        labels.HORIZON_LABEL, "row_key", folds), "horizon-train")
    held = stage(labels.horizon_target(test, horizon, rul), "horizon-test")
    for name, frame in (("train", fitting), ("test", held)):
        sinks.write_report(labels.label_distribution(frame), f"{out}/distribution/{name}")
        sinks.write_report(labels.rul_bands(frame), f"{out}/rul_bands/{name}")
    label = labels.HORIZON_LABEL
    estimators = {
        "logistic_regression": models.ridge_logistic(TRAJECTORY_FEATURES, label, folds,
                                                     grid or models.RIDGE_GRID),
        "random_forest": models.forest(TRAJECTORY_FEATURES, label, **(forest or {})),
        "gradient_boosting": models.boosted(TRAJECTORY_FEATURES, label, **(boosted or {}))}
    sinks.write_report(models.compare_models(estimators, fitting, held, label),
                       f"{out}/comparison")


def telemetry_stream(spark: SparkSession, checkpoint: str, inbox: str | None = None,
                     kafka: str | None = None, topic: str | None = None, log: str | None = None,
                     cap: int | None = None) -> DataFrame:
    """The stream of one source: a file inbox, a Kafka topic or a message log."""
    if sum(source is not None for source in (inbox, kafka, log)) != 1:
        raise ValueError("name one of an inbox, Kafka servers and a message log")
    if inbox is not None:
        return readers.telemetry_inbox(spark, inbox, cap or 4)
    if kafka is not None:
        if not topic:
            raise ValueError("Kafka servers need a topic")
        return readers.parse_messages(readers.kafka_stream(spark, kafka, topic, cap or 50_000))
    return readers.parse_messages(message_log.message_stream(
        spark, log, f"{checkpoint.rstrip('/')}-consumer", cap or 50_000))


def stream_telemetry(source: DataFrame, out: str, checkpoint: str, every: str | None = "10 seconds",
                     publish: str | None = None, kafka: str | None = None) -> StreamingQuery:
    """Run the gate; accepted and quarantined rows also go to message logs or Kafka topics."""
    def send(name: str, frame: DataFrame) -> None:
        sinks.write_messages(frame, kafka, f"telemetry.{name}")

    return gate_stream.run_gate(source, gate_stream.GateSinks(
        out, send if kafka else None, logs=publish), checkpoint, every)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("quality", "adaptive", "rul", "horizon", "stream"):
        job = jobs.add_parser(name)
        job.add_argument("--out", required=True)
        if name in ("quality", "adaptive"):
            job.add_argument("--source", required=True)
        if name in ("rul", "horizon"):
            for part in ("train", "test", "labels"):
                job.add_argument(f"--{part}", required=True)
    jobs.choices["adaptive"].add_argument("--config")
    jobs.choices["rul"].add_argument("--model", choices=("linear", "gbt"), default="linear")
    stream = jobs.choices["stream"]
    source = stream.add_mutually_exclusive_group(required=True)
    for part in ("--inbox", "--kafka", "--log"):
        source.add_argument(part)
    for part in ("--topic", "--publish", "--publish-kafka"):
        stream.add_argument(part)
    stream.add_argument("--cap", type=int, help="files or messages per trigger")
    stream.add_argument("--once", action="store_true", help="drain what is there and stop")
    stream.add_argument("--checkpoint", required=True)
    given = parser.parse_args(arguments)
    spark = build_session(f"pulsegate-{given.job}")
    if given.job == "quality":
        quality_and_routing(readers.telemetry_files(spark, given.source), given.out)
    elif given.job == "adaptive":
        config = scenario.load_scenario(spark, given.config) if given.config else None
        adaptive_cycle(
            readers.telemetry_files(spark, given.source), given.out,
            splits.resolve_windows(config.experiment_windows if config else None),
            config.drift_days() if config else ([1, 3], [5, 7]),
            config.start_time[:10] if config else None,
            config.history_features if config else False,
            config.feedback_split_key if config else "event_id")
    elif given.job in ("rul", "horizon"):
        train, test = (readers.trajectory_files(spark, p) for p in (given.train, given.test))
        truth = readers.rul_labels(spark, given.labels)
        if given.job == "rul":
            remaining_life(train, test, truth, given.out, given.model)
        else:
            failure_horizon(train, test, truth, given.out)
    else:
        source = telemetry_stream(spark, given.checkpoint, given.inbox, given.kafka, given.topic,
                                  given.log, given.cap)
        run = stream_telemetry(source, given.out, given.checkpoint,
                               None if given.once else "10 seconds", given.publish,
                               given.publish_kafka)
        run.awaitTermination()


if __name__ == "__main__":
    main()
