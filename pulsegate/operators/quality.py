"""Quality gate: repeated events, rule evidence, accept/quarantine, detection reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegate.functions.gate_rules import REPEAT_FLAG, RULES, fired_categories, fired_rules
from pulsegate.functions.scores import count_of, share_or_zero
from pulsegate.schema import CONTRACT_REQUIRED, QUALITY_CATEGORIES, REGISTRY_V2_EXTRA
from pulsegate.staging import stage

# Rows of one input partition that share a salt: 2**20.
SALT_BITS = 20


# Which of several rows with one id counts as the first.
ARRIVAL = ("struct(coalesce(duplicate_ordinal, 0) AS ordinal, ingest_time IS NULL AS undated, "
           "ingest_time AS at, coalesce(source_sequence, 0L) AS sequence)")
LABELLED_COPY = "event_id IS NOT NULL AND coalesce(duplicate_ordinal, 0) > 0"


def _one_of_tied(tied: DataFrame, columns: list[str]) -> DataFrame:
    """Of rows that arrived alike, the one with the smallest content stays.

    Two rankings, inside (id, salt) and then among the salt winners: no group exceeds 2**20 rows
    or one row per salt, whatever share one id has.
    """
    content = ", ".join(f"`{c}`" for c in columns)
    salted = tied.withColumn("_salt", F.shiftright(F.monotonically_increasing_id(), SALT_BITS))
    # an input already partitioned by id alone would satisfy the window and keep a hot id together
    return (
        salted.repartition("event_id", "_salt").select("*", F.expr(f"""row_number() OVER (
            PARTITION BY event_id, _salt ORDER BY xxhash64({content})) AS _local"""))
        .select("*", F.expr(f"""row_number() OVER (PARTITION BY event_id,
            if(_local > 1, _salt, NULL) ORDER BY xxhash64({content})) AS _final"""))
        .select(*columns, F.expr(f"({LABELLED_COPY}) OR _local > 1 OR _final > 1")
                .alias(REPEAT_FLAG)))


def first_arrivals(frame: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Ids whose rows are not all new: their first arrival, its rows, and if the id was seen before.

    Only the columns of the arrival are read, and both aggregates combine map-side. ``seen`` holds
    one row per ``event_id`` that an earlier input brought.
    """
    arrivals = frame.where("event_id IS NOT NULL").select(
        "event_id", F.expr(ARRIVAL).alias("arrival")).groupBy("event_id", "arrival").count()
    ids = arrivals.groupBy("event_id").agg(
        F.min(F.struct("arrival", "count")).alias("first"), F.sum("count").alias("rows"))
    if seen is None:
        old = F.lit(False)
    else:
        ids = ids.join(seen.select("event_id", F.lit(True).alias("_old")), "event_id", "left")
        old = F.coalesce("_old", F.lit(False))
    return ids.withColumn("seen_before", old).where("rows > 1 OR seen_before").select(
        "event_id", F.col("first.arrival").alias("first_arrival"),
        F.col("first.count").alias("first_rows"), "seen_before")


def mark_repeats(frame: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Add the boolean that says a row repeats an event seen earlier in arrival order.

    The first arrival of each repeated id is written; the planner picks the join by its size.
    The wide rows are read once and compared with it: no row is ranked. Only where several rows
    of an id arrived first alike (same ordinal, time and sequence) are these read again and told
    apart by content. Rows whose id is in ``seen`` are all repeats.
    """
    firsts = stage(first_arrivals(frame, seen), "first-arrivals")
    columns = frame.columns
    later = f"seen_before OR {ARRIVAL} <> first_arrival"
    joined = frame.join(firsts, "event_id", "left").select(
        *[F.col(c) for c in columns],
        F.expr(f"({LABELLED_COPY}) OR coalesce({later}, FALSE)").alias(REPEAT_FLAG),
        F.expr(f"coalesce(first_rows > 1 AND NOT ({later}), FALSE)").alias("_tied"))
    if firsts.where("first_rows > 1 AND NOT seen_before").isEmpty():
        return joined.drop("_tied")
    tied = joined.where("_tied").select(*columns)
    return joined.where("NOT _tied").drop("_tied").unionByName(_one_of_tied(tied, columns))


def classify_quality(frame: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Attach rule evidence and the accept/quarantine decision to every row.

    ``seen`` holds the ids that earlier inputs brought; rows with one of them are repeats.
    """
    fired = "quality_failure_reasons"
    return (
        mark_repeats(frame, seen)
        .select(*frame.columns, fired_rules(RULES).alias(fired))
        .select("*", fired_categories(fired, RULES).alias("detected_defect_categories"),
                *[F.expr(text) for text in (
                    f"concat_ws('|', {fired}) AS quality_failure_type",
                    f"size({fired}) AS quality_rule_count",
                    f"size({fired}) = 0 AS is_valid",
                    f"if(size({fired}) = 0, 'accept', 'quarantine') AS quality_action",
                    f"array_contains({fired}, 'event_too_late') AS late_event_flag",
                    "to_date(event_time) AS event_date")]))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where("is_valid")


def quarantined(classified: DataFrame) -> DataFrame:
    return classified.where("NOT is_valid")


def batch_counters(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count("*").alias("received"),
        count_of(F.col("is_valid")).alias("accepted"),
        count_of(~F.col("is_valid")).alias("quarantined"))


def quality_report(classified: DataFrame) -> DataFrame:
    """One row: detection counts against the injected truth and the derived ratios."""
    truth = F.coalesce("is_injected_defect", F.lit(False))
    caught = ~F.col("is_valid")
    counts = classified.agg(
        F.count("*").alias("received"),
        count_of(~caught).alias("accepted"),
        count_of(caught).alias("quarantined"),
        count_of(truth).alias("injected_defects"),
        count_of(truth & caught).alias("tp"),
        count_of(~truth & caught).alias("fp"),
        count_of(truth & ~caught).alias("fn"),
        count_of(~truth & ~caught).alias("tn"))
    return counts.withColumns({
        "precision": share_or_zero(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": share_or_zero(F.col("tp"), F.col("tp") + F.col("fn")),
        "clean_record_preservation": share_or_zero(F.col("tn"), F.col("tn") + F.col("fp")),
    })


def category_report(classified: DataFrame, legacy_nulls: bool = False) -> DataFrame:
    """One row per category. ``legacy_nulls`` leaves clean rows out of the false alarms."""
    cells = []
    for category in QUALITY_CATEGORIES:
        same = F.col("injected_defect_category") == category
        truth = same if legacy_nulls else F.coalesce(same, F.lit(False))
        caught = F.array_contains("detected_defect_categories", category)
        cells.append(F.struct(
            F.lit(category).alias("category"),
            count_of(truth).alias("truth_count"),
            count_of(truth & caught).alias("tp"),
            count_of(~truth & caught).alias("fp"),
            count_of(truth & ~caught).alias("fn")))
    return (classified.agg(F.array(*cells).alias("cells"))
            .select(F.inline("cells"))
            .withColumns({
                "precision": share_or_zero(F.col("tp"), F.col("tp") + F.col("fp")),
                "recall": share_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))}))


def rule_counts(classified: DataFrame) -> DataFrame:
    return (classified.select(F.explode("quality_failure_reasons").alias("rule_id"))
            .groupBy("rule_id").agg(F.count("*").alias("failures")))


def registry_gaps(raw: DataFrame, registry: DataFrame, json_column: str = "raw_json",
                  version_column: str = "schema_version") -> DataFrame:
    """Registry keys that are absent from each raw record of a registered version.

    The registry holds one row per schema version, which bounds what is broadcast.
    """
    keys = F.coalesce(F.json_object_keys(json_column), F.array().cast("array<string>"))
    return (raw.join(F.broadcast(registry.withColumnRenamed("version", version_column)),
                     version_column, "left")
            .withColumns({
                "registered": F.col("required").isNotNull(),
                "missing_keys": F.array_except("required", keys)})
            .drop("required"))


def contract_report(raw: DataFrame, json_column: str = "raw_json") -> DataFrame:
    """One row of contract counts over raw records, with a verdict.

    Unlike the gate, the contract asks for keys: a key that is present with a null value
    counts as present.
    """
    keys = F.coalesce(F.json_object_keys(json_column), F.array().cast("array<string>"))
    fields = ["schema_version", "cpu_util_pct", "failure_within_30min", "is_injected_defect",
              "injected_defect_category", "expected_route", "expected_quality_action"]
    parsed = raw.select(keys.alias("keys"), F.json_tuple(json_column, *fields).alias(*fields))

    def lacks(names: list[str]) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, names)), F.col("keys"))) > 0

    def otherwise(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    version = F.col("schema_version").try_cast("int")
    counts = {
        "rows": F.count("*"),
        "schema_v1": count_of(version == 1),
        "schema_v2": count_of(version == 2),
        "missing_required": count_of(lacks(CONTRACT_REQUIRED)),
        "v2_missing_extension": count_of((version == 2) & lacks(REGISTRY_V2_EXTRA)),
        "invalid_cpu": count_of(otherwise(
            F.col("cpu_util_pct").try_cast("double").between(0.0, 100.0))),
        "positive_labels": F.coalesce(
            F.sum(F.col("failure_within_30min").try_cast("long")), F.lit(0)),
        "invalid_quality_action": count_of(otherwise(
            F.col("expected_quality_action").isin("accept", "quarantine"))),
        "invalid_route": count_of(otherwise(F.col("expected_route").isin("stream", "batch"))),
    }
    for category in QUALITY_CATEGORIES:
        counts[f"truth_{category}"] = count_of(
            F.col("is_injected_defect").try_cast("boolean")
            & (F.col("injected_defect_category") == category))
    for route in ("stream", "batch"):
        counts[f"route_{route}"] = count_of(F.col("expected_route") == route)
    report = parsed.agg(*[value.alias(name) for name, value in counts.items()])
    present = ["rows", "schema_v1", "schema_v2", "route_stream", "route_batch",
               *[f"truth_{category}" for category in QUALITY_CATEGORIES]]
    clean = ["invalid_quality_action", "invalid_route"]
    return report.withColumn(
        "passed", F.least(*[F.col(name) > 0 for name in present],
                          *[F.col(name) == 0 for name in clean]))
