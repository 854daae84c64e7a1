"""Tables behind the operations views: health, alerts, history, fallbacks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegate.functions.scores import count_of
from pulsegate.operators.prefix import global_rank
from pulsegate.operators.routing import health_labelled
from pulsegate.staging import stage

#: Rows that one task may hold to pick the first ones.
TOP_ROWS = 100_000


def latest_per_server(frame: DataFrame, key: str = "server_id") -> DataFrame:
    """Newest row per server (time, then id).

    The rows are written once. The latest time of a server is a hash aggregate; only rows of that
    time are compared by id. Of rows alike in time and id any one is kept.
    """
    rows = stage(frame, "latest")
    columns = [c for c in frame.columns if c != key]
    times = rows.groupBy(F.col(key).alias("_key")).agg(F.max("event_time").alias("_time"))
    last = rows.join(times, F.col(key).eqNullSafe(F.col("_key"))
                     & F.col("event_time").eqNullSafe(F.col("_time")), "left_semi")
    newest = F.max_by(F.struct(*columns), F.struct("event_id"))
    return last.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def newest_first(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.desc("event_time"), F.desc("event_id"))


def first_rows(frame: DataFrame, count: int, order: list[str],
               chunks: int | None = None) -> DataFrame:
    """The first ``count`` rows in the order of columns that together are unique.

    Up to ``TOP_ROWS`` each task keeps its first rows. Beyond, only the order columns are ranked;
    the row at the count gives the cut, and the wide rows are filtered by it without a shuffle.
    """
    if count <= TOP_ROWS and chunks is None:
        return frame.orderBy(*order).limit(count)
    ranked = global_rank(frame.select(*order), [F.col(c) for c in order], chunks)
    cut = (ranked.where(F.col("rank") == count)
           .select(*[F.col(c).cast("string") for c in order]).first())
    if cut is None:
        return frame
    limit = F.struct(*[F.lit(cut[c]).cast(kind).alias(c)
                       for c, kind in frame.select(*order).dtypes])
    return frame.where(F.struct(*order) <= limit)


def _alert_list(alerts: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Alerts in order, each with the number of all and whether the list was cut.

    The alerts are written once; what finds them runs once, and the files know their number.
    """
    if limit is not None and limit < 1:
        raise ValueError("a limit of alerts must be positive")
    kept = stage(alerts, "alerts")
    total = kept.count()
    shown = kept.orderBy(*order)
    return (shown if limit is None else shown.limit(limit)).withColumns({
        "total_alerts": F.lit(total).cast("bigint"),
        "truncated": F.lit(limit is not None and total > limit)})


def recent_alerts(scored: DataFrame, probability: str, threshold: float,
                  limit: int | None = None) -> DataFrame:
    """All alerts, or the newest ``limit`` of them."""
    return _alert_list(scored.where(F.col(probability) >= threshold),
                       [F.desc("event_time"), F.desc("event_id")], limit)


def alert_view(scored: DataFrame, probability: str, threshold: float,
               limit: int | None = None) -> DataFrame:
    """Alerts by time and probability, newest and strongest first; all or ``limit`` of them."""
    return _alert_list(scored.where(F.col(probability) >= threshold),
                       [F.desc("event_time"), F.desc(probability), F.desc("event_id")], limit)


def health_view(latest: DataFrame, probability: str, threshold: float,
                chunks: int | None = None) -> DataFrame:
    """Health rows with their display rank: warnings first, then probability, then server.

    A warning has a probability at or above the threshold, so falling probability alone puts
    warnings first.
    """
    labelled = health_labelled(latest, probability, threshold)
    return global_rank(labelled, [F.desc(probability), F.asc("server_id")],
                       chunks).drop("total")


def health_summary(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count("*").alias("servers"),
        count_of(F.col("status") == "normal").alias("normal"),
        count_of(F.col("status") == "failure_warning").alias("failure_warning"))


def alerts_to_explain(scored: DataFrame, probability: str, threshold: float,
                      limit: int | None = None) -> DataFrame:
    """Alerts in time order, all or the first ``limit``; the id makes the order total."""
    return _alert_list(scored.where(F.col(probability) >= threshold),
                       [F.asc("event_time"), F.asc("event_id")], limit)


def newest_metric(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.max_by(F.struct("*"), "batch_id").alias("_m")).select("_m.*")


def first_available(sources: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """Rows of the first source whose table exists, labelled with its name.

    A missing table is None. An existing table without rows is an answer, not a gap.
    """
    for name, frame in sources:
        if frame is not None:
            return frame.withColumn("source", F.lit(name))
    raise ValueError("none of the sources exists")


def first_non_empty(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first source that has any; for sources that cannot be told missing."""
    ranked = [frame.withColumns({"source": F.lit(name), "_priority": F.lit(n)})
              for n, (name, frame) in enumerate(sources)]
    combined = ranked[0]
    for frame in ranked[1:]:
        combined = combined.unionByName(frame)
    first = combined.agg(F.min("_priority")).scalar()
    return combined.where(F.col("_priority") == first).drop("_priority")
