"""Past-only rolling features over event time."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulsegate.operators.prefix import attach_by_key
from pulsegate.staging import stage, tasks_for

# Rolling feature -> (aggregate, source column, frame).
ROLLING = {
    "error_rate_mean_5m": ("mean", "error_rate", "short"),
    "error_rate_mean_15m": ("mean", "error_rate", "long"),
    "error_rate_max_15m": ("max", "error_rate", "long"),
    "response_p95_mean_5m": ("mean", "response_p95_ms", "short"),
    "response_p95_mean_15m": ("mean", "response_p95_ms", "long"),
    "timeout_rate_mean_15m": ("mean", "timeout_rate", "long"),
    "queue_depth_mean_15m": ("mean", "queue_depth", "long"),
    "cpu_util_mean_15m": ("mean", "cpu_util_pct", "long"),
}
# Delta feature -> (value, rolling mean it is compared with).
DELTAS = {
    "error_rate_delta_15m": ("error_rate", "error_rate_mean_15m"),
    "response_p95_delta_15m": ("response_p95_ms", "response_p95_mean_15m"),
}


def rolling_features(frame: DataFrame, names: list[str] | None = None,
                     short_seconds: int = 240, long_seconds: int = 840,
                     key: str = "server_id", time: str = "event_time") -> DataFrame:
    """Add the named rolling features; the bounds are inclusive whole seconds.

    Rows of one (key, second) are peers of the frame, so they are reduced to one row first. Time
    is cut into blocks as long as the frame, so a frame is the end of one block and the beginning
    of the next. Every second gets the running aggregate of its block so far, and asks the block
    before for its running aggregate from the end back to where the frame starts. Both only grow, so
    a row costs the same whatever the frame's length, sums lose nothing by subtraction, and a
    window holds at most two rows per second of a block even if one server sends a third of the
    data. The seconds are written, so that the tasks which sort them follow from their number: a
    task sorts them twice, and partitions sized by their shuffled bytes hold millions.
    """
    wanted = {n: ROLLING[n] for n in (names or ROLLING)}
    spans = {"short": short_seconds, "long": long_seconds}
    used = sorted({span for _, _, span in wanted.values()})
    needed = sorted({(part, source) for how, source, _ in wanted.values()
                     for part in (("max",) if how == "max" else ("sum", "n"))})
    timed = frame.withColumn("_second", F.unix_timestamp(F.col(time).cast("timestamp")))
    reduced = {"sum": F.sum, "n": F.count, "max": F.max}
    measures = {f"_{part}_{s}": reduced[part](s) for part, s in needed}
    per_second = stage(timed.groupBy(key, "_second").agg(
        *[agg.alias(name) for name, agg in measures.items()]), "seconds")

    second = F.col("_second")

    def cell(span: str, own: bool):
        block = F.floor(second / (spans[span] + 1))
        return F.struct(F.lit(span).alias("_span"), F.lit(own).alias("_own"),
                        (block if own else block - 1).alias("_block"),
                        (second if own else second - spans[span]).alias("_at"))

    # rows without a time are peers of each other only
    cells = per_second.select("*", F.inline(F.when(
        second.isNull(), F.array(*[cell(span, True) for span in used])).otherwise(
        F.array(*[cell(span, own) for span in used for own in (True, False)]))))
    cells = cells.repartition(tasks_for(frame.sparkSession, per_second.count() * 2 * len(used)),
                              key, "_span", "_block")
    block = Window.partitionBy(key, "_span", "_block")
    so_far = block.orderBy(F.col("_at").asc(), F.col("_own").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    from_end = block.orderBy(F.col("_at").desc(), F.col("_own").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    over = {"_max": F.max, "_sum": F.sum, "_n": F.sum}

    def running(name: str):
        value = F.when(F.col("_own"), F.col(name))
        total = over[name[:name.index("_", 1)]]
        return F.when(F.col("_own"), total(value).over(so_far)).otherwise(
            total(value).over(from_end)).alias(name)

    parts = cells.select(key, "_second", "_span", *[running(name) for name in measures])

    def both(name: str, span: str):
        total = F.max if name.startswith("_max") else F.sum
        return total(F.when(F.col("_span") == span, F.col(name)))

    rolled = parts.groupBy(key, "_second").agg(*[
        (both(f"_max_{source}", span) if how == "max" else F.try_divide(
            both(f"_sum_{source}", span), both(f"_n_{source}", span))).alias(name)
        for name, (how, source, span) in wanted.items()])
    return attach_by_key(timed, rolled, [key, "_second"]).drop("_second")


def add_deltas(frame: DataFrame, names: list[str] | None = None) -> DataFrame:
    return frame.withColumns({name: F.col(value) - F.col(mean) for name, (value, mean)
                              in DELTAS.items() if names is None or name in names})


def add_history_features(frame: DataFrame, short_seconds: int = 240, long_seconds: int = 840,
                         names: list[str] | None = None) -> DataFrame:
    """All ten history features, or the named ones and the means that named deltas take.

    Call before splitting so early rows may look back.
    """
    rolling = None if names is None else [
        n for n in ROLLING if n in names or any(DELTAS[d][1] == n for d in DELTAS if d in names)]
    return add_deltas(rolling_features(frame, rolling, short_seconds, long_seconds), names)
