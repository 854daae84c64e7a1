"""Running totals over a global order without a single-task window.

The input is first reduced to one row per (group, position), written once, and cut into
chunks of about equal row counts by quantiles of the position. Chunk totals give every chunk
its starting value, which enters the chunk as one extra carry row; a window inside
(group, chunk) does the rest. No window holds more than about 1/chunks of all rows, however
the rows spread over groups or positions, and the rows are shuffled once.
"""
from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegate.staging import stage

CHUNK, CARRY = "_chunk", "_carry"


def default_chunks(frame: DataFrame) -> int:
    """Twice the shuffle partitions, so that chunks even out over tasks."""
    return 2 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def chunked(frame: DataFrame, position: str, chunks: int | None = None) -> DataFrame:
    """Written copy of ``frame`` with an integer chunk that grows with the position."""
    written = stage(frame.withColumn("_position", F.col(position).cast("double")), "ordered")
    count = chunks or default_chunks(frame)
    shares = [n / count for n in range(1, count)]
    cuts = written.approxQuantile("_position", shares, 0.1 / count) if shares else []
    # an empty table has no quantiles, and the bucketizer wants at least one cut
    splits = [float("-inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_position", outputCol="_bucket",
                            handleInvalid="keep")
    return (bucketizer.transform(written)
            .withColumn(CHUNK, F.col("_bucket").cast("int")).drop("_bucket", "_position"))


def attach_by_key(frame: DataFrame, small: DataFrame, columns: list[str],
                  bounded: bool = False) -> DataFrame:
    """Left join on NULL-safe equality, keeping one copy of the key columns.

    ``bounded`` states that the small side has a fixed upper number of rows.
    """
    extra = [c for c in small.columns if c not in columns]
    right = F.broadcast(small) if bounded else small
    same = reduce(lambda a, b: a & b, [
        F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns])
    return (frame.alias("l").join(right.alias("r"), same, "left")
            .select("l.*", *[F.col(f"r.{c}") for c in extra]))


def _chunk_order(group_by: list[str], descending: bool = False) -> Window:
    """Chunks of one group in order; at most one row per chunk."""
    chunk = F.col(CHUNK).desc() if descending else F.col(CHUNK).asc()
    return Window.partitionBy(*(group_by or [F.lit(0)])).orderBy(chunk)


def _with_carries(rows: DataFrame, carries: DataFrame) -> DataFrame:
    return (rows.withColumn(CARRY, F.lit(False))
            .unionByName(carries.withColumn(CARRY, F.lit(True)), allowMissingColumns=True))


def _accumulate(rows: DataFrame, group_by: list[str], order: list[Column], values: list[str],
                descending_chunks: bool) -> DataFrame:
    """run_x and total_x for chunked rows; ``order`` sorts the rows of one chunk."""
    by_chunk = _chunk_order(group_by, descending_chunks)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*(group_by or [F.lit(0)]))
    sums = rows.groupBy(*group_by, CHUNK).agg(*[F.sum(v).alias(v) for v in values])
    carries = sums.select(
        *group_by, CHUNK,
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values],
        *[F.sum(v).over(every).alias(f"total_{v}") for v in values])
    inside = (Window.partitionBy(*group_by, CHUNK).orderBy(F.col(CARRY).desc(), *order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (_with_carries(rows, carries)
            .withColumns({**{f"run_{v}": F.sum(v).over(inside) for v in values},
                          **{f"total_{v}": F.first(f"total_{v}").over(inside)
                             for v in values}})
            .where(~F.col(CARRY)).drop(CARRY, CHUNK))


def running_totals(frame: DataFrame, group_by: list[str], position: str, values: list[str],
                   descending: bool = False, chunks: int | None = None) -> DataFrame:
    """Add ``run_x`` (inclusive running sum) and ``total_x`` for each value column x.

    ``frame`` holds one row per (group, position).
    """
    rows = chunked(frame, position, chunks)
    first = F.col(position).desc() if descending else F.col(position).asc()
    return _accumulate(rows, group_by, [first], values, descending)


def global_rank(frame: DataFrame, order: list[Column], chunks: int | None = None) -> DataFrame:
    """Add ``rank`` 1..n in the given total order, and ``total``.

    Rows are range-partitioned on the whole order, so many rows with an equal first key are
    split by the following ones. The result is written before it is used twice, because the
    ranges are drawn from a sample.
    """
    count = chunks or default_chunks(frame)
    ranged = (stage(frame, "unranked").repartitionByRange(count, *order)
              .withColumn(CHUNK, F.spark_partition_id()).withColumn("one", F.lit(1)))
    ranked = _accumulate(stage(ranged, "ranged"), [], order, ["one"], False)
    return (ranked.drop("one").withColumnRenamed("run_one", "rank")
            .withColumnRenamed("total_one", "total"))


def grouped_rank(frame: DataFrame, group_by: list[str], order: list[Column],
                 chunks: int | None = None) -> DataFrame:
    """Add ``rank`` 1..n inside each group in the given order, and the group's ``total``.

    Rows are range-partitioned on the group and the order, so a group that holds a third of all
    rows is cut into chunks like the rest: no window spans a whole group. Rows that tie in
    ``order`` get different ranks; the result is written once, so that every reader sees the same.
    """
    count = chunks or default_chunks(frame)
    ranged = stage(frame.repartitionByRange(count, *[F.col(g).asc() for g in group_by], *order)
                   .withColumn(CHUNK, F.spark_partition_id()).withColumn("_one", F.lit(1)), "ranged")
    ranked = stage(_accumulate(ranged, group_by, order, ["_one"], False), "ranked")
    return (ranked.drop("_one").withColumnRenamed("run__one", "rank")
            .withColumnRenamed("total__one", "total"))


def exact_quantile(frame: DataFrame, group_by: list[str], value: str, share: float, result: str,
                   chunks: int | None = None) -> DataFrame:
    """One row per group with the exact quantile of ``value``, interpolated between two ranks.

    Values are counted first, so equal ones are one row; running counts over chunks then find
    the two distinct values that hold the ranks around ``share``. No group is sorted in one
    task. NULL values are left out; groups without any other have no row.
    """
    counted = frame.where(F.col(value).isNotNull()).groupBy(*group_by, value).agg(
        F.count("*").alias("_n"))
    ranks = running_totals(counted, group_by, value, ["_n"], chunks=chunks)
    place = (F.col("total__n") - 1) * F.lit(float(share))
    low = F.floor(place)

    def at(rank: Column) -> Column:
        """The value whose copies cover a rank, counted from 0."""
        return F.max(F.when((F.col("run__n") > rank) & (F.col("run__n") - F.col("_n") <= rank),
                            F.col(value)))

    found = ranks.groupBy(*group_by).agg(at(low).alias("_low"), at(F.ceil(place)).alias("_high"),
                                         F.max(place - low).alias("_part"))
    return found.select(*group_by, (F.col("_low") + (F.col("_high") - F.col("_low"))
                                    * F.col("_part")).alias(result))


def running_backlog(frame: DataFrame, group_by: list[str], position: str, net: str,
                    result: str, chunks: int | None = None) -> DataFrame:
    """Queue left after each step, ``max(0, previous + net)``, in closed form.

    With S the running sum of ``net`` and m its running minimum, the queue is
    ``S - min(0, m)``. Chunks combine as (s1, m1), (s2, m2) -> (s1 + s2, min(m1, s1 + m2)).
    """
    rows = chunked(frame, position, chunks)
    before = _chunk_order(group_by).rowsBetween(Window.unboundedPreceding, -1)
    inside = (Window.partitionBy(*group_by, CHUNK).orderBy(F.col(CARRY).desc(), position)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = (Window.partitionBy(*group_by, CHUNK).orderBy(position)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carries = (rows.withColumn("_s", F.sum(net).over(within))
               .groupBy(*group_by, CHUNK).agg(F.sum(net).alias("_sum"), F.min("_s").alias("_low"))
               .withColumn(net, F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
               .withColumn("_floor", F.min(F.col(net) + F.col("_low")).over(before))
               .select(*group_by, CHUNK, net, F.least(F.lit(0.0), "_floor").alias("_floor")))
    return (_with_carries(rows, carries)
            .withColumn("_s", F.sum(net).over(inside))
            .withColumn("_m", F.min(F.when(F.col(CARRY), F.col("_floor"))
                                    .otherwise(F.col("_s"))).over(inside))
            .where(~F.col(CARRY))
            .withColumn(result, F.col("_s") - F.col("_m"))
            .drop(CARRY, CHUNK, "_s", "_m", "_floor"))


def next_after(marks: DataFrame, group_by: list[str], position: str, value: str, result: str,
               chunks: int | None = None) -> DataFrame:
    """Add the smallest non-NULL ``value`` found strictly later in the order of ``position``.

    ``marks`` holds one row per (group, position).
    """
    rows = chunked(marks, position, chunks)
    beyond = _chunk_order(group_by, descending=True).rowsBetween(Window.unboundedPreceding, -1)
    carries = (rows.groupBy(*group_by, CHUNK).agg(F.min(value).alias("_low"))
               .select(*group_by, CHUNK, F.min("_low").over(beyond).alias(value)))
    # falling order and a frame that only grows: a frame that shrinks is recomputed per row
    later = (Window.partitionBy(*group_by, CHUNK).orderBy(F.col(CARRY).desc(), F.desc(position))
             .rowsBetween(Window.unboundedPreceding, -1))
    return (_with_carries(rows, carries)
            .withColumn(result, F.min(value).over(later))
            .where(~F.col(CARRY)).drop(CARRY, CHUNK))
