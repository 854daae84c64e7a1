"""Ids that earlier micro-batches brought: a table kept next to the gate's outputs.

Each batch writes the ids it read under its own ``batch_id``, by event date, and looks up only
what batches before it wrote. So a replayed batch finds what it found the first time and
overwrites what it wrote. The lookup is a join of the batch's distinct ids with one narrow
column: no Python, no state per task, and nothing is forgotten unless ``keep_days`` says so.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

SEEN = "event_id STRING, event_date DATE, batch_id BIGINT"


def remember_ids(batch: DataFrame, folder: str, batch_id: int) -> None:
    """Write the distinct ids of a batch; a replay overwrites them."""
    ids = batch.where("event_id IS NOT NULL").groupBy("event_id").agg(
        F.to_date(F.max("event_time")).alias("event_date"))
    # one task, and so one file, per date
    ids.repartition("event_date").write.mode("overwrite").partitionBy("event_date").parquet(
        f"{folder}/batch_id={batch_id}")


def remembered_ids(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """(event_id, event_date) of all batches before ``batch_id``; later ones are not read."""
    try:
        table = spark.read.schema(SEEN).parquet(folder)
    except AnalysisException:  # before the first batch
        return spark.createDataFrame([], SEEN)
    return table.where(F.col("batch_id") < batch_id)


def seen_before(batch: DataFrame, folder: str, batch_id: int,
                keep_days: int | None = None) -> DataFrame:
    """Ids of the batch that an earlier batch brought, one row each.

    With ``keep_days``, only ids dated at most so many days before the batch's earliest event are
    looked up, and the partitions of older dates are not read.
    """
    earlier = remembered_ids(batch.sparkSession, folder, batch_id)
    if keep_days is not None:
        first = batch.agg(F.to_date(F.min("event_time"))).first()[0]
        if first is not None:
            oldest = F.date_sub(F.lit(first), keep_days)
            earlier = earlier.where((F.col("event_date") >= oldest) | F.col("event_date").isNull())
    own = batch.where("event_id IS NOT NULL").select("event_id").distinct()
    return own.join(earlier.select("event_id"), "event_id", "left_semi")
