"""Written intermediate tables.

Small or reduced tables that several branches of a plan need are written once to the
shared folder and read back. That cuts lineage in a way that survives the loss of
executors, keeps both branches consistent, and tells the planner the real size, so it
broadcasts the table only when it is below ``spark.sql.autoBroadcastJoinThreshold``.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows of one task where memory or a pass over them counts: the fewest worth a task, and the most.
FEWEST_ROWS, MOST_ROWS = 10_000, 250_000

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a fresh one only for local sessions."""
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_folders[application]


def stage(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` once and return a scan of what was written."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/staged/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks to deal ``rows`` over: every core gets some, then more come with ``MOST_ROWS`` each."""
    cores = spark.sparkContext.defaultParallelism
    return max(min(-(-rows // FEWEST_ROWS), cores), -(-rows // MOST_ROWS), 1)
