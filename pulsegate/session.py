"""Session settings the jobs rely on."""
from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "pulsegate", **settings: str) -> SparkSession:
    """Session with UTC time, AQE and the state store the stateful streams use."""
    builder = SparkSession.builder.appName(app_name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a skewed join side even where that costs another shuffle
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxRecordsPerFile": "250000",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for name, value in {**defaults, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Experiment days are UTC days, so pin the session zone of a given session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
