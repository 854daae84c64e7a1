"""Versioned schema registry as a small table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegate.schema import REGISTRY


def registry_table(spark: SparkSession) -> DataFrame:
    """One row per schema version with its required keys."""
    rows = [F.struct(F.lit(version).alias("version"),
                     F.array(*map(F.lit, keys)).alias("required"))
            for version, keys in REGISTRY.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def required_keys(version: int) -> list[str]:
    if version not in REGISTRY:
        raise KeyError(f"unknown schema version {version}")
    return list(REGISTRY[version])


def versions() -> list[int]:
    return sorted(REGISTRY)
