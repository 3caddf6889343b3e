"""Readers of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
