"""Readers for the domain tables (one Parquet file or folder each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan `<root>/<name>.parquet`; projection and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
