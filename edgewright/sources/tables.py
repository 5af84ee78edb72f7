"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a data folder: a Parquet file or a folder of them. Columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
