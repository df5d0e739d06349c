"""Readers of the table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table. Only the columns a plan uses reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
