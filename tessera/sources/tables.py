"""Parquet tables of a data folder as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
