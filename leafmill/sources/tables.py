"""Reading the tables of a data folder through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
