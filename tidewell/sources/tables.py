"""Named Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``. The path goes to Spark as it is, so any store Spark can read will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
