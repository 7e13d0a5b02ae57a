"""Reading the given tables. Every query opens its input through Spark's reader only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a path of any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
