"""Readers of tables and source trees."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
