"""Tables of a data directory: one parquet file or folder for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read table *name*; the schema comes from the parquet footer, columns and filters are pushed down."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
