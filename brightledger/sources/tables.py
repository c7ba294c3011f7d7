"""Reading the star-schema and event tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base``; any path that Spark's readers open."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def events_with_time(spark: SparkSession, base: str) -> DataFrame:
    """``events`` with ``ts`` as an instant (session zone UTC), which watermarks need."""
    return table(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp"))
