"""Endless tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENDLESS = 1 << 52


def dummy(spark: SparkSession) -> DataFrame:
    """The rows of dummy:// for a query with a limit: foo is 4, bar counts from 0 to 9 again and again."""
    return spark.range(ENDLESS, numPartitions=1).select(F.lit(4).cast("long").alias("foo"), (F.col("id") % 10).alias("bar"))


def dummy_stream(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """The same as a stream."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.lit(4).cast("long").alias("foo"), (F.col("value") % 10).alias("bar"))
