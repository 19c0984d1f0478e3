"""Loaders of the parquet tables and the views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as observation series: series, us (microseconds), label, value, event_id."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("user_id").alias("series"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_type").alias("label"),
        "value",
        "event_id",
    )


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as intervals: series, s, e (microseconds; the value gives whole minutes), event_id, label."""
    o = observations(spark, folder)
    return o.select("series", F.col("us").alias("s"), (F.col("us") + F.floor(F.col("value") * 60) * 1000000).cast("bigint").alias("e"), "event_id", "label")
