"""Shared storage of a session: where lineage is cut and where working tables are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder of its own (tests, notebooks).
FALLBACK_DIR = "/tmp/strandline-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset, a folder for a single machine is set, which only
    fits tests in local mode.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or FALLBACK_DIR)
    return named or FALLBACK_DIR


def cut_sorted(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: partitions and the order in them are kept, lost executors do no harm."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, for loops: nothing of the plan is carried on, nor its constraints."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder for a working table."""
    path = f"{shared_dir(spark).rstrip('/')}/strandline-{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the working tables that this process has written; results that weren't read yet can't be read then."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
