"""Session defaults for tests, the bench and interactive use. Queries take whatever session they are given."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from strandline.storage import FALLBACK_DIR


def local_session(cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", os.environ.get("STRANDLINE_SHARED_DIR", FALLBACK_DIR))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
