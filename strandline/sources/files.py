"""Files as tables and back: plans, catalogs, recordings, documents of objects, caches."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of an edit plan, version 1.
PLAN = """version int, created_at string, project struct<name: string, source: string>, categories array<string>, notes array<string>,
slots array<struct<id: string, index: int, status: string, score: double, source_id: string, in_sec: double, out_sec: double,
  instances array<struct<track: int, start_sec: double, end_sec: double>>>>""".replace("instances array", "instances: array")
PLAN_VERSION = 1


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan document (SRC29); another version is an error, found when it is read."""
    plan = spark.read.schema(PLAN).json(path, multiLine=True)
    wrong = F.raise_error(F.concat(F.lit("plan of version "), F.coalesce(F.col("version").cast("string"), F.lit("none"))))
    return plan.withColumn("version", F.when(F.col("version") == PLAN_VERSION, F.col("version")).otherwise(wrong.cast("int")))


def plan_slots(plan: DataFrame) -> DataFrame:
    """One row per slot that has an in-point (SNK2)."""
    return plan.select(F.explode("slots").alias("s")).select("s.*").where("in_sec is not null")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON documents (SNK1); a number that isn't finite is an error (SNK9)."""
    bad = [F.col(c).isNotNull() & (F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) for c, t in df.dtypes if t in ("double", "float")]
    for b in bad:
        df = df.where(F.when(b, F.raise_error(F.lit("a number isn't finite")).cast("boolean")).otherwise(True))
    df.write.mode("overwrite").json(path)


def write_catalog(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header, lists joined by `` | `` (SNK4)."""
    flat = [F.concat_ws(" | ", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files by pattern, each once whatever the case of its name (SRC12): path, length, sha256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    own = files.groupBy(F.lower("path").alias("k")).agg(F.min(F.struct("path", "length", F.sha2("content", 256).alias("sha256"))).alias("f"))
    return own.select("f.path", "f.length", "f.sha256")


def recordings(spark: SparkSession, folder: str, hop: float = 0.02) -> DataFrame:
    """Recordings (8, 16 or 32 bit PCM) with duration, rms, zero crossings, peak, envelope and audible bounds.

    The envelope is the rms of each ``hop``, scaled by its largest; audible is what exceeds 0.005 and 8 % of that
    (SRC8-SRC10, ARR8, MTH23). A file that can't be read gives nulls.
    """

    def measure(batches):
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        width, rate, channels = w.getsampwidth(), w.getframerate(), w.getnchannels()
                        raw = w.readframes(w.getnframes())
                    x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype("float64")
                    x = (x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)
                    x = x.reshape(-1, channels).mean(1)
                    n = max(1, round(hop * rate))
                    e = np.sqrt([np.mean(x[i : i + n] ** 2) for i in range(0, len(x), n)])
                    top = float(e.max(initial=0))
                    loud = np.flatnonzero(e > max(0.005, 0.08 * top))
                    bounds = (loud[0] * n / rate, min(len(x), (loud[-1] + 1) * n) / rate) if len(loud) else (None, None)
                    rms, crossings = (float(np.sqrt(np.mean(x**2))), float(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1])))) if len(x) > 1 else (0.0, 0.0)
                    out.append((path, len(x) / rate, rms, crossings, float(np.abs(x).max(initial=0)), (e / top if top else e).tolist(), *bounds))
                except (wave.Error, EOFError, KeyError, ValueError):
                    out.append((path, *[None] * 7))
            yield pd.DataFrame(out, columns=["path", "duration_sec", "rms", "zero_crossing_rate", "peak", "envelope", "active_start", "active_end"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(folder).select("path", "content")
    return files.mapInPandas(measure, "path string, duration_sec double, rms double, zero_crossing_rate double, peak double, envelope array<double>, active_start double, active_end double")


def objects(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of an XML document, plain or compressed, as rows (SRC15, SRC16)."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def digest(*columns: str) -> Column:
    """Canonical digest of named values (ARR4): order of the names makes no difference."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cached table; one that is missing or can't be read is empty, never an error (SRC30)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)


def add_to_cache(df: DataFrame, path: str) -> None:
    """Adds computed rows to a cached table (SRC14, JN17)."""
    df.write.mode("append").parquet(path)
