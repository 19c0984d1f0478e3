"""Incremental operators on Structured Streaming. All run with ``availableNow`` on growing folders as well as continuously."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.storage import scratch_path


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream, so many files to a batch."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def replayed(df: DataFrame, *, time: str, key: str, batches: int = 5, late: int = 0, again: int = 0) -> tuple[DataFrame, str]:
    """A table as arrivals in the order of its times, one file and one micro-batch each; and a watermark that loses none.

    With ``late``, every so many-th key comes one batch after its time; with ``again``, every so many-th key is delivered once
    more in the next batch. This rehearses a stream; a real one has its own source. Rows without a time come last.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "arrivals")
    low, high = df.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // batches))
    own = F.coalesce(F.floor((F.unix_micros(time) - F.lit(low or 0)) / width).cast("int"), F.lit(batches - 1))
    hit = lambda n: F.pmod(F.xxhash64(key), F.lit(n)) == 0
    first = df.withColumn("__n", own + F.when(hit(late), 1).otherwise(0) if late else own)
    all_ = first.unionByName(first.where(hit(again)).withColumn("__n", F.col("__n") + 1)) if again else first
    last = all_.agg(F.max("__n")).first()[0]
    all_.limit(0).drop("__n").coalesce(1).write.parquet(path)
    for n in range((last if last is not None else -1) + 1):
        all_.where(F.col("__n") == n).drop("__n").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream, f"{2 * width // 1_000_000 + 2} seconds"


def once(stream: DataFrame, *, key: str, time: str, delay: str) -> DataFrame:
    """Each key once, however often it is delivered within ``delay``; the state forgets keys behind the watermark (ST13)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def latest(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream to its end and gives the last version of each key; of ``complete`` results the last as a whole.

    Each batch is written under its number, so a batch that runs again replaces itself (SNK10, ST13); a later batch
    re-opens a result by giving its key again (ST8).
    """
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    if mode == "complete":
        newest = rows.agg(F.max("__batch")).first()[0]
        return rows.where(F.col("__batch") == newest).drop("__batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "__batch").alias("r"))
    return last.select(*keys, "r.*").drop("__batch")


class Enough(Exception):
    """Raised in a batch that isn't wanted any more, so that it isn't committed and comes again on resumption."""


def until(stream: DataFrame, enough: Callable[[DataFrame, int], bool], checkpoint: str) -> int:
    """Feeds batches to ``enough`` until it says so (ST2); gives the number of batches. Started again with the same
    checkpoint it goes on behind the last finished batch. Any other failure of the stream is raised."""
    seen, done = [], []

    def take(batch: DataFrame, number: int) -> None:
        if done:
            raise Enough("enough")
        seen.append(number)
        if enough(batch, number):
            done.append(number)

    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()
    try:
        while not query.awaitTermination(1):
            if done:
                query.stop()
    except StreamingQueryException as e:
        if not done or "Enough" not in str(e):
            raise
    return len(seen)


def deferred(stream: DataFrame, accepted: Column, *, key: str) -> DataFrame:
    """Rows that pass come out at once; those that don't wait, and stand in for keys of which none has passed once the stream is
    exhausted (ST10, ST12): the first by all columns. Adds ``tier`` (0 passed, 1 promoted).

    Each batch replaces itself if it runs again; nothing is held in memory.
    """
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "deferred")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("tier", F.when(accepted, 0).otherwise(1)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{path}/log").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    passed = rows.where("tier = 0")
    waiting = rows.where("tier = 1").join(passed.select(key).distinct(), key, "left_anti")
    others = [c for c in rows.columns if c != key]
    return passed.unionByName(waiting.groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, "r.*").select(*rows.columns))


def prefixes(stream: DataFrame, *, key: str, time: str, size: str, delay: str) -> DataFrame:
    """Closed windows only (ST1): a window comes out once the watermark, ``delay`` behind the latest row, has passed its end."""
    return owned_counts(stream, key=key, time=time, size=size, delay=delay)


def _marked(stream: DataFrame, time: str, delay: str | None) -> DataFrame:
    """A stream has one watermark; without ``delay`` it is there already."""
    return stream if delay is None else stream.withWatermark(time, delay)


def sessions(stream: DataFrame, *, key: str, time: str, gap: str, delay: str | None) -> DataFrame:
    """Sessions per key that close after ``gap`` without a row; rows later than ``delay`` are passed over (ST9)."""
    s = _marked(stream, time, delay).groupBy(key, F.session_window(time, gap))
    return s.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).select(key, "first", "last", "n")


def owned_counts(stream: DataFrame, *, key: str, time: str, size: str, delay: str | None) -> DataFrame:
    """Rows per key and tumbling window; each row belongs to the window that holds its time (ST3, C10)."""
    w = _marked(stream, time, delay).groupBy(key, F.window(time, size).alias("w"))
    return w.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def entities(stream: DataFrame, *, key: str, time: str, row: str, lifetime: int, delay: str = "1 second") -> DataFrame:
    """The entity of each row: one lives until ``lifetime`` microseconds pass without a row of its key (ST6, ST18).

    An entity is known by its first time in microseconds. Rows of a batch are taken in order of time; the state of a key is
    the entity's first and latest time, and a late row never moves the latest time back. State is dropped once the
    watermark (``delay`` behind the latest row) has passed the lifetime, so only living entities are kept. Result: key,
    row, entity. A row that comes later than its neighbours, yet before the watermark, joins the entity it lies in or leads
    one of its own.
    """
    types = dict(stream.dtypes)

    def follow(name, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        first, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["us", row], kind="stable")
        us, out = rows["us"].tolist(), []
        for t in us:
            if last is None or t - last > lifetime:
                first = last = t
            elif t < first - lifetime:
                # too late for the living entity: one that is gone
                out.append(t)
                continue
            out.append(first)
            last = max(last, t)
        if last is not None:
            state.update((first, last))
            state.setTimeoutTimestamp(max(last // 1000 + lifetime // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: name[0], row: rows[row], "entity": out})

    timed = stream.withWatermark(time, delay).select(key, row, time, F.unix_micros(time).alias("us"))
    return timed.groupBy(key).applyInPandasWithState(follow, f"{key} {types[key]}, {row} {types[row]}, entity bigint", "first bigint, last bigint", "append", "EventTimeTimeout")
