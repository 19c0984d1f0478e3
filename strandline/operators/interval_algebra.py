"""Set operations on intervals (key, s, e), half-open, whole numbers. No interval list is ever an array of unbounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered_scan import running
from strandline.operators.periods import periods_and_gaps


def union(df: DataFrame, key: str) -> DataFrame:
    """Disjoint periods of overlapping or touching intervals (SI1): key, s, e."""
    return periods_and_gaps(df, [key], "s", "e").where("kind = 'period'").select(key, F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))


def exposure(df: DataFrame, key: str) -> DataFrame:
    """Length of the union per key (AG1)."""
    return union(df, key).groupBy(key).agg(F.sum(F.col("e") - F.col("s")).alias("exposure"))


def difference(df: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """What remains of one range (key, lo, hi) per key without the intervals (SI2, SI3): key, s, e."""
    gaps = periods_and_gaps(df, [key], "s", "e")
    ends = gaps.where("kind = 'period'").groupBy(key).agg(F.min("start_ms").alias("first"), F.max("end_ms").alias("last"))
    inner = gaps.where("kind = 'gap'").join(ranges, key).select(key, F.greatest("start_ms", "lo").alias("s"), F.least("end_ms", "hi").alias("e"))
    outer = ranges.join(ends, key, "left").select(key, F.explode(F.array(F.struct(F.col("lo").alias("s"), F.least("hi", F.coalesce("first", "hi")).alias("e")), F.struct(F.greatest(F.col("lo"), F.col("last")).alias("s"), F.when(F.col("last").isNotNull(), F.col("hi")).alias("e")))).alias("x")).select(key, "x.s", "x.e")
    return inner.unionByName(outer).where("e > s")


#: Intervals over more buckets than this are cut by buckets so many times as wide.
LONG = 64


def overlap_join(left: DataFrame, right: DataFrame, key: str, *, width: int, pad: int = 0) -> DataFrame:
    """Pairs (id, other) of intervals of the same key that overlap, or lie within ``pad`` of each other (JN31, MTH7).

    Both sides are cut into buckets of ``width``; a pair is found in the bucket where the later of the two begins, so none
    is found twice. A bucket is a hash key, so there is no nested loop; AQE splits a hot one. Pairs with a long interval are
    joined by wider buckets, so that no interval becomes very many rows.
    """
    le = left.select(key, F.col("id"), (F.col("s") - pad).alias("s"), (F.col("e") + pad).alias("e")).where("e > s")
    ri = right.select(key, F.col("id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2")).where("e2 > s2")
    long = lambda a, b: F.col(b) - F.col(a) > LONG * width

    def joined(one: DataFrame, two: DataFrame, wide: int) -> DataFrame:
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / wide), F.floor((F.col(b) - 1) / wide)))
        both = one.withColumn("cell", cells("s", "e")).join(two.withColumn("cell", cells("s2", "e2")), [key, "cell"])
        return both.where((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) & (F.floor(F.greatest("s", "s2") / wide) == F.col("cell"))).select(key, "id", "other")

    short_le, short_ri = le.where(~long("s", "e")), ri.where(~long("s2", "e2"))
    pairs = joined(short_le, short_ri, width).unionByName(joined(le.where(long("s", "e")), ri, LONG * width))
    return pairs.unionByName(joined(short_le, ri.where(long("s2", "e2")), LONG * width))


def without_overlap(left: DataFrame, right: DataFrame, key: str, *, width: int, pad: int = 0) -> DataFrame:
    """Left intervals that touch no right one within ``pad`` (JN31, JN32)."""
    return left.join(overlap_join(left, right, key, width=width, pad=pad).select("id").distinct(), "id", "left_anti")


def contained(points: DataFrame, spans: DataFrame, key: str, *, width: int) -> DataFrame:
    """(id, other): points (key, id, t) in half-open spans (key, id, s, e), the earliest span each (JN9, FIL15)."""
    cells = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)))
    sp = spans.where("e > s").select(key, F.col("id").alias("other"), "s", "e").withColumn("cell", cells)
    hit = points.select(key, "id", "t").withColumn("cell", F.floor(F.col("t") / width)).join(sp, [key, "cell"]).where("t >= s and t < e")
    return hit.groupBy("id").agg(F.min(F.struct("s", "other")).alias("m")).select("id", F.col("m.other").alias("other"))


def chunk_owner(df: DataFrame, size: int) -> DataFrame:
    """Adds the number of the chunk whose core holds the middle of the interval (SI6, C10)."""
    return df.withColumn("chunk", F.floor((F.col("s") + F.col("e")) / (2 * size)))


def ranked_exposure(exposures: DataFrame, *, least: int, target: float) -> DataFrame:
    """Keys by exposure (largest first), with the main ones (C9, AG13): key, exposure, rank, is_main.

    Scanning by rank, an eligible key (at least ``least``) is main while the eligible keys before it cover less than
    ``target`` of all. One row per key; only their order is global.
    """
    total = exposures.agg(F.sum("exposure")).first()[0] or 0
    ranked = exposures.withColumn("__o", -F.col("exposure")).withColumn("__one", F.lit(1).cast("bigint")).withColumn("__e", F.when(F.col("exposure") >= least, F.col("exposure")).otherwise(0))
    ranked = running(running(ranked, ["__o", "series"], "__e", "__before"), ["__o", "series"], "__one", "__rank")
    return ranked.select("series", "exposure", (F.col("__rank") + 1).cast("int").alias("rank"), ((F.col("exposure") >= least) & (F.col("__before") < total * target)).alias("is_main"))
