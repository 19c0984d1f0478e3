"""Time series: downsampling, integrals, as-of lookups, boundaries. Times are whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_first(df: DataFrame, *, series: str, time: str, key: str, step: int) -> DataFrame:
    """The first row of each cell of a regular grid (SRC1), real times kept. Reduced map-side, so a hot series is no hot task."""
    named = F.struct(F.col(time).alias("t"), F.col(key).alias("k"), F.struct(*df.columns).alias("row"))
    return df.where(F.col(time).isNotNull()).groupBy(F.col(series).alias("__s"), F.floor(F.col(time) / step).alias("__cell")).agg(F.min(named).alias("r")).select("r.row.*")


#: Width of the time blocks that a series is cut into, so that a hot series is sorted by many tasks.
BLOCK = 86_400_000_000


def _carried(blocked: DataFrame, series: str, summary: Column, take, back: bool) -> DataFrame:
    """Per (series, __b): what the blocks before (or, if not ``back``, behind) it hand over; one row per block."""
    per = blocked.groupBy(series, "__b").agg(summary.alias("__own"))
    earlier = Window.partitionBy(series).orderBy("__b" if back else F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(series, "__b", take(F.col("__own")).over(earlier).alias("__carry"))


def running_sum(df: DataFrame, *, series: str, time: str, order: list, value: Column, name: str, inclusive: bool, block: int = BLOCK) -> DataFrame:
    """Adds ``name``: the sum over all earlier rows of the series (and the row itself), by blocks of time."""
    blocked = df.withColumn("__v", value).withColumn("__b", F.floor(F.col(time) / block))
    inner = Window.partitionBy(series, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    carried = _carried(blocked, series, F.sum("__v"), F.sum, True)
    zero = F.lit(0).cast("double") if dict(blocked.dtypes)["__v"] == "double" else F.lit(0).cast("bigint")
    return blocked.withColumn("__s", F.sum("__v").over(inner)).join(carried, [series, "__b"]).withColumn(name, F.coalesce("__carry", zero) + F.coalesce("__s", zero)).drop("__v", "__b", "__s", "__carry")


def weights(df: DataFrame, *, series: str, time: str, key: str, interval: int, block: int = BLOCK) -> DataFrame:
    """Adds ``w``: how long a row holds, up to the next row of its series but at most ``interval`` (WN12, WN13)."""
    blocked = df.withColumn("__b", F.floor(F.col(time) / block))
    nxt = F.lead(time).over(Window.partitionBy(series, "__b").orderBy(time, key))
    carried = _carried(blocked, series, F.min(time), lambda x: F.last(x, ignorenulls=True), False)
    held = blocked.withColumn("__n", nxt).join(carried, [series, "__b"])
    return held.withColumn("w", F.least(F.coalesce(F.coalesce("__n", "__carry") - F.col(time), F.lit(interval)), F.lit(interval))).drop("__b", "__n", "__carry")


def integral_means(points: DataFrame, windows: DataFrame, *, interval: int, block: int = BLOCK) -> DataFrame:
    """Mean of a step function over windows (C2): ``points`` (series, us, value, key), ``windows`` (series, a, b).

    A point holds its value until the next one, at most ``interval``; holes count as 0.

    Plan: points and the windows' edges are united and sorted once, by (series, block of time). Within a block windows give
    the next point, the integral so far and the last point; one row per block hands these on to the next blocks. So a hot
    series spreads over its blocks, and rows are shuffled once; only edges are shuffled again, to their windows.
    """
    none = lambda kind: F.lit(None).cast(kind)
    edge = windows.select("series", F.explode(F.array("a", "b")).alias("us"), F.lit(1).alias("tag"), none("bigint").alias("key"), none("double").alias("value"), "a", "b")
    both = points.select("series", "us", F.lit(0).alias("tag"), F.col("key").cast("bigint").alias("key"), F.col("value").cast("double").alias("value"), none("bigint").alias("a"), none("bigint").alias("b")).unionByName(edge)
    both = both.withColumn("__b", F.floor(F.col("us") / block))
    point = F.col("tag") == 0
    ahead = Window.partitionBy("series", "__b").orderBy(F.desc("us"), F.desc("tag"), F.desc("key")).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("series", "__b").orderBy("us", "tag", "key")
    held = F.least(F.last(F.when(point, F.col("us")), ignorenulls=True).over(ahead) - F.col("us"), F.lit(interval))
    both = both.withColumn("w", F.when(point, held)).withColumn("p", F.coalesce(F.sum(F.col("value") * F.col("w")).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    both = both.withColumn("l", F.last(F.when(point, F.struct("us", "value", "w", "p")), ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))

    blocks = both.groupBy("series", "__b").agg(F.min(F.when(point, F.col("us"))).alias("first"), F.max(F.when(point, F.struct("us", "key", "value", "p"))).alias("last"))
    later = Window.partitionBy("series").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("series").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    hold = F.coalesce(F.least(F.last("first", ignorenulls=True).over(later) - F.col("last.us"), F.lit(interval)), F.lit(interval))
    blocks = blocks.withColumn("hold", hold).withColumn("before", F.coalesce(F.sum(F.col("last.p") + F.col("last.value") * F.col("hold")).over(earlier), F.lit(0.0)))
    carry = F.when(F.col("last").isNotNull(), F.struct("last.us", "last.value", F.col("hold").alias("w"), (F.col("before") + F.col("last.p")).alias("p")))
    blocks = blocks.withColumn("c", F.last(carry, ignorenulls=True).over(earlier)).select("series", "__b", "hold", "before", "c")

    at = both.where("tag = 1").join(blocks, ["series", "__b"])
    own = F.struct("l.us", "l.value", F.coalesce("l.w", "hold").alias("w"), (F.col("before") + F.col("l.p")).alias("p"))
    at = at.withColumn("x", F.when(F.col("l").isNotNull(), own).otherwise(F.col("c")))
    value = F.coalesce(F.col("x.p") + F.col("x.value") * F.least(F.col("us") - F.col("x.us"), F.col("x.w")), F.lit(0.0))
    found = at.groupBy("series", "a", "b").agg(F.max(F.when(F.col("us") == F.col("b"), value)).alias("fb"), F.max(F.when(F.col("us") == F.col("a"), value)).alias("fa"))
    return found.select("series", "a", "b", ((F.col("fb") - F.col("fa")) / (F.col("b") - F.col("a"))).alias("mean"))


def as_of(left: DataFrame, right: DataFrame, *, direction: str, tolerance: int | None = None, block: int = BLOCK) -> DataFrame:
    """For each left row (series, us, key) the right row (series, us, key) that is nearest in a direction (JN12, SRC3).

    ``backward`` takes the last at or before, ``forward`` the first at or after, ``nearest`` the nearer of both (the
    earlier of two); of right rows at one time the smallest key. Result: ``series``, ``key``, ``us``, ``found_key``,
    ``found_us``; left rows without one stay, with nulls.

    Plan: both tables are tagged, united and sorted once, by (series, block of time); one row per block hands on the last
    and the first right row, so a hot series is no hot task.
    """
    tag = lambda df, n: df.select("series", "us", "key", F.lit(n).alias("tag"))
    both = tag(right, 0).unionByName(tag(left, 1)).withColumn("__b", F.floor(F.col("us") / block))
    row = F.when(F.col("tag") == 0, F.struct("us", "key"))
    own = lambda order: F.last(row, ignorenulls=True).over(Window.partitionBy("series", "__b").orderBy(order, "tag", F.desc("key")).rowsBetween(Window.unboundedPreceding, 0))
    hand = lambda x, order: F.last(x, ignorenulls=True).over(Window.partitionBy("series").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    last = F.max(F.when(F.col("tag") == 0, F.struct("us", (-F.col("key")).alias("key"))))
    blocks, sides = both.groupBy("series", "__b").agg(last.alias("hi"), F.min(row).alias("lo")), []
    blocks = blocks.withColumn("hi", F.when(F.col("hi").isNotNull(), F.struct("hi.us", (-F.col("hi.key")).alias("key"))))
    if direction in ("backward", "nearest"):
        both, blocks = both.withColumn("b", own(F.col("us"))), blocks.withColumn("cb", hand("hi", "__b"))
        sides.append("b")
    if direction in ("forward", "nearest"):
        both, blocks = both.withColumn("f", own(F.desc("us"))), blocks.withColumn("cf", hand("lo", F.desc("__b")))
        sides.append("f")
    found = both.where("tag = 1").join(blocks.drop("hi", "lo"), ["series", "__b"])
    for x in sides:
        found = found.withColumn(x, F.coalesce(x, f"c{x}"))
    nearer = F.when(F.col("f").isNull() | (F.col("us") - F.col("b.us") <= F.col("f.us") - F.col("us")), F.col("b")).otherwise(F.col("f")) if len(sides) == 2 else F.col(sides[0])
    found = found.withColumn("x", nearer)
    if tolerance is not None:
        found = found.withColumn("x", F.when(F.abs(F.col("x.us") - F.col("us")) <= tolerance, F.col("x")))
    return found.select("series", "key", "us", F.col("x.key").alias("found_key"), F.col("x.us").alias("found_us"))


def boundary_safety(spans: DataFrame, events: DataFrame, *, margin: int, head: int, slack: int, width: int) -> DataFrame:
    """Whether a span (series, key, s, e) starts, runs and ends away from boundary events (series, us) (C3, FIL5).

    Unsafe if an event lies within ``margin`` of either end or inside the protected opening, or if more than one lies
    inside. The range join is bucketed by ``width`` so that it is an equi-join.
    """
    protected = F.least(F.col("e") - F.col("s"), F.greatest(F.lit(head), F.col("e") - F.col("s") - F.least(F.lit(slack), F.floor((F.col("e") - F.col("s")) / 4))))
    spans = spans.withColumn("protected", F.col("s") + protected)
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor((F.col("s") - margin) / width), F.floor((F.col("e") + margin) / width))))
    at = events.select("series", "us").distinct().withColumn("cell", F.floor(F.col("us") / width))
    hit = cells.join(at, ["series", "cell"]).where((F.col("us") >= F.col("s") - margin) & (F.col("us") <= F.col("e") + margin))
    near = (F.abs(F.col("us") - F.col("s")) <= margin) | (F.abs(F.col("us") - F.col("e")) <= margin) | ((F.col("us") > F.col("s")) & (F.col("us") < F.col("protected")))
    inside = (F.col("us") > F.col("s")) & (F.col("us") < F.col("e"))
    counted = hit.groupBy("series", "key").agg(F.count(F.when(near, 1)).alias("bad"), F.count(F.when(inside, 1)).alias("inner"))
    return spans.join(counted, ["series", "key"], "left").select("series", "key", (F.coalesce(F.col("bad"), F.lit(0)) == 0).alias("clear"), ((F.coalesce(F.col("bad"), F.lit(0)) == 0) & (F.coalesce(F.col("inner"), F.lit(0)) <= 1)).alias("safe"))


def majority(values: Column) -> Column:
    """The most frequent element of an array, the earliest of those that tie (WN6)."""
    scored = F.transform(values, lambda x, i: F.struct(F.size(F.filter(values, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(scored)["x"]
