"""Problem 1: records of two tables paired by the nearest time of the same entity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import cut_lineage

#: A hot cell is cut into so many slices at most; one of 100 million right records has slices of 100,000.
SLICES = 1024
_MAX_CELL = float(2**62)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _cell(t: Column, width: float) -> Column:
    return F.greatest(F.lit(-_MAX_CELL), F.least(F.lit(_MAX_CELL), F.floor(t / width).cast("double"))).cast("bigint")


def _codes(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """One number per (entity, cell, part, salt), the same in both tables."""
    code, n = np.zeros(len(left) + len(right), "int64"), 1
    for c in ("__e", "__cell", "__sub", "__salt"):
        own, values = pd.factorize(pd.concat([left[c], right[c]], ignore_index=True))
        # dense after each column, so that the product stays small
        code, seen = pd.factorize(code * max(len(values), 1) + own)
        n = len(seen)
    del n
    return code[: len(left)], code[len(left) :]


def _match(left: pd.DataFrame, right: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """Vectorised binary search of each left time among the right times of its cell."""
    lc, rc = _codes(left, right)
    order = np.lexsort((right["__rid"].to_numpy(), right["__t"].to_numpy(), rc))
    rc, rt, rid = rc[order], right["__t"].to_numpy()[order], right["__rid"].to_numpy()[order]
    lt = left["__t"].to_numpy()
    start, stop = np.searchsorted(rc, lc, "left"), np.searchsorted(rc, lc, "right")
    low, high = start.copy(), stop.copy()
    last = max(len(rt) - 1, 0)
    for _ in range(int(np.max(stop - start, initial=0)).bit_length()):
        middle = (low + high) // 2
        less = (low < high) & (rt[np.minimum(middle, last)] < lt)
        low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(middle, high))
    before = np.where(low > start, lt - rt[np.maximum(low - 1, 0)], np.inf)
    after = np.where(low < stop, rt[np.minimum(low, last)] - lt, np.inf)
    pick = np.where(before <= after, low - 1, low)
    gap = np.minimum(before, after)
    ok = gap <= tolerance
    return pd.DataFrame({"l": left["__lid"].to_numpy()[ok], "r": rid[pick[ok]], "d": np.where(before <= after, -before, after)[ok]})


def _spread(lt: DataFrame, rt: DataFrame, hot: DataFrame, rows_per_cell: int) -> tuple[DataFrame, DataFrame]:
    """Hot cells are cut at quantiles of their right times, whatever bunch these form. A slice holds its own right records and
    the nearest one on either side of it, which is all that a left record in it can need; left records of a slice are
    salted by their own number."""
    cell, none = ["__e", "__cell"], F.array().cast("array<double>")
    cuts = rt.join(hot, cell).groupBy(*cell).agg(F.percentile_approx("__t", F.lit([i / SLICES for i in range(1, SLICES)]), F.lit(10_000)).alias("q"), F.max("r").alias("r"))
    k = F.least(F.lit(SLICES), F.ceil(F.col("r") / rows_per_cell)).cast("int")
    cuts = hot.select(*cell).join(cuts.withColumn("k", k), cell, "left")
    some = F.when(F.col("k") > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.get("q", (i * SLICES / F.col("k")).cast("int") - 1))))
    cuts = cut_lineage(cuts.select(*cell, F.coalesce(some, none).alias("__q")))
    sliced = lambda df: df.join(cuts, cell, "left").withColumn("__sub", F.size(F.filter(F.coalesce("__q", none), lambda x: x <= F.col("__t"))))
    lt, rt = sliced(lt), sliced(rt)

    per = rt.where("__q is not null").groupBy(*cell, "__sub").agg(F.min(F.struct("__t", "__rid")).alias("lo"), F.max(F.struct("__t", "__rid")).alias("hi"))
    per = per.join(cuts.select(*cell, F.explode(F.sequence(F.lit(0), F.size("__q"))).alias("__sub")), [*cell, "__sub"], "right")
    near = lambda x, order: F.last(x, ignorenulls=True).over(Window.partitionBy(*cell).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    sides = per.select(*cell, "__sub", F.array(near("hi", F.col("__sub")), near("lo", F.desc("__sub"))).alias("near"))
    edges = sides.select(*cell, "__sub", F.explode("near").alias("x")).where("x is not null").select(*cell, "__sub", "x.*")
    rt = rt.drop("__q").unionByName(edges)

    salts = cut_lineage(lt.where("__q is not null").groupBy(*cell, "__sub").agg(F.ceil(F.count("*") / rows_per_cell).cast("int").alias("__s")))
    lt = lt.drop("__q").join(salts, [*cell, "__sub"], "left").withColumn("__salt", F.pmod(F.xxhash64("__lid"), F.coalesce("__s", F.lit(1))).cast("int")).drop("__s")
    rt = rt.join(salts, [*cell, "__sub"], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__s", F.lit(1)) - 1))).drop("__s")
    return lt, rt


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    entity: str,
    left_id: str,
    left_time: str,
    right_id: str,
    right_time: str,
    tolerance: float,
    width: float = 512.0,
    rows_per_cell: int = 100_000,
    rows_per_group: int = 400_000,
) -> DataFrame:
    """For each left record the right record of the same entity whose time lies nearest, if within ``tolerance``.

    Result: ``left_id``, ``right_id`` (named as in the inputs) and ``delta_sec`` (right time less left time). Other
    columns of either table are not read, so clashing names do no harm.

    Defined cases: a null entity or id and a null, NaN or infinite time take no part; records delivered twice (same id)
    count once; of two right records equally near the earlier wins, at the same time the smaller id; a left record
    without a partner is left out; empty tables give an empty result.

    Plan: right records of the same entity and time are reduced to one before the shuffle. Both tables are cut into
    cells of (entity, ``width`` seconds), right records within the tolerance of an edge go to both cells, and whole
    cells are co-grouped by a hash into groups of about ``rows_per_group`` rows. Cells above ``rows_per_cell`` rows are
    cut further: at quantiles of their right times, and by salt for left records, so no entity or burst fills one task.
    """
    lt = left.select(F.col(entity).alias("__e"), F.col(left_id).alias("__lid"), F.col(left_time).cast("double").alias("__t")).where(_finite(F.col("__t"))).dropna()
    lt = lt.dropDuplicates(["__lid"])
    rt = right.select(F.col(entity).alias("__e"), F.col(right_id).alias("__rid"), F.col(right_time).cast("double").alias("__t")).where(_finite(F.col("__t"))).dropna()
    rt = rt.groupBy("__e", "__t").agg(F.min("__rid").alias("__rid"))
    margin = tolerance * (1 + 1e-9) + 1e-9
    lt = lt.withColumn("__cell", _cell(F.col("__t"), width))
    spread = F.sequence(_cell(F.col("__t") - margin, width), _cell(F.col("__t") + margin, width))

    counted = (
        lt.select("__e", "__cell", F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(rt.select("__e", _cell(F.col("__t"), width).alias("__cell"), F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy("__e", "__cell")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    total, n_hot = counted.agg(F.sum(F.col("l") + F.col("r")), F.count(F.when(F.greatest("l", "r") > rows_per_cell, 1))).first()
    groups = max(1, math.ceil((total or 0) / rows_per_group), int(lt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rt = rt.withColumn("__cell", F.explode(spread))
    if n_hot:
        lt, rt = _spread(lt, rt, counted.where(F.greatest("l", "r") > rows_per_cell).select("__e", "__cell", "r"), rows_per_cell)
    else:
        lt, rt = (x.withColumn("__sub", F.lit(0)).withColumn("__salt", F.lit(0)) for x in (lt, rt))
    group = F.pmod(F.xxhash64("__e", "__cell", "__sub", "__salt"), F.lit(groups)).alias("__g")
    lt, rt = lt.select("*", group), rt.select("*", group)
    lid, rid = (df.schema[c].dataType.simpleString() for df, c in ((left, left_id), (right, right_id)))

    def pair(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(other):
            return pd.DataFrame({"l": own["__lid"].iloc[:0], "r": other["__rid"].iloc[:0], "d": np.array([], "float64")})
        return _match(own, other, tolerance)

    found = lt.groupBy("__g").cogroup(rt.groupBy("__g")).applyInPandas(pair, f"l {lid}, r {rid}, d double")
    return found.select(F.col("l").alias(left_id), F.col("r").alias(right_id), F.col("d").alias("delta_sec"))
