"""Exact similarity within groups, block against block, without forming pairs as rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar_blocks(df: DataFrame, *, group: str, key: str, vector: str, least: float | None = None, k: int | None = None, block_rows: int = 4096) -> DataFrame:
    """For each vector those of its group with a cosine of at least ``least``, or its ``k`` most similar: a, b, c.

    Both directions of a pair come out. Ties of ``k`` (cosines to nine decimals) go to the smaller key. Nulls, vectors of
    no or not finite length, and null keys and groups take no part; a key counts once; an empty table gives an empty
    result.

    Plan: a group is cut into blocks of about ``block_rows`` vectors, by hash; each block of queries meets each block of its
    group in a task of its own, as one matrix product, and only what is asked for leaves the task: all above the limit, or
    ``k`` for each query and block, of which a second step keeps the best. The work grows with the square of a group, as an
    exact search must; a hot group spreads over its pairs of blocks.
    """
    if (least is None) == (k is None):
        raise ValueError("either a least cosine or a number of neighbours")
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).dropna().dropDuplicates(["key"])
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    cut = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = cut.select("g", F.col("own").alias("i"), every.alias("j"), "key", "v")
    right = cut.select(F.col("g").alias("g"), every.alias("i"), F.col("own").alias("j"), F.col("key").alias("key"), F.col("v").alias("v"))

    def units(frame: pd.DataFrame):
        if not len(frame):
            return np.zeros(0, "int64"), np.zeros((0, 1))
        width = int(frame["v"].map(len).mode()[0])
        same = (frame["v"].map(len) == width).to_numpy()
        m = np.stack([np.asarray(x, "float64") for x in frame["v"][same]])
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            norm = np.linalg.norm(m, axis=1)
            ok = np.isfinite(norm) & (norm > 1e-12)
        return frame["key"].to_numpy()[same][ok], m[ok] / norm[ok][:, None]

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        (a, u), (b, w) = units(one), units(two)
        if not len(a) or not len(b) or u.shape[1] != w.shape[1]:
            return pd.DataFrame({"a": a[:0], "b": b[:0], "c": np.zeros(0)})
        c = u @ w.T
        c[a[:, None] == b[None]] = -2
        if least is not None:
            i, j = np.nonzero(c >= least)
        else:
            order = np.lexsort((np.broadcast_to(b, c.shape), -np.round(c, 9)), axis=1)[:, :k]
            i, j = np.repeat(np.arange(len(a)), order.shape[1]), order.ravel()
            on = c[i, j] > -2
            i, j = i[on], j[on]
        return pd.DataFrame({"a": a[i], "b": b[j], "c": c[i, j]})

    found = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInPandas(meet, f"a {kind}, b {kind}, c double")
    if least is not None:
        return found
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("c", 9)).alias("far"), "b", "c"))), 1, k)
    return found.groupBy("a").agg(F.explode(best).alias("x")).select("a", "x.b", "x.c")
