"""Pairs of boxes within groups: equal ones count as one, so that work grows with the different boxes and with the result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.storage import cut_lineage

_XYWH = ("x", "y", "w", "h")
_CORNERS = ["x1", "y1", "x2", "y2"]


def overlapping(df: DataFrame, *, group: str, key: str, measure, least: float, block_rows: int = 512) -> DataFrame:
    """Pairs of rows of a group whose boxes (x, y, w, h) have a ``measure`` of at least ``least``: ``key`` < other, iou.

    ``measure(x, y, w, h, x2, y2, w2, h2)`` gives a column that is the same for both orders of a pair. Repeated rows give
    repeated pairs; rows without a key or a group take no part.

    Plan: equal boxes become one row with their keys; the different boxes of a group are cut into blocks by hash, each block
    meets all of its group, and only what is above the limit is spread to keys again. A hot group spreads over its blocks.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("key"), *_XYWH)
    once = cut_lineage(rows.groupBy("g", *_XYWH).agg(F.collect_list("key").alias("keys")).withColumn("i", F.monotonically_increasing_id()))
    sizes = once.groupBy("g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    total = sizes.agg(F.sum("blocks")).first()[0] or 0
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 8))
    cut = once.join(sizes, "g")
    left = cut.withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int")).drop("blocks").repartition(tasks, "g", "block")
    right = cut.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}2") for c in ("i", "keys", *_XYWH)]).repartition(tasks, "g", "block")
    value = measure(*[F.col(c) for c in _XYWH], *[F.col(f"{c}2") for c in _XYWH])
    met = left.hint("merge").join(right, ["g", "block"]).where("i <= i2").withColumn("iou", value).where(F.col("iou") >= least)
    spread = met.select(F.explode("keys").alias("a"), "keys2", "iou", (F.col("i") == F.col("i2")).alias("same")).select("a", F.explode("keys2").alias("b"), "iou", "same")
    # within one box a pair comes in both orders
    return spread.where("a < b or (a > b and not same)").select(F.least("a", "b").alias(key), F.greatest("a", "b").alias("other"), "iou")


def _held(boxes: np.ndarray, weight: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of different boxes (corners): those that other boxes of a total weight of ``most`` at most hold, and that weight.

    Whatever holds such a box is among them, so the weight is exact. A box is compared with these only: where one that is
    left out holds it, those that hold that one are too many already.
    """
    with np.errstate(invalid="ignore"):
        extent = (boxes[:, 2] - boxes[:, 0]) + (boxes[:, 3] - boxes[:, 1])
    # what holds a box comes before it, also where rounding makes the extents equal
    order = np.lexsort((-boxes[:, 3], -boxes[:, 2], boxes[:, 1], boxes[:, 0], -extent))
    kept, held = np.zeros(0, "int64"), np.zeros(0)
    for start in range(0, len(order), 512):
        at, count = order[start : start + 512], 0.0
        for part in range(0, len(kept), 8192):
            count = count + _holds(boxes[kept[part : part + 8192]], boxes[at]) @ weight[kept[part : part + 8192]]
        on = np.broadcast_to(count, len(at)) <= most
        at, count = at[on], np.broadcast_to(count, len(on))[on]
        inner = _holds(boxes[at], boxes[at])
        np.fill_diagonal(inner, False)
        count = count + inner @ weight[at]
        on = count <= most
        kept, held = np.concatenate([kept, at[on]]), np.concatenate([held, count[on]])
    return kept, held


def _holds(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """A row for each inner box, a column for each outer one."""
    a, o = inner[:, :, None], outer.T[None]
    return (a[:, 0] >= o[:, 0]) & (a[:, 1] >= o[:, 1]) & (a[:, 2] <= o[:, 2]) & (a[:, 3] <= o[:, 3])


def _distinct(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different boxes, each row's box, and how many rows a box has."""
    boxes, which = np.unique(rows[_CORNERS].to_numpy("float64"), axis=0, return_inverse=True)
    return boxes, which.ravel(), np.bincount(which.ravel(), minlength=len(boxes)).astype("float64")


def sole_owner(df: DataFrame, *, group: str, key: str, piece_rows: int = 16_384) -> DataFrame:
    """Rows whose box (x, y, w, h) exactly one row of another key of the group holds: ``key``, owner.

    Equal boxes hold each other. Rows of one key count together. Rows without a key, a group or a whole box take no part.

    Plan: a group is cut into pieces by hash of the key, and what more boxes of its piece hold than matter is left out; what
    is left of a group is settled in one task. What is left out matters to no other row (see :func:`_held`).
    """
    types = dict(df.dtypes)
    corner = {"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")}
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("key"), *[c.cast("double").alias(n) for n, c in corner.items()]).dropna()
    by_key = rows.groupBy("g", "key").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum("n").alias("rows"), F.max("n").alias("same"))
    largest, same = by_key.agg(F.max("rows"), F.max("same")).first()
    pieces, most = -(-(largest or 1) // piece_rows), int(same or 1) + 1

    def thin(rows: pd.DataFrame) -> pd.DataFrame:
        boxes, which, weight = _distinct(rows)
        near = np.isin(which, _held(boxes, weight, most)[0])
        # a key that has lost a row has too many owners, its other rows may still own
        lost = rows[~near & (same > 1)].drop_duplicates("key").assign(**dict.fromkeys(_CORNERS, np.nan))
        return pd.concat([rows[near], lost])[["g", "key", *_CORNERS]]

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        lost, rows = rows["key"][rows["x1"].isna()], rows[rows["x1"].notna()]
        boxes, which, weight = _distinct(rows)
        kept, held = _held(boxes, weight, most)
        few = kept[held + weight[kept] <= most]
        pairs = [np.zeros((0, 2), "int64")]
        for start in range(0, len(few), 512):
            at = few[start : start + 512]
            for part in range(0, len(kept), 8192):
                i, j = np.nonzero(_holds(boxes[kept[part : part + 8192]], boxes[at]))
                pairs.append(np.column_stack([at[i], kept[part + j]]))
        inner, outer = np.concatenate(pairs).T
        own = pd.DataFrame({"key": rows["key"].to_numpy(), "box": which})
        # a key all of whose rows have few owners
        own_few = own[~own["key"].isin(set(own["key"][~np.isin(which, few)]) | set(lost))]
        both = pd.DataFrame({"box": inner, "outer": outer}).merge(own_few, on="box").merge(own.rename(columns={"box": "outer", "key": "owner"}), on="outer")
        both = both[both["key"] != both["owner"]]
        return both[~both["key"].duplicated(keep=False)][["key", "owner"]]

    corners = ", ".join(f"{c} double" for c in _CORNERS)
    piece: Column = F.pmod(F.xxhash64("key"), F.lit(pieces)).alias("piece")
    left = rows.groupBy("g", piece).applyInPandas(thin, f"g {types[group]}, key {types[key]}, {corners}") if pieces > 1 else rows
    return left.groupBy("g").applyInPandas(settle, f"key {types[key]}, owner {types[key]}").select(F.col("key").alias(key), "owner")
