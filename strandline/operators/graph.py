"""Nested structures as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.storage import cut_lineage


def flatten(edges: DataFrame, roots: DataFrame, *, deepest: int = 64) -> DataFrame:
    """All placements below the roots (GR1): ``edges`` (parent, child, start, end, source_in), ``roots`` (node).

    A child's interval is moved by where its parent lies and clipped to the parent's. Result: root, node, s, e, depth,
    path. A cycle is an error. One join per level; a level is cut from its lineage.
    """
    level = roots.select(F.col("node").alias("root"), "node", F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("e"), F.lit(0).cast("bigint").alias("shift"), F.lit(0).alias("depth"), F.array("node").alias("path"))
    out = None
    for _ in range(deepest):
        below = level.join(edges, level["node"] == edges["parent"])
        again = F.array_contains("path", F.col("child"))
        start, end = F.col("start") + F.col("shift"), F.col("end") + F.col("shift")
        s, e = F.greatest(start, F.coalesce("s", start)), F.least(end, F.coalesce("e", end))
        child = F.when(again, F.raise_error(F.concat(F.lit("a cycle at "), F.col("child").cast("string"))).cast("string")).otherwise(F.col("child").cast("string")).cast(dict(edges.dtypes)["child"])
        level = below.select("root", child.alias("node"), s.alias("s"), e.alias("e"), (start - F.col("source_in")).alias("shift"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("child")).alias("path")).where("e > s")
        level = cut_lineage(level)
        if not level.limit(1).count():
            return out if out is not None else level.drop("shift")
        out = level.drop("shift") if out is None else out.unionByName(level.drop("shift"))
    raise ValueError(f"deeper than {deepest} levels")


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to (GR3)."""
    return nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti")
