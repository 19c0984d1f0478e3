"""Minimum spanning forests by Borůvka's method, distributed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.storage import cut_lineage

#: So few contracted edges are finished in one task (some megabytes); above it every round is distributed.
ONE_TASK_EDGES = 50_000
EDGE = "u bigint, v bigint, w double"


def forest_of(edges: pd.DataFrame, floors: dict | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Which rows (u, v, w) belong to the minimum spanning forest; ties go by (w, u, v). Borůvka's rounds in numpy.

    ``floors`` says of a node from which weight on it may have edges that aren't given: a component takes its lightest
    edge only up to the lowest floor in it, by ``weights`` where ``w`` only tells the order.
    """
    if not len(edges):
        return np.zeros(0, bool)
    nodes, flat = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    a, b = flat[: len(edges)], flat[len(edges) :]
    floor = np.array([floors[x] for x in nodes.tolist()]) if floors else np.full(len(nodes), np.inf)
    rank, weight = np.empty(len(edges), "int64"), edges["w"].to_numpy() if weights is None else weights
    low, high = np.minimum(edges["u"], edges["v"]).to_numpy(), np.maximum(edges["u"], edges["v"]).to_numpy()
    rank[np.lexsort((high, low, edges["w"].to_numpy()))] = np.arange(len(edges))
    at_rank = np.argsort(rank)
    label, chosen = np.arange(len(nodes)), np.zeros(len(edges), bool)
    live = np.flatnonzero(a != b)
    while len(live):
        best = np.full(len(nodes), len(edges), "int64")
        np.minimum.at(best, label[a[live]], rank[live])
        np.minimum.at(best, label[b[live]], rank[live])
        heads = np.flatnonzero(best < len(edges))
        heads = heads[weight[at_rank[best[heads]]] <= floor[heads]]
        if not len(heads):
            break
        edge = at_rank[best[heads]]
        chosen[edge] = True
        parent = np.arange(len(nodes))
        parent[heads] = np.where(label[a[edge]] == heads, label[b[edge]], label[a[edge]])
        # two that chose each other: the smaller is the root
        mutual = (parent[parent] == np.arange(len(nodes))) & (np.arange(len(nodes)) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        label, lowest = parent[label], np.full(len(nodes), np.inf)
        np.minimum.at(lowest, parent, floor)
        floor = lowest
        live = live[label[a[live]] != label[b[live]]]
    return chosen


def local_forest(edges: pd.DataFrame) -> pd.DataFrame:
    """The rows that may be in the forest of any larger graph: an edge that is the heaviest of a cycle never is."""
    return edges[forest_of(edges)]


def _settle(parent: DataFrame) -> DataFrame:
    """(c, p) until p is a root: pointer jumping."""
    while True:
        up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        parent = cut_lineage(parent.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        if not parent.where("moved").limit(1).count():
            return parent.select("c", "p")
        parent = parent.select("c", "p")


def contracted(edges: DataFrame, labels: DataFrame | None, floors: DataFrame | None) -> DataFrame:
    """Edges (u, v, w) between components (node, comp), the lightest of each two, with the components' floors (node, floor).

    A node without a label is a component of its own. Result: cu < cv, w, u, v, fu, fv.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    live = edges.where("u != v").select(low.alias("u"), high.alias("v"), "w").withColumns({"cu": F.col("u"), "cv": F.col("v")})
    known = floors.select(F.col("node").alias("c"), "floor") if floors is not None else None
    if labels is not None:
        for side in ("u", "v"):
            to = labels.select(F.col("node").alias(side), F.col("comp").alias("to"))
            live = live.join(to, side, "left").withColumn(f"c{side}", F.coalesce("to", f"c{side}")).drop("to")
        if known is not None:
            known = known.join(labels.withColumnRenamed("node", "c"), "c", "left").groupBy(F.coalesce("comp", "c").alias("c")).agg(F.min("floor").alias("floor"))
    live = live.where("cu != cv").groupBy(F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
    live = live.select("cu", "cv", "e.w", "e.u", "e.v")
    for side in ("u", "v"):
        if known is None:
            live = live.withColumn(f"f{side}", F.lit(float("inf")))
        else:
            live = live.join(known.select(F.col("c").alias(f"c{side}"), F.col("floor").alias(f"f{side}")), f"c{side}", "left").fillna({f"f{side}": float("inf")})
    return live.select("cu", "cv", "w", "u", "v", "fu", "fv")


def lightest(live: DataFrame) -> DataFrame:
    """Of each component its lightest edge and its floor: c, e (w, u, v, o), f."""
    sides = [live.select(F.col(f"c{x}").alias("c"), F.col(f"c{y}").alias("o"), "w", "u", "v", F.col(f"f{x}").alias("f")) for x, y in ("uv", "vu")]
    return sides[0].unionByName(sides[1]).groupBy("c").agg(F.min(F.struct("w", "u", "v", "o")).alias("e"), F.min("f").alias("f"))


def boruvka(live: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """The edges (u, v, w) that components take, round by round, as long as their lightest edge is at most their floor.

    Plan: each round takes the lightest edge of each component (map-side minimum first), hooks the components together,
    finds their roots by pointer jumping and keeps the lightest edge between each two components. Each round at least
    halves the components that may go on. Tables of a round are cut from their lineage in the shared folder. Once
    ``one_task`` edges or fewer are left, one task does the same rounds in memory.
    """
    chosen, live = None, cut_lineage(live)
    while live.count() > one_task:
        best = lightest(live)
        best = cut_lineage(best.select("c", F.when(F.col("e.w") <= F.col("f"), F.col("e.o")).otherwise(F.col("c")).alias("p"), "e.w", "e.u", "e.v", "f"))
        taken = best.where("p != c").select("u", "v", "w").distinct()
        if not taken.limit(1).count():
            return chosen if chosen is not None else taken
        chosen = taken if chosen is None else chosen.unionByName(taken)
        back = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        mutual = (F.col("pp") == F.col("c")) & (F.col("c") < F.col("p"))
        root = _settle(cut_lineage(best.join(back, "p", "left").select("c", F.when(mutual, F.col("c")).otherwise(F.col("p")).alias("p"))))
        floor = root.join(best.select("c", "f"), "c").groupBy("p").agg(F.min("f").alias("f"))
        root = root.join(floor, "p")
        for x in "uv":
            live = live.drop(f"f{x}").join(root.select(F.col("c").alias(f"c{x}"), F.col("p").alias(f"p{x}"), F.col("f").alias(f"f{x}")), f"c{x}")
        swap = F.col("pu") > F.col("pv")
        live = live.where("pu != pv").select(
            F.least("pu", "pv").alias("cu"), F.greatest("pu", "pv").alias("cv"), "w", "u", "v",
            F.when(swap, F.col("fv")).otherwise(F.col("fu")).alias("fu"), F.when(swap, F.col("fu")).otherwise(F.col("fv")).alias("fv"),
        )
        live = live.groupBy("cu", "cv").agg(F.min(F.struct("w", "u", "v")).alias("e"), F.min("fu").alias("fu"), F.min("fv").alias("fv"))
        live = cut_lineage(live.select("cu", "cv", "e.w", "e.u", "e.v", "fu", "fv"))

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        # components stand for nodes; ties still go by the edges' own ends
        rows = rows.sort_values(["w", "u", "v"], kind="stable").reset_index(drop=True)
        floors = dict(zip(rows["cu"].tolist(), rows["fu"].tolist(), strict=True)) | dict(zip(rows["cv"].tolist(), rows["fv"].tolist(), strict=True))
        keep = forest_of(pd.DataFrame({"u": rows["cu"], "v": rows["cv"], "w": np.arange(len(rows))}), floors, rows["w"].to_numpy())
        return rows.loc[keep, ["u", "v", "w"]]

    rest = live.groupBy().applyInPandas(finish, EDGE)
    return rest if chosen is None else chosen.unionByName(rest)


def spanning_forest(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """The minimum spanning forest of (u, v, w): the chosen edges. Repeated and reversed edges and loops do no harm."""
    return boruvka(contracted(edges, None, None), one_task)


def labels_of(forest: DataFrame, one_task: int = ONE_TASK_EDGES, written: bool = False) -> DataFrame:
    """(node, comp) of every node in a forest's edges; comp is the smallest node of the tree. ``written``: it's read from storage."""
    edges = forest.select("u", "v") if written else cut_lineage(forest.select("u", "v"))
    if edges.count() <= one_task:

        def label(rows: pd.DataFrame) -> pd.DataFrame:
            nodes, flat = np.unique(np.concatenate([rows["u"], rows["v"]]), return_inverse=True)
            a, b, own = flat[: len(rows)], flat[len(rows) :], np.arange(len(nodes))
            while True:
                low = np.minimum(own[a], own[b])
                new = own.copy()
                np.minimum.at(new, own[a], low)
                np.minimum.at(new, own[b], low)
                new = new[new]
                new = new[own]
                if np.array_equal(new, own):
                    return pd.DataFrame({"node": nodes, "comp": nodes[own]})
                own = new

        return edges.groupBy().applyInPandas(label, "node bigint, comp bigint")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = cut_lineage(both.select(F.col("u").alias("node")).distinct().withColumn("comp", F.col("node")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("low"))
        hook = labels.join(near, "node").groupBy("comp").agg(F.min(F.least("low", "comp")).alias("p"))
        root = _settle(cut_lineage(hook.select(F.col("comp").alias("c"), "p")))
        new = cut_lineage(labels.join(root.select(F.col("c").alias("comp"), "p"), "comp").select("node", F.col("p").alias("comp"), (F.col("p") != F.col("comp")).alias("moved")))
        labels = new.select("node", "comp")
        if not new.where("moved").limit(1).count():
            return labels
