"""The condensed hierarchy of spanning trees of any size, and the choice of stable clusters from it.

A tree's edges, light to heavy, give its single-linkage hierarchy. Walking down, a side below ``least_size`` falls out of a
cluster, two larger sides split it. Of a part of the hierarchy only four numbers matter to what lies above: its size ``n``,
``s`` (the sum over its records of the rate, 1/distance, at which they leave the cluster that reaches into it), ``t`` (the
stability of what is best chosen below the first split in it) and ``x`` (the rate of that split). A cluster born at a rate
b has the stability s - b n. So a tree that is too large for one task is solved in parts, from the light ones up, and decided
from the heavy ones down, with the same result as in one piece.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.spanning import labels_of
from strandline.operators.ordered_scan import running
from strandline.storage import cut_lineage

#: Small trees share a task of about so many edges.
EDGES_PER_TASK = 5_000


def rate(distance: float) -> float:
    return 1 / max(distance, 1e-6)


class Hierarchy:
    """One tree, or a part of one: items are records, or parts that were solved before (with their n, s, t, x)."""

    def __init__(self, items: np.ndarray, n, s, t, x, u, v, w, order, least_size: int):
        at, k = {int(i): j for j, i in enumerate(items)}, len(items)
        self.items, self.k, self.least = items, k, least_size
        self.n, self.s, self.t, self.x = ([float(y) for y in z] for z in (n, s, t, x))
        self.left, self.right, self.rate = [], [], []
        #: the rate at which an item's part reaches the least size, where that happens here
        self.leaves_at = np.full(k, np.nan)
        parent, top = list(range(k)), list(range(k))

        def find(y: int) -> int:
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            return y

        for e in order:
            a, b = find(at[int(u[e])]), find(at[int(v[e])])
            self._merge(top[a], top[b], rate(float(w[e])))
            parent[b] = a
            top[a] = k + len(self.left) - 1
        self.root = k + len(self.left) - 1 if self.left else 0

    def _merge(self, a: int, b: int, r: float) -> None:
        n, s, t, x = self.n, self.s, self.t, self.x
        big, size = [y for y in (a, b) if n[y] >= self.least], n[a] + n[b]
        self.left.append(a)
        self.right.append(b)
        self.rate.append(r)
        if len(big) == 2:
            s.append(size * r)
            t.append(sum(max(s[y] - r * n[y], t[y]) for y in big))
            x.append(r)
        elif big:
            s.append((size - n[big[0]]) * r + s[big[0]])
            t.append(t[big[0]])
            x.append(x[big[0]])
        else:
            s.append(size * r)
            t.append(0.0)
            x.append(math.nan)
        n.append(size)
        if size >= self.least:
            for y in (a, b):
                if n[y] < self.least:
                    self.leaves_at[self.under(y)] = r

    def under(self, node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            y = stack.pop()
            if y < self.k:
                out.append(y)
            else:
                stack += (self.left[y - self.k], self.right[y - self.k])
        return out

    def decide(self, mode: str, birth: float, label: str | None, name: str, epsilon: float) -> list[tuple]:
        """(mode, birth, label) of each item. ``start``: a cluster is born with the part, at a rate; ``walk``: a cluster that isn't
        chosen goes on into it, to its first split; ``set``: it belongs to the label, or to none.

        A cluster is chosen if it isn't split, is split below the distance ``epsilon``, or is at least as stable as what is best
        chosen of its inside.
        """
        out: list = [None] * self.k
        stack = [(self.root, mode, birth, label)]
        while stack:
            y, mode, birth, label = stack.pop()
            if y < self.k and mode != "set":
                out[y] = (mode, birth, None)
                continue
            if mode == "start":
                whole = math.isnan(self.x[y]) or self.x[y] > rate(epsilon) or self.s[y] - birth * self.n[y] >= self.t[y]
                mode, label = ("set", f"{name}:{y}") if whole else ("walk", None)
            if mode == "set":
                for i in self.under(y):
                    out[i] = ("set", math.nan, label)
                continue
            sides = (self.left[y - self.k], self.right[y - self.k])
            big = [z for z in sides if self.n[z] >= self.least]
            for z in sides:
                if len(big) == 2:
                    stack.append((z, "start", self.rate[y - self.k], None))
                else:
                    stack.append((z, "walk", math.nan, None) if z in big else (z, "set", math.nan, None))
        return out


def _trees(rows: pd.DataFrame, least_size: int):
    """Each tree of a frame: its number of the first row, its hierarchy, and which items are parts."""
    col = {c: rows[c].to_numpy() for c in rows.columns}
    lo, hi = np.minimum(col["ou"], col["ov"]), np.maximum(col["ou"], col["ov"])
    order = np.lexsort((hi, lo, col["w"], col["level"], col["tree"]))
    tree, level = col["tree"][order], col["level"][order]
    first = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (level[1:] != level[:-1]))) if len(order) else []
    for at in np.split(order, first[1:]) if len(order) else []:
        u, v = col["u"][at], col["v"][at]
        items, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        own = {}
        for c in "nstxb":
            own[c] = np.empty(len(items))
            own[c][place] = np.concatenate([col[f"u{c}"][at], col[f"v{c}"][at]])
        yield at[0], Hierarchy(items, *(own[c] for c in "nstx"), u, v, col["w"][at], range(len(at)), least_size), own["b"] > 0


_SUMMARY = "tree bigint, level int, n double, s double, t double, x double"
_ITEM = "item bigint, part boolean, mode string, birth double, label string, leaves double"


def _up(least_size: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names = rows["tree"].to_numpy(), rows["level"].to_numpy()
        out = [(names[0][i], names[1][i], h.n[h.root], h.s[h.root], h.t[h.root], h.x[h.root]) for i, h, _ in _trees(rows, least_size)]
        return pd.DataFrame(out, columns=["tree", "level", *"nstx"])

    return solve


def _down(least_size: int, epsilon: float, stage: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        given = {c: rows[c].tolist() for c in ("tree", "level", "mode", "birth", "label", "leaves")}
        out: dict[str, list] = {c.split()[0]: [] for c in _ITEM.split(", ")}
        for i, h, part in _trees(rows, least_size):
            mode = given["mode"][i] if given["mode"][i] != "start" or h.n[h.root] >= least_size else "set"
            got = h.decide(mode, given["birth"][i], given["label"][i], f"{given['tree'][i]}:{given['level'][i]}:{stage}", epsilon)
            out["item"] += h.items.tolist()
            out["part"] += part.tolist()
            for c, values in zip(("mode", "birth", "label"), zip(*got, strict=True), strict=True):
                out[c] += values
            # what is still small here leaves where the part as a whole does
            out["leaves"] += np.where(np.isnan(h.leaves_at), given["leaves"][i], h.leaves_at).tolist()
        return pd.DataFrame(out)

    return solve


def _side_by_side(frame: DataFrame, edges: int, solve, schema: str) -> DataFrame:
    tasks = max(1, math.ceil(edges / EDGES_PER_TASK))
    group = F.pmod(F.xxhash64("tree", "level"), F.lit(tasks))
    return frame.withColumn("g", group).repartition(tasks, "g").groupBy("g").applyInPandas(lambda rows: solve(rows.drop(columns=["g"])), schema)


def _stages(edges: DataFrame, tree_edges: int, one_task: int) -> list[DataFrame]:
    """Edges (tree, level, u, v, w, ou, ov, ub, vb) in stages: of a tree that is too large the heaviest ``tree_edges`` make up a
    stage, whose items are the parts that the others leave; these are trees of a later stage, called by their smallest record
    and a level: the number of the stage, from 1, that they are parts of (0 for whole trees)."""
    plain = lambda df: df.select("tree", "level", "u", "v", "w", F.col("u").alias("ou"), F.col("v").alias("ov"), F.lit(False).alias("ub"), F.lit(False).alias("vb"))
    out, edges = [], edges.withColumn("level", F.lit(0))
    while True:
        sizes = edges.groupBy("tree", "level").agg(F.count("*").alias("k"))
        if (sizes.agg(F.max("k")).first()[0] or 0) <= tree_edges:
            return [*out, plain(edges)]
        large = cut_lineage(sizes.where(F.col("k") > tree_edges))
        name = ["tree", "level"]
        own = edges.join(large.select(*name), name, "left_semi").select("tree", "level", "u", "v", "w", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), F.lit(1).cast("bigint").alias("one"))
        placed = cut_lineage(running(own, ["tree", "level", "w", "lo", "hi"], "one", "at"))
        ends = placed.groupBy(*name).agg(F.max("at").alias("end"))
        placed = cut_lineage(placed.join(ends, name).select("tree", "level", "u", "v", "w", (F.col("at") > F.col("end") - tree_edges).alias("heavy")))
        low = placed.where("not heavy").select("u", "v", "w")
        part = cut_lineage(labels_of(low, one_task))
        heavy = plain(placed.where("heavy"))
        for side in ("u", "v"):
            to = part.select(F.col("node").alias(side), F.col("comp").alias("to"))
            heavy = heavy.join(to, side, "left").withColumn(f"{side}b", F.col("to").isNotNull()).withColumn(side, F.coalesce("to", side)).drop("to")
        out.append(cut_lineage(heavy.select("tree", "level", "u", "v", "w", "ou", "ov", "ub", "vb")))
        below = low.join(part.select(F.col("node").alias("u"), F.col("comp").alias("tree")), "u").select("tree", F.lit(len(out)).alias("level"), "u", "v", "w")
        edges = cut_lineage(edges.join(large.select(*name), name, "left_anti").select("tree", "level", "u", "v", "w").unionByName(below))


def stable_clusters(edges: DataFrame, *, radius: float, epsilon: float, least_size: int, tree_edges: int, one_task: int) -> DataFrame:
    """Of spanning trees (tree, u, v, w), read from storage, the chosen clusters: ``node``, ``cluster`` (its smallest node), ``persistence`` (the rate at
    which the record falls out), ``typical`` (the most persistent). Records in no cluster don't come out.

    Plan: trees are solved side by side, many small ones to a task; a tree of more than ``tree_edges`` edges in stages (see
    above), with the same result. Ids are whole numbers.
    """
    stages = _stages(edges, tree_edges, one_task)
    known, solved = None, [None] * len(stages)
    for i in range(len(stages) - 1, -1, -1):
        frame = stages[i]
        for side in ("u", "v"):
            own = {c: F.lit(v) for c, v in (("n", 1.0), ("s", 0.0), ("t", 0.0), ("x", math.nan))}
            if known is None:
                frame = frame.withColumns({f"{side}{c}": v for c, v in own.items()})
            else:
                to = known.where(F.col("level") == i + 1).select(F.col("tree").alias(side), F.lit(True).alias(f"{side}b"), *[F.col(c).alias(f"{side}{c}") for c in "nstx"])
                frame = frame.join(to, [side, f"{side}b"], "left").withColumns({f"{side}{c}": F.coalesce(f"{side}{c}", v) for c, v in own.items()})
        solved[i] = frame if known is None else cut_lineage(frame)
        if i:
            up = cut_lineage(_side_by_side(solved[i], stages[i].count(), _up(least_size), _SUMMARY))
            known = up if known is None else known.unionByName(up)
    given, points = None, None
    for i, frame in enumerate(solved):
        start = {"mode": F.lit("start"), "birth": F.lit(rate(radius)), "label": F.lit(None).cast("string"), "leaves": F.lit(math.nan)}
        if given is None:
            frame = frame.withColumns(start)
        else:
            frame = frame.join(given, ["tree", "level"], "left")
            # a tree that is no part of another is a whole one
            frame = frame.withColumns({c: F.when(F.col("mode").isNull(), v).otherwise(F.col(c)) for c, v in start.items() if c != "mode"} | {"mode": F.coalesce("mode", start["mode"])})
        got = _side_by_side(frame, stages[i].count(), _down(least_size, epsilon, i), _ITEM)
        if len(stages) > 1:
            got = cut_lineage(got)
        inner = got.where("part").select(F.col("item").alias("tree"), F.lit(i + 1).alias("level"), "mode", "birth", "label", "leaves")
        given = inner if given is None else given.unionByName(inner)
        own = got.where("not part and label is not null").select(F.col("item").alias("node"), "label", F.col("leaves").alias("persistence"))
        points = own if points is None else points.unionByName(own)
    points = cut_lineage(points)
    best = points.groupBy("label").agg(F.min("node").alias("cluster"), F.max("persistence").alias("best"))
    return points.join(best, "label").select("node", "cluster", "persistence", (F.col("persistence") >= F.col("best") * (1 - 1e-9)).alias("typical"))
