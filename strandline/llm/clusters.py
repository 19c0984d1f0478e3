"""Problem 2: clusters of mutually similar records, by hierarchical density clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.hierarchy import stable_clusters
from strandline.llm.spanning import EDGE, ONE_TASK_EDGES, boruvka, contracted, labels_of, lightest, local_forest
from strandline.llm.vectors import SearchSettings, build_index, neighbours, nested, unit, usable
from strandline.storage import cut_lineage

#: Trees of more edges than this are solved in parts.
TREE_EDGES = 200_000


def mean_vectors(batch, key: str, vectors: str, dims: int, group: str | None = None, asks: str | None = None) -> tuple[np.ndarray, ...]:
    """Keys, groups (the keys, if not given), per row the mean of its usable vectors, each first scaled to length 1, and
    whether it asks (all, if not given); rows without a mean are left out."""
    ids = batch.column(key)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    own = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    groups = own if group is None else batch.column(group).to_numpy(zero_copy_only=False).astype("int64")
    rows, _, inner = nested(batch.column(vectors))
    good, values = usable(inner, dims)
    row = rows[good]
    keep = known[row]
    row, values = row[keep], unit(values[keep]) if len(values) else values
    wants = np.ones(len(own), bool) if asks is None else batch.column(asks).to_numpy(zero_copy_only=False).astype(bool)
    if not len(row):
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros((0, dims), "float32"), np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    mean = (np.add.reduceat(values, first) / np.diff(np.append(first, len(row)))[:, None]).astype("float32")
    ok = (mean != 0).any(1)
    return own[row[first]][ok], groups[row[first]][ok], mean[ok], wants[row[first]][ok]


def density_forest(source: DataFrame, *, key: str, vectors: str, radius: float, k: int, least_points: int, dims: int, one_task: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, w): the minimum spanning forest of the mutual-reachability graph of all pairs within ``radius``; and (node, comp) of it.

    The distance of a pair is raised to the core distance of both, that is the distance to the ``least_points``-th nearest
    record (the record itself is the first), or the radius, where so many aren't within it.

    Each record finds its ``k`` nearest. What it may still miss lies beyond the last of them, its floor: Borůvka's rounds
    let a component take its lightest edge only up to the lowest floor of its records. Where no component may go on, the
    records whose floor is in the way look for the nearest records outside their own component, twice as many each time,
    until none is. So the forest is that of all pairs (as far as the index finds them), not that of a k-nearest graph.
    Copies outside the index hang on a kept copy. Each task reduces its edges to their own forest before they are shuffled.
    """
    spark = source.sparkSession
    rows = source.select(F.col(key).alias("__id"), F.col(vectors).alias("__v")).where("__id is not null")
    schema = "u bigint, v bigint, d double, core double, floor double"

    def linked(index) -> DataFrame:
        most = index.settings.k

        def reach(found: pd.DataFrame) -> pd.DataFrame:
            distance = 1 - found["cosine"].to_numpy()
            place = found.groupby("key").cumcount().to_numpy()

            def at(n: int, otherwise: float) -> np.ndarray:
                one = pd.Series(distance[place == n], index=found["key"].to_numpy()[place == n])
                return found["key"].map(one).fillna(otherwise).to_numpy()

            core = at(least_points - 2, radius) if least_points > 1 else np.zeros(len(found))
            return pd.DataFrame({"u": found["key"], "v": found["other"], "d": distance, "core": core, "floor": at(most - 1, np.inf)})

        return neighbours(index, spark, reach, schema)

    def settings(most: int) -> SearchSettings:
        return SearchSettings(dims=dims, k=most, least_cosine=1 - radius)

    def reduced(edges: DataFrame) -> DataFrame:
        return edges.mapInPandas(lambda batches: (local_forest(b) for b in batches), EDGE)

    index = build_index(rows, lambda b: mean_vectors(b, "__id", "__v", dims), rows.count(), "tracks", settings(k))
    spare = index.followers(spark).select(F.col("key").alias("u"), F.col("kept")[0]["key"].alias("v"), F.lit(0.0).alias("d"), F.lit(0.0).alias("core"), F.lit(float("inf")).alias("floor"))
    found = cut_lineage(linked(index).unionByName(spare))
    records = cut_lineage(found.groupBy(F.col("u").alias("node")).agg(F.min("core").alias("core"), F.min("floor").alias("floor")))
    core = records.select(F.col("node").alias("v"), F.col("core").alias("cv"))
    own = records.select(F.col("node").alias("u"), F.col("core").alias("cu"))
    # with two points to a core no core distance exceeds that of a pair
    weighed = found.join(core, "v", "left").select("u", "v", F.greatest("d", "core", F.coalesce("cv", F.lit(radius))).alias("w")) if least_points > 2 else found.select("u", "v", F.col("d").alias("w"))
    edges, chosen, labels, floors, most = cut_lineage(reduced(weighed)), None, None, records.where("floor < double('infinity')").select("node", "floor"), k
    full = floors.select("node")
    while True:
        taken = boruvka(contracted(edges, labels, floors), one_task)
        chosen = cut_lineage(taken if chosen is None else chosen.unionByName(taken))
        labels = cut_lineage(labels_of(chosen, one_task, written=True))
        best = lightest(contracted(edges, labels, None)).select(F.col("c").alias("comp"), F.col("e.w").alias("best"))
        placed = full.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")).join(floors, "node", "left").join(best, "comp", "left")
        asks = F.coalesce("floor", F.lit(float("inf"))) < F.coalesce("best", F.lit(float("inf")))
        placed = cut_lineage(placed.select(F.col("node").alias("__id"), F.col("comp").alias("__tree"), asks.alias("__asks"), F.col("best").isNotNull().alias("__held")))
        n, open_, held = placed.agg(F.count("*"), F.count_if("__asks"), F.count_if(F.col("__asks") & F.col("__held"))).first()
        if not open_:
            return chosen, labels
        again = build_index(rows.join(placed, "__id"), lambda b: mean_vectors(b, "__id", "__v", dims, "__tree", "__asks"), n, "trees", settings(most))
        more, most = cut_lineage(linked(again)), most * 2
        if not held and not more.limit(1).count():
            # they only looked whether anything lies outside, and nothing does
            return chosen, labels
        new = more.join(own, "u", "left").join(core, "v", "left").select("u", "v", F.greatest("d", F.coalesce("cu", F.lit(radius)), F.coalesce("cv", F.lit(radius))).alias("w")) if least_points > 2 else more.select("u", "v", F.col("d").alias("w"))
        edges = cut_lineage(edges.unionByName(reduced(new)))
        # who asked misses nothing below the last that it found, or nothing at all
        answered = placed.where("__asks").select(F.col("__id").alias("node")).join(more.groupBy(F.col("u").alias("node")).agg(F.min("floor").alias("new")), "node", "left")
        floors = floors.join(answered.select("node", F.coalesce("new", F.lit(float("inf"))).alias("new")), "node", "left").select("node", F.coalesce("new", "floor").alias("floor"))
        floors = cut_lineage(floors.where("floor < double('infinity')"))


def cluster(
    source: DataFrame,
    *,
    key: str,
    vectors: str,
    radius: float = 0.2,
    epsilon: float = 0.1,
    least_size: int = 2,
    least_points: int = 3,
    k: int = 8,
    dims: int = 80,
    tree_edges: int = TREE_EDGES,
    one_task: int = ONE_TASK_EDGES,
) -> DataFrame:
    """Clusters of records by the mean of their vectors.

    Result: ``cluster_id`` (the smallest key in it), ``key``, ``persistence`` (1/distance at which the record falls out)
    and ``typical`` (the most persistent records). Distance is one less cosine; nothing beyond ``radius`` is linked, and
    no cluster is split below the distance ``epsilon``.

    Defined cases: records without a usable vector and null keys take no part; a key counts once; exact copies are one
    point with that many members at distance 0; records in no cluster don't come out; an empty table gives an empty
    result; other columns are not read.

    Plan: the neighbours come from the index of ``vectors.py``; edges are reduced to spanning forests where they arise;
    Borůvka's rounds are distributed, and go on in one task once ``one_task`` edges are left; trees are solved side by side,
    those of more than ``tree_edges`` edges in parts, with the same result (see ``hierarchy.py``).
    """
    if not 1 <= least_points <= k + 1 or least_size < 2:
        raise ValueError("least_points must be in 1..k + 1, least_size at least 2")
    forest, labels = density_forest(source, key=key, vectors=vectors, radius=radius, k=k, least_points=least_points, dims=dims, one_task=one_task)
    edges = cut_lineage(forest.join(labels.select(F.col("node").alias("u"), F.col("comp").alias("tree")), "u").select("tree", "u", "v", "w"))
    found = stable_clusters(edges, radius=radius, epsilon=epsilon, least_size=least_size, tree_edges=tree_edges, one_task=one_task)
    return found.select(F.col("cluster").alias("cluster_id"), F.col("node").alias("key"), "persistence", "typical")
