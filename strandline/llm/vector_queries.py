"""Queries of problems 2 and 4: clusters of tracks, most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.clusters import cluster
from strandline.llm.vectors import SearchSettings, most_similar, similar_pairs
from strandline.sources.tables import table
from strandline.storage import cut_lineage

PAIRS = [("vector_keys", "vectors"), ("reference_face_keys", "reference_face_vectors")]


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of most similar vectors with their cosine."""
    return similar_pairs(table(spark, sf, "track"), group="id", pairs=PAIRS)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_neighbours(spark, sf).select("key_a", "key_b")


def p4_hundredth(spark: SparkSession, sf: str) -> DataFrame:
    """All neighbours of every key divisible by 100, searched with all leaves open, so exactly."""
    return most_similar(table(spark, sf, "track"), group="id", pairs=PAIRS, settings=SearchSettings(least_chance=0.0), every=100).select("key", "other")


def p4_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Of the exact neighbours of these keys, how many there are and whether at least nine tenths stand in p4_neighbours."""
    exact = p4_hundredth(spark, sf).select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b"))
    found = p4_neighbours(spark, sf).select("key_a", "key_b", F.lit(1).alias("hit"))
    return exact.join(found, ["key_a", "key_b"], "left").agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


#: Tracks further apart than the radius aren't linked; below half of it no cluster is split; a core has three tracks.
RADIUS, EPSILON, LEAST_POINTS = 0.2, 0.1, 3


def _clusters(spark: SparkSession, sf: str, **more) -> DataFrame:
    """Clusters with the shots of their tracks, those seen in at least two shots."""
    track = table(spark, sf, "track")
    found = cluster(track, key="id", vectors="vectors", radius=RADIUS, epsilon=EPSILON, least_points=LEAST_POINTS, **more)
    shot = track.select(F.col("id").alias("key"), "source_id", "shot_id").dropDuplicates(["key"])
    return cut_lineage(found.join(shot, "key"))


def _described(members: DataFrame) -> DataFrame:
    shots = F.count_distinct(F.when(F.col("shot_id").isNotNull(), F.struct("source_id", "shot_id")))
    return members.groupBy("cluster_id").agg(F.count("*").alias("tracks"), shots.alias("shots")).where("tracks >= 2 and shots >= 2")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    members = _clusters(spark, sf)
    return members.join(_described(members).select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", F.col("key").alias("track_id"))


def p2_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Each cluster with its numbers of tracks and of shots, without the tracks that are typical of it."""
    return _described(_clusters(spark, sf))


def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Each cluster with its numbers of tracks and of shots and its three most persistent tracks; every round of Borůvka's
    method is distributed here, however few edges are left."""
    members = _clusters(spark, sf, one_task=0)
    first = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("persistence"), "key"))
    typical = members.where("typical").withColumn("place", first).where("place <= 3").groupBy("cluster_id").agg(F.sort_array(F.collect_list("key")).alias("typical_tracks"))
    return _described(members).join(typical, "cluster_id")


QUERIES = {
    "p2_found": p2_found, "p2_sizes": p2_sizes, "p2_clusters": p2_clusters,
    "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_hundredth": p4_hundredth, "p4_recall": p4_recall,
}

_MEANS = """
with t as (select distinct on (id) id, source_id, shot_id, vectors from track where id is not null),
v as (select id, unnest(vectors) as x from t),
good as (select id, x from v where len(x) = 80 and list_bool_and(list_transform(x, lambda a: a is not null and isfinite(a))) and list_bool_or(list_transform(x, lambda a: a <> 0))),
scaled as (select id, list_transform(x, lambda a: a::double / sqrt(list_sum(list_transform(x, lambda b: b::double * b::double)))) as y from good),
dims as (select id, unnest(y) as a, unnest(range(80)) as i from scaled),
means as (select id, list(a order by i) as m from (select id, i, avg(a) as a from dims group by all) group by id),
near as (select a.id as u, b.id as v from means a join means b on a.id <> b.id where list_cosine_similarity(a.m, b.m) >= 0.8),
-- all members of a cluster are alike, so the smallest of a track's own list names it
named as (select id, least(id, coalesce(min(v), id)) as cluster_id from means left join near on id = u group by id),
shots as (select cluster_id, count(*) as tracks, count(distinct case when shot_id is not null then (source_id, shot_id) end) as shots from named join t using (id) group by cluster_id)
"""
_NEAR = """
with t as (select distinct on (id) * from track where id is not null),
k as (select id, unnest(vector_keys) as key, unnest(vectors) as v from t union all select id, unnest(reference_face_keys), unnest(reference_face_vectors) from t),
g as (select distinct on (key) id, key, v::double[] as v from k where key is not null and len(v) = 80 and list_bool_and(list_transform(v, lambda a: a is not null and isfinite(a))) and list_bool_or(list_transform(v, lambda a: a <> 0))),
p as (select a.key, b.key as other, round(list_cosine_similarity(a.v, b.v), 6) as c from g a join g b on a.id <> b.id where a.key % 100 = 0),
n as (select key, other from p where c >= 0.8 qualify row_number() over (partition by key order by c desc, other) <= 5)
"""
SQL = {
    "p2_found": _MEANS + "select cluster_id, id as track_id from named where cluster_id in (select cluster_id from shots where tracks >= 2 and shots >= 2)",
    "p2_sizes": _MEANS + "select cluster_id, tracks, shots from shots where tracks >= 2 and shots >= 2",
    "p4_hundredth": _NEAR + "select key, other from n",
    "p4_recall": _NEAR + "select count(*) as neighbours, true as enough from n",
}
