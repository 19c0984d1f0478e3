"""Queries of the order-dependent operators. SQL can't express most of them; tests hold them against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import ordered as O
from strandline.plans.relational_queries import _boxes
from strandline.sources.tables import intervals, table


def nms_topscore(spark, sf):
    return O.suppress(_boxes(spark, sf).withColumn("score", (F.col("k") * 31) % 101), group="g", key="k", limit=0.3)


def complete_link_groups(spark, sf):
    return O.complete_link(table(spark, sf, "embeddings"), block="label", key="vec_id", vector="embedding", limit=0.75)


def leader_groups(spark, sf):
    return O.leaders(table(spark, sf, "embeddings"), block="label", key="vec_id", vector="embedding", limit=0.16)


def greedy_allocation(spark, sf):
    """Per series: demands of fixed lengths against its intervals of a month."""
    iv = intervals(spark, sf).where("e > s").select("series", F.col("event_id").alias("id"), "s", "e", F.col("s").cast("double").alias("score"))
    lengths = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(n * 60_000_000).cast("bigint").alias("length")) for i, n in enumerate((120, 60, 30, 10, 5))]))
    demands = iv.select("series").distinct().withColumn("x", lengths).select("series", "x.id", "x.length")
    return O.allocate(demands, iv, plan="series", gap=300_000_000)


def ranked_windows(spark, sf):
    """Per series the intervals of most value that keep an hour from one another."""
    iv = intervals(spark, sf).where("e > s").withColumn("score", F.col("e") - F.col("s"))
    return O.separated(iv, group="series", key="event_id", gap=3_600_000_000)


def novel_gallery(spark, sf):
    return O.gallery(table(spark, sf, "embeddings"), group="label", key="vec_id", vector="embedding", novelty=0.7, size=8)


QUERIES = {"ranked_windows": ranked_windows, "novel_gallery": novel_gallery, "nms_topscore": nms_topscore, "complete_link_groups": complete_link_groups, "leader_groups": leader_groups, "greedy_allocation": greedy_allocation}

SQL = {
    "nms_topscore": """with recursive b as (select p_partkey as k, p_partkey % 50 as g, (p_partkey * 7) % 90 as x, (p_partkey * 13) % 80 as y, 20 + p_size as w, 15 + p_size % 20 as h, (p_partkey * 31) % 101 as score from part),
o as (select *, row_number() over (partition by g order by score desc, k) as i from b),
hit as (select a.g, a.i, list(b.i) as later from o a join o b on a.g = b.g and a.i < b.i where greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))
  / greatest(1, a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) >= 0.3 group by a.g, a.i),
r as (select o.g, o.i, o.k, true as kept, coalesce(later, []::bigint[]) as gone from o left join hit using (g, i) where o.i = 1
  union all select o.g, o.i, o.k, not list_contains(r.gone, o.i), case when list_contains(r.gone, o.i) then r.gone else list_concat(r.gone, coalesce(later, []::bigint[])) end
  from r join o on o.g = r.g and o.i = r.i + 1 left join hit on hit.g = o.g and hit.i = o.i)
select g, k from r where kept""",
}
