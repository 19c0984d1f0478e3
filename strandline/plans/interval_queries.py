"""Queries over intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import interval_algebra as A
from strandline.operators.ordered_scan import separated
from strandline.sources.tables import intervals, observations, table

HOUR, DAY = 3_600_000_000, 86_400_000_000
QUERIES, SQL = {}, {}
_IV = "with o as (select user_id as series, epoch_us(ts) as us, event_type as label, value, event_id from events), iv as (select series, us as s, us + floor(value * 60)::bigint * 1000000 as e, event_id, label from o)"
_U = _IV + """, g as (select * from iv where e > s), h as (select *, max(e) over (partition by series order by s, e rows between unbounded preceding and 1 preceding) as hi from g),
n as (select *, sum(case when hi is null or s > hi then 1 else 0 end) over (partition by series order by s, e rows unbounded preceding) as k from h),
u as (select series, min(s) as s, max(e) as e from n group by series, k), x as (select series, sum(e - s)::bigint as exposure from u group by series)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("interval_union", _U + " select series, s, e from u")
def interval_union(spark, sf):
    return A.union(intervals(spark, sf), "series")


@query("exposure_by_user", _U + " select series, exposure from x")
def exposure_by_user(spark, sf):
    return A.exposure(intervals(spark, sf), "series")


@query("coverage_main_flag", _U + """, r as (select series, exposure, row_number() over (order by exposure desc, series) as rank, sum(exposure) over () as total,
coalesce(sum(case when exposure >= 20000000000 then exposure else 0 end) over (order by exposure desc, series rows between unbounded preceding and 1 preceding), 0) as before from x)
select series, exposure, rank, exposure >= 20000000000 and before < total * 0.6 as is_main from r""")
def coverage_main_flag(spark, sf):
    return A.ranked_exposure(A.exposure(intervals(spark, sf), "series"), least=20_000_000_000, target=0.6)


@query("interval_difference", _U + """, r as (select series, min(s) - 3600000000 as lo, max(e) + 3600000000 as hi from g group by series),
q as (select u.series, lo, hi, s, e, lag(e) over (partition by u.series order by s) as p, lead(s) over (partition by u.series order by s) as nx from u join r using (series))
select series, coalesce(p, lo) as s, s as e from q where s > coalesce(p, lo) union all select series, e, hi from q where nx is null and hi > e""")
def interval_difference(spark, sf):
    iv = intervals(spark, sf)
    ranges = iv.where("e > s").groupBy("series").agg((F.min("s") - HOUR).alias("lo"), (F.max("e") + HOUR).alias("hi"))
    return A.difference(iv, ranges, "series")


@query("gaps_over_threshold", _U + " select series, p as s, s as e from (select *, lag(e) over (partition by series order by s) as p from u) where s - p >= 86400000000")
def gaps_over_threshold(spark, sf):
    from strandline.operators.periods import periods_and_gaps

    g = periods_and_gaps(intervals(spark, sf), ["series"], "s", "e")
    return g.where(f"kind = 'gap' and end_ms - start_ms >= {DAY}").select("series", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))


@query("pad_union", _IV + """, g as (select series, s - 1800000000 as s, e + 1800000000 as e from iv), h as (select *, max(e) over (partition by series order by s, e rows between unbounded preceding and 1 preceding) as hi from g),
n as (select *, sum(case when hi is null or s > hi then 1 else 0 end) over (partition by series order by s, e rows unbounded preceding) as k from h) select series, min(s) as s, max(e) as e from n group by series, k""")
def pad_union(spark, sf):
    return A.union(intervals(spark, sf).select("series", (F.col("s") - HOUR // 2).alias("s"), (F.col("e") + HOUR // 2).alias("e")), "series")


@query("clip_ranges", _IV + " select event_id, greatest(s, 1704499200000000) as s, least(e, 1705708800000000) as e from iv where least(e, 1705708800000000) - greatest(s, 1704499200000000) >= 60000000")
def clip_ranges(spark, sf):
    iv = intervals(spark, sf).select("event_id", F.greatest("s", F.lit(1704499200000000)).alias("s"), F.least("e", F.lit(1705708800000000)).alias("e"))
    return iv.where("e - s >= 60000000")


@query("chunk_owner", _IV + " select event_id, (s + e) // 120000000 as chunk from iv")
def chunk_owner(spark, sf):
    return A.chunk_owner(intervals(spark, sf), 60_000_000).select("event_id", "chunk")


_SIDES = _IV + ", a as (select * from iv where label = 'purchase' and e > s), b as (select * from iv where label = 'error' and e > s)"


def _sides(spark, sf):
    iv = intervals(spark, sf).withColumnRenamed("event_id", "id").where("e > s")
    return iv.where("label = 'purchase'"), iv.where("label = 'error'")


@query("overlap_join_bucketed", _SIDES + " select a.event_id as id, b.event_id as other from a join b on a.series = b.series and a.s < b.e and b.s < a.e")
def overlap_join_bucketed(spark, sf):
    return A.overlap_join(*_sides(spark, sf), "series", width=6 * HOUR).select("id", "other")


@query("anti_overlap_radius", _SIDES + " select event_id as id from a where not exists (select 1 from b where a.series = b.series and a.s - 3600000000 < b.e and b.s < a.e + 3600000000)")
def anti_overlap_radius(spark, sf):
    return A.without_overlap(*_sides(spark, sf), "series", width=6 * HOUR, pad=HOUR).select("id")


@query("point_in_interval", _SIDES + ", p as (select * from o where label = 'click') select p.event_id as id, arg_min(a.event_id, (a.s, a.event_id)) as other from p join a on p.series = a.series and p.us >= a.s and p.us < a.e group by p.event_id")
def point_in_interval(spark, sf):
    points = observations(spark, sf).where("label = 'click'").select("series", F.col("event_id").alias("id"), F.col("us").alias("t"))
    return A.contained(points, _sides(spark, sf)[0], "series", width=6 * HOUR)


@query("range_contains", _SIDES + " select a.event_id as id from a where exists (select 1 from iv where iv.series = a.series and iv.label = 'view' and iv.s <= a.s and a.e <= iv.e)")
def range_contains(spark, sf):
    left, _ = _sides(spark, sf)
    view = intervals(spark, sf).withColumnRenamed("event_id", "id").where("label = 'view'")
    pairs = A.overlap_join(left, view, "series", width=6 * HOUR).select("id", "other")
    both = pairs.join(left.select("id", "s", "e"), "id").join(view.select(F.col("id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2")), "other")
    return both.where("s2 <= s and e <= e2").select("id").distinct()


@query("free_positions", _U + """, f as (select series, p as s, s as e from (select *, lag(e) over (partition by series order by s) as p from u) where p is not null)
select series, s, i, s + ((e - s) * (i + 1)) // 10 as at from f, range(9) as r(i) where e - s >= 86400000000""")
def free_positions(spark, sf):
    gaps = gaps_over_threshold(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<bigint>")))
    return gaps.select("series", "s", "i", (F.col("s") + F.floor((F.col("e") - F.col("s")) * (F.col("i") + 1) / 10)).alias("at"))


@query("greedy_separated", """with recursive o as (select user_id as series, epoch_us(ts) as us from events where event_type = 'error'),
r as (select series, min(us) as us from o group by series union all select r.series, (select min(o.us) from o where o.series = r.series and o.us - r.us >= 86400000000) as us from r where r.us is not null)
select series, us from r where us is not null""")
def greedy_separated(spark, sf):
    o = observations(spark, sf).where("label = 'error'")
    return separated(o, series="series", time="us", key="event_id", gap=DAY).select("series", "us")


@query("union_last_wins", """with p as (select *, 0 as part from events where event_id % 2 = 0 union all select * replace (value + 1 as value), 1 from events where event_id % 3 = 0)
select event_id, round(value, 4) as value, part from p qualify row_number() over (partition by event_id order by part desc) = 1""")
def union_last_wins(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    parts = e.where("event_id % 2 = 0").withColumn("part", F.lit(0)).unionByName(e.where("event_id % 3 = 0").select("event_id", (F.col("value") + 1).alias("value"), F.lit(1).alias("part")))
    return parts.groupBy("event_id").agg(F.max_by(F.struct("value", "part"), "part").alias("x")).select("event_id", F.round("x.value", 4).alias("value"), "x.part")
