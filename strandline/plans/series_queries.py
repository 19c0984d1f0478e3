"""Queries over observation series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.islands import islands
from strandline.operators.series import as_of, boundary_safety, grid_first, integral_means, majority, running_sum, weights
from strandline.sources.tables import intervals, observations

HOUR, DAY = 3_600_000_000, 86_400_000_000
_OBS = "with o as (select user_id as series, epoch_us(ts) as us, event_type as label, value, event_id from events)"

QUERIES, SQL = {}, {}


def _w():
    return Window.partitionBy("series").orderBy("us", "event_id")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_ISLANDS = """, m as (select *, case when lag(label) over w = label and us - lag(us) over w <= 3600000000 then 0 else 1 end as opens,
  case when lag(label) over w = label then 0 else 1 end as turns from o window w as (partition by series order by us, event_id)),
k as (select *, sum(opens) over (partition by series order by us, event_id rows unbounded preceding) as g, sum(turns) over (partition by series order by us, event_id rows unbounded preceding) as r from m)"""


def _islands(spark, sf, gap=HOUR) -> DataFrame:
    return islands(observations(spark, sf), series="series", time="us", key="event_id", label="label", gap=gap)


@query("islands_events", _OBS + _ISLANDS + " select series, label, min(us) as s, max(us) as e, count(*) as n from k group by series, label, g")
def islands_events(spark: SparkSession, sf: str) -> DataFrame:
    return _islands(spark, sf).select("series", "label", "s", "e", "n")


@query("islands_min_length", _OBS + _ISLANDS + " select series, label, min(us) as s, max(us) + 60000000 as e from k group by series, label, g having max(us) - min(us) >= 600000000")
def islands_min_length(spark, sf):
    return _islands(spark, sf).where("e - s >= 600000000").select("series", "label", "s", (F.col("e") + 60_000_000).alias("e"))


@query("run_lengths", _OBS + _ISLANDS + " select label, n, count(*) as runs from (select series, label, r, count(*) as n from k group by all) group by label, n")
def run_lengths(spark, sf):
    return _islands(spark, sf, None).groupBy("label", "n").agg(F.count("*").alias("runs"))


@query("session_by_gap", _OBS + """, m as (select *, case when us - lag(us) over (partition by series order by us) < 3600000000 then 0 else 1 end as opens from o),
k as (select *, sum(opens) over (partition by series order by us, event_id rows unbounded preceding) as g from m)
select series, min(us) as s, max(us) as e, count(*) as n from k group by series, g""")
def session_by_gap(spark, sf):
    o = observations(spark, sf).withColumn("ts", F.timestamp_micros("us"))
    return o.groupBy("series", F.session_window("ts", "1 hour")).agg(F.min("us").alias("s"), F.max("us").alias("e"), F.count("*").alias("n")).select("series", "s", "e", "n")


@query("tumbling_owner", _OBS + " select series, us // 86400000000 as day, count(*) as n, min(event_id) as first_id from o group by all")
def tumbling_owner(spark, sf):
    return observations(spark, sf).groupBy("series", F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("sliding_counts", _OBS + """, x as (select label, us, unnest([us // 10800000000, us // 10800000000 - 1]) as k from o)
select label, k * 10800000000 as s, count(*) as n from x group by all""")
def sliding_counts(spark, sf):
    o = observations(spark, sf).withColumn("ts", F.timestamp_micros("us"))
    return o.groupBy("label", F.window("ts", "6 hours", "3 hours").alias("w")).agg(F.count("*").alias("n")).select("label", F.unix_micros("w.start").alias("s"), "n")


@query("grid_downsample", _OBS + " select series, us, event_id, label from o qualify row_number() over (partition by series, us // 3600000000 order by us, event_id) = 1")
def grid_downsample(spark, sf):
    return grid_first(observations(spark, sf), series="series", time="us", key="event_id", step=HOUR).select("series", "us", "event_id", "label")


@query("row_weights", _OBS + " select event_id, least(coalesce(lead(us) over (partition by series order by us, event_id) - us, 3600000000), 3600000000) as w from o")
def row_weights(spark, sf):
    return weights(observations(spark, sf), series="series", time="us", key="event_id", interval=HOUR).select("event_id", "w")


@query("integral_mean_windows", _OBS + """, h as (select *, least(coalesce(lead(us) over w - us, 3600000000), 3600000000) as w from o window w as (partition by series order by us, event_id)),
p as (select *, coalesce(sum(value * w) over (partition by series order by us, event_id rows between unbounded preceding and 1 preceding), 0) as p from h),
g as (select distinct series, (us // 86400000000) * 86400000000 as a from o), win as (select series, a, a + 86400000000 as b from g),
f as (select win.series, win.a, win.b, t, coalesce((select p.p + p.value * least(t - p.us, p.w) from p where p.series = win.series and p.us <= t order by p.us desc, p.event_id desc limit 1), 0) as f
  from win, unnest([win.a, win.b]) as u(t))
select series, a, b, round((max(f) filter (t = b) - max(f) filter (t = a)) / (b - a), 7) as mean from f group by series, a, b""")
def integral_mean_windows(spark, sf):
    o = observations(spark, sf).withColumnRenamed("event_id", "key")
    days = o.select("series", (F.floor(F.col("us") / DAY) * DAY).alias("a")).distinct().withColumn("b", F.col("a") + DAY)
    return integral_means(o, days, interval=HOUR).withColumn("mean", F.round("mean", 7))


_PAIR = _OBS + ", l as (select * from o where label = 'purchase'), r as (select series, us, min(event_id) as event_id from o where label = 'view' group by all)"


def _sides(spark, sf):
    o = observations(spark, sf).withColumnRenamed("event_id", "key")
    return o.where("label = 'purchase'"), o.where("label = 'view'")


@query("asof_backward", _PAIR + " select l.event_id as key, r.event_id as found_key from l asof left join r on l.series = r.series and l.us >= r.us")
def asof_backward(spark, sf):
    return as_of(*_sides(spark, sf), direction="backward").select("key", "found_key")


@query("asof_forward", _PAIR + " select l.event_id as key, r.event_id as found_key from l asof left join r on l.series = r.series and l.us <= r.us")
def asof_forward(spark, sf):
    return as_of(*_sides(spark, sf), direction="forward").select("key", "found_key")


@query("asof_nearest_tol", _PAIR + """ select l.event_id as key, arg_min(r.event_id, (abs(r.us - l.us), r.us)) as found_key from l left join r
  on l.series = r.series and abs(r.us - l.us) <= 21600000000 group by l.event_id""")
def asof_nearest_tol(spark, sf):
    return as_of(*_sides(spark, sf), direction="nearest", tolerance=6 * HOUR).select("key", "found_key")


@query("boundary_epoch", _OBS + " select event_id, count(*) filter (label = 'error') over (partition by series order by us, event_id rows unbounded preceding) as epoch from o")
def boundary_epoch(spark, sf):
    hard = F.when(F.col("label") == "error", 1).otherwise(0).cast("bigint")
    return running_sum(observations(spark, sf), series="series", time="us", order=["us", "event_id"], value=hard, name="epoch", inclusive=True).select("event_id", "epoch")


@query("boundary_safety", _OBS + """, iv as (select series, event_id, us as s, us + floor(value * 60)::bigint * 1000000 as e from o where value >= 1 and label <> 'error'),
p as (select *, s + least(e - s, greatest(300000000, e - s - least(600000000, (e - s) // 4))) as pr from iv), ev as (select distinct series, us from o where label = 'error'),
x as (select p.event_id, count(*) filter (abs(us - s) <= 60000000 or abs(us - e) <= 60000000 or (us > s and us < pr)) as bad, count(*) filter (us > s and us < e) as inside
  from p left join ev on p.series = ev.series and us between s - 60000000 and e + 60000000 group by p.event_id)
select event_id as key, bad = 0 as clear, bad = 0 and inside <= 1 as safe from x""")
def boundary_safety_query(spark, sf):
    iv = intervals(spark, sf).where("label <> 'error' and e - s >= 60000000").withColumnRenamed("event_id", "key")
    ev = observations(spark, sf).where("label = 'error'").select("series", "us")
    return boundary_safety(iv, ev, margin=60_000_000, head=300_000_000, slack=600_000_000, width=6 * HOUR).select("key", "clear", "safe")


@query("range_window_stats", _OBS + " select event_id, count(*) over w as n, round(avg(value) over w, 4) as mean from o window w as (partition by series order by us range between 3600000000 preceding and 3600000000 following)")
def range_window_stats(spark, sf):
    w = Window.partitionBy("series").orderBy("us").rangeBetween(-HOUR, HOUR)
    return observations(spark, sf).select("event_id", F.count("*").over(w).alias("n"), F.round(F.avg("value").over(w), 4).alias("mean"))


@query("successive_change_count", _OBS + """, d as (select series, label, value, abs(value - lag(value) over (partition by series, label order by us, event_id)) as d from o)
select series, label, count(*) filter (d >= 5) as changes, round(max(value) - min(value), 6) as span from d group by series, label""")
def successive_change_count(spark, sf):
    d = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("series", "label").orderBy("us", "event_id")))
    return observations(spark, sf).withColumn("d", d).groupBy("series", "label").agg(F.count(F.when(F.col("d") >= 5, 1)).alias("changes"), F.round(F.max("value") - F.min("value"), 6).alias("span"))


@query("three_row_pattern", _OBS + """ select event_id from o window w as (partition by series order by us, event_id)
qualify lag(value) over w < value and lead(value) over w < value and us - lag(us) over w <= 86400000000 and lead(us) over w - us <= 86400000000""")
def three_row_pattern(spark, sf):
    o = observations(spark, sf)
    for c in ("value", "us"):
        o = o.withColumn(f"{c}0", F.lag(c).over(_w())).withColumn(f"{c}2", F.lead(c).over(_w()))
    return o.where((F.col("value0") < F.col("value")) & (F.col("value2") < F.col("value")) & (F.col("us") - F.col("us0") <= DAY) & (F.col("us2") - F.col("us") <= DAY)).select("event_id")


@query("majority_filter", _OBS + """, w as (select event_id, list(label) over (partition by series order by us, event_id rows between 2 preceding and 2 following) as a from o),
u as (select event_id, unnest(a) as x, unnest(range(len(a))) as i from w), c as (select event_id, x, count(*) as n, min(i) as i from u group by all)
select event_id, arg_min(x, (-n, i)) as label from c group by event_id""")
def majority_filter(spark, sf):
    return observations(spark, sf).withColumn("a", F.collect_list("label").over(_w().rowsBetween(-2, 2))).select("event_id", majority(F.col("a")).alias("label"))


@query("ntile_best_row", _OBS + """, b as (select *, ntile(7) over (partition by series order by us, event_id) as bucket from o)
select series, bucket, event_id from b qualify row_number() over (partition by series, bucket order by value desc, event_id) = 1""")
def ntile_best_row(spark, sf):
    b = observations(spark, sf).withColumn("bucket", F.ntile(7).over(_w()))
    return b.groupBy("series", "bucket").agg(F.max(F.struct("value", (-F.col("event_id")).alias("k"))).alias("m")).select("series", "bucket", (-F.col("m.k")).alias("event_id"))


@query("peak_rows", _OBS + """, a as (select *, avg(value) over (partition by series order by us, event_id rows between 1 preceding and 1 following) as m from o)
select event_id from a window w as (partition by series order by us, event_id) qualify m > lag(m) over w and m >= lead(m) over w and m >= 0.45 * max(m) over (partition by series)""")
def peak_rows(spark, sf):
    a = observations(spark, sf).withColumn("m", F.avg("value").over(_w().rowsBetween(-1, 1))).withColumn("top", F.max("m").over(Window.partitionBy("series")))
    a = a.withColumn("m0", F.lag("m").over(_w())).withColumn("m2", F.lead("m").over(_w()))
    return a.where("m > m0 and m >= m2 and m >= 0.45 * top").select("event_id")


@query("hole_rows", _OBS + """ select event_id from o window w as (partition by series order by us, event_id)
qualify label <> 'view' and lag(label) over w = 'view' and lead(label) over w = 'view' and lead(us) over w - lag(us) over w <= 172800000000""")
def hole_rows(spark, sf):
    o = observations(spark, sf).withColumn("l0", F.lag("label").over(_w())).withColumn("l2", F.lead("label").over(_w())).withColumn("d", F.lead("us").over(_w()) - F.lag("us").over(_w()))
    return o.where(f"label <> 'view' and l0 = 'view' and l2 = 'view' and d <= {2 * DAY}").select("event_id")
