"""Queries that run a stream over a table to its end, in several batches, with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators.relational import first_tier
from strandline.operators.series import grid_first
from strandline.sources.tables import observations, table
from strandline.streaming import streams as S

HOUR = 3_600_000_000
DAY = 24 * HOUR


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _arrivals(spark, sf, late=40, again=30):
    """The events in five batches; some come a batch late, some twice, and each counts once."""
    stream, delay = S.replayed(_events(spark, sf), time="ts", key="event_id", late=late, again=again)
    return S.once(stream, key="event_id", time="ts", delay=delay), delay


def stream_sessions(spark, sf):
    stream, _ = _arrivals(spark, sf)
    out = S.latest(S.sessions(stream, key="user_id", time="ts", gap="1 hour", delay=None), ["user_id", "first"], "append")
    return out.select("user_id", F.unix_micros("first").alias("s"), F.unix_micros("last").alias("e"), "n")


def stream_owned_counts(spark, sf):
    stream, _ = _arrivals(spark, sf)
    out = S.latest(S.owned_counts(stream, key="event_type", time="ts", size="1 day", delay=None), ["event_type", "start"])
    return out.select("event_type", F.unix_micros("start").alias("s"), "n")


def stream_prefixes(spark, sf):
    """In order, with a watermark of a second: all windows that are closed by the end."""
    stream, _ = S.replayed(_events(spark, sf), time="ts", key="event_id")
    out = S.latest(S.prefixes(stream, key="event_type", time="ts", size="1 hour", delay="1 second"), ["event_type", "start"], "append")
    return out.select("event_type", F.unix_micros("start").alias("s"), "n")


def stateful_ttl(spark, sf):
    stream, _ = S.replayed(_events(spark, sf), time="ts", key="event_id")
    return S.latest(S.entities(stream, key="user_id", time="ts", row="event_id", lifetime=HOUR), ["event_id"], "append").select("user_id", "event_id", "entity")


def deferred_rows(spark, sf):
    stream, _ = _arrivals(spark, sf)
    out = S.deferred(stream.select("user_id", "event_id", "value"), F.col("value") >= 60, key="user_id")
    return out.select("user_id", "event_id", "tier")


def dense_passes(spark, sf):
    """A coarse pass, a denser one only around what it found and hadn't seen (ST5, ST17): rows of both with their pass."""
    o = observations(spark, sf)
    coarse = grid_first(o, series="series", time="us", key="event_id", step=6 * HOUR)
    seen = coarse.select("series", F.floor(F.col("us") / (6 * HOUR)).alias("cell"), (F.col("value") >= 20).alias("hit"))
    near = seen.where("hit").select("series", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")).distinct()
    inner = o.withColumn("cell", F.floor(F.col("us") / (6 * HOUR))).join(near, ["series", "cell"], "left_semi").drop("cell")
    dense = grid_first(inner, series="series", time="us", key="event_id", step=HOUR).join(coarse.select("event_id"), "event_id", "left_anti")
    return coarse.select("event_id", F.lit(1).alias("pass_no")).unionByName(dense.select("event_id", F.lit(2).alias("pass_no")))


def fallback_groups(spark, sf):
    """Certain rows, else likely ones, else any (ST12): per series the rows of the first tier that has some."""
    o = observations(spark, sf).select("series", "event_id", "value", "label")
    return first_tier([o.where("value >= 60"), o.where("value >= 30"), o], "series").select("series", "event_id", "tier")


QUERIES = {
    "stream_sessions": stream_sessions, "stream_owned_counts": stream_owned_counts, "stream_prefixes": stream_prefixes, "stateful_ttl": stateful_ttl,
    "deferred_rows": deferred_rows, "dense_passes": dense_passes, "fallback_groups": fallback_groups,
}
_OBS = "with o as (select user_id, user_id as series, epoch_us(ts) as us, event_type, event_id, value from events)"
SQL = {
    # what is open at the end hasn't closed: the last session of a key may be one
    "stream_sessions": _OBS + """, m as (select *, case when us - lag(us) over (partition by user_id order by us) < 3600000000 then 0 else 1 end as opens from o),
k as (select *, sum(opens) over (partition by user_id order by us, event_id rows unbounded preceding) as g from m),
w as (select max(us) - 1000000 * (2 * ((max(us) - min(us) + 5) // 5) // 1000000 + 2) as mark from o)
select user_id, min(us) as s, max(us) as e, count(*) as n from k group by user_id, g having max(us) + 3600000000 <= (select mark from w)""",
    "stream_owned_counts": _OBS + " select event_type, (us // 86400000000) * 86400000000 as s, count(*) as n from o group by all",
    "stream_prefixes": _OBS + ", w as (select event_type, (us // 3600000000) * 3600000000 as s, count(*) as n from o group by all) select * from w where s + 3600000000 <= (select max(us) - 1000000 from o)",
    "stateful_ttl": _OBS + """, m as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) <= 3600000000 then 0 else 1 end as opens from o),
k as (select *, sum(opens) over (partition by user_id order by us, event_id rows unbounded preceding) as g from m)
select user_id, event_id, min(us) over (partition by user_id, g) as entity from k""",
    "deferred_rows": _OBS + """, d as (select user_id, min((event_id, value)) as m from o where coalesce(value >= 60, false) = false and user_id not in (select user_id from o where value >= 60 and user_id is not null) group by user_id)
select user_id, event_id, 0 as tier from o where value >= 60 union all select user_id, m[1] as event_id, 1 from d""",
    "dense_passes": _OBS + """, c as (select * from (select *, us // 21600000000 as cell from o where us is not null) qualify row_number() over (partition by series, cell order by us, event_id) = 1),
near as (select distinct series, unnest([cell - 1, cell, cell + 1]) as cell from c where value >= 20),
i as (select o.* from o where (series, us // 21600000000) in (select series, cell from near)),
d as (select * from i qualify row_number() over (partition by series, us // 3600000000 order by us, event_id) = 1)
select event_id, 1 as pass_no from c union all select event_id, 2 from d where event_id not in (select event_id from c)""",
    "fallback_groups": _OBS + ", t as (select series, event_id, case when value >= 60 then 0 when value >= 30 then 1 else 2 end as tier from o), b as (select series, min(tier) as best from t group by series) select series, event_id, best as tier from t join b using (series) where tier <= best",
}
