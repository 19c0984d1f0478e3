"""Queries of evidence rules: decisions over windows, bursts, thresholds, galleries, inventories; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import evidence as E
from strandline.functions import maths as M
from strandline.operators import graph
from strandline.operators.islands import islands
from strandline.operators.series import weights
from strandline.plans.relational_queries import _alike
from strandline.sources.tables import observations, table

HOUR, DAY = 3_600_000_000, 86_400_000_000
QUERIES, SQL = {}, {}
_OBS = "with o as (select user_id as series, epoch_us(ts) as us, event_type as label, value, event_id from events)"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _samples(spark, sf):
    s = table(spark, sf, "samples").where("source_id is not null and not isnan(time_sec) and time_sec is not null").drop("ingested_at").dropDuplicates(["sample_id"])
    return s.withColumn("us", F.round(F.col("time_sec") * 1_000_000).cast("bigint"))


_SMP = "with smp as (select distinct on (sample_id) sample_id, source_id, round(time_sec * 1000000)::bigint as us, category, clear_face, face_visible, speaking, closeup_score, mouth_clarity, confidence from samples where source_id is not null and isfinite(time_sec))"


@query("window_identity_decision", _SMP + """, w as (select *, least(coalesce(lead(us) over (partition by source_id order by us, sample_id) - us, 500000), 500000) as w,
 case when clear_face >= 0.6 then 'main' when clear_face >= 0.3 then 'supporting' when face_visible = 0 then 'noise' else 'unknown' end as status from smp),
g as (select source_id, us // 10000000 as win, sum(w)::double as al, coalesce(sum(w) filter (status = 'main'), 0) / 1e7 as m, coalesce(sum(w) filter (status = 'supporting'), 0) / 1e7 as s,
 coalesce(sum(w) filter (status = 'noise'), 0) / 1e7 as x, coalesce(sum(w) filter (status = 'unknown'), 0) / 1e7 as u from w group by all)
select source_id, win, case when x >= 0.5 and m + s < 0.1 then 'reject' when m >= 0.4 and x <= 0.05 then 'main' when s >= 0.4 and m + u < 0.6 then 'supporting' else 'uncertain' end as decision from g""")
def window_identity_decision(spark, sf):
    w = weights(_samples(spark, sf), series="source_id", time="us", key="sample_id", interval=500_000)
    status = M.first_rule([(F.col("clear_face") >= 0.6, "main"), (F.col("clear_face") >= 0.3, "supporting"), (F.col("face_visible") == 0, "noise")], "unknown")
    part = lambda k: (F.coalesce(F.sum(F.when(F.col("st") == k, F.col("w"))), F.lit(0)) / 1e7).alias(k[0])
    g = w.withColumn("st", status).groupBy("source_id", F.floor(F.col("us") / 10_000_000).alias("win")).agg(part("main"), part("supporting"), part("noise"), part("unknown"))
    rules = [(F.expr("n >= 0.5 and m + s < 0.1"), "reject"), (F.expr("m >= 0.4 and n <= 0.05"), "main"), (F.expr("s >= 0.4 and m + u < 0.6"), "supporting")]
    return g.select("source_id", "win", M.first_rule(rules, "uncertain").alias("decision"))


_RUNS = _OBS + """, m as (select *, case when lag(label) over w = label and us - lag(us) over w <= 86400000000 then 0 else 1 end as opens from o window w as (partition by series order by us, event_id)),
k as (select *, sum(opens) over (partition by series order by us, event_id rows unbounded preceding) as g from m),
r as (select series, label, min(us) as s, max(us) as e, count(*) as n, min(event_id) as first_id from k group by series, label, g)"""


@query("burst_clusters", _RUNS + """, b as (select *, case when s - lag(e) over w <= 21600000000 and lag(e - s) over w <= 7200000000 and e - s <= 14400000000 then 0 else 1 end as opens from r window w as (partition by series order by s, label)),
c as (select *, sum(opens) over (partition by series order by s, label rows unbounded preceding) as g from b)
select series, min(s) as s, max(e) as e, count(*) as runs, count(*) >= 3 as burst from c group by series, g""")
def burst_clusters(spark, sf):
    r = islands(observations(spark, sf), series="series", time="us", key="event_id", label="label", gap=DAY)
    w = Window.partitionBy("series").orderBy("s", "label")
    goes = (F.col("s") - F.lag("e").over(w) <= 6 * HOUR) & (F.lag(F.col("e") - F.col("s")).over(w) <= 2 * HOUR) & (F.col("e") - F.col("s") <= 4 * HOUR)
    c = r.withColumn("opens", F.when(goes, 0).otherwise(1)).withColumn("g", F.sum("opens").over(w))
    return c.groupBy("series", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("runs")).select("series", "s", "e", "runs", (F.col("runs") >= 3).alias("burst"))


@query("dynamic_mask", _OBS + """, t as (select series, least(0.45 * max(value), greatest(0.01, 3 * quantile_cont(value, 0.1), 0.18 * max(value))) as thr from o group by series),
x as (select o.*, value >= thr as on_, row_number() over (partition by series order by us, event_id) as i from o join t using (series)),
a as (select series, i, i - lag(i, 1, -99) over (partition by series order by i) as d from x where on_),
g as (select *, sum(case when d <= 5 then 0 else 1 end) over (partition by series order by i rows unbounded preceding) as k from a)
select series, min(i) as first_row, max(i) + 1 as end_row from g group by series, k""")
def dynamic_mask(spark, sf):
    o = observations(spark, sf)
    t = o.groupBy("series").agg(F.least(0.45 * F.max("value"), F.greatest(F.lit(0.01), 3 * F.percentile("value", F.lit(0.1)), 0.18 * F.max("value"))).alias("thr"))
    i = F.row_number().over(Window.partitionBy("series").orderBy("us", "event_id"))
    a = o.withColumn("i", i).join(t, "series").where("value >= thr").withColumn("l", F.lit("on"))
    return islands(a, series="series", time="i", key="event_id", label="l", gap=5).select("series", F.col("s").alias("first_row"), (F.col("e") + 1).alias("end_row"))


@query("change_events", _OBS + """, c as (select *, abs(value - lag(value) over (partition by series order by us, event_id)) as d, first_value(value) over w as v0, first_value(us) over w as u0 from o
 window w as (partition by series order by us range between 86400000000 preceding and current row))
select event_id, d >= 20 as hard, us - u0 >= 43200000000 and abs(value - v0) >= 10 as slow from c where d >= 20 or (us - u0 >= 43200000000 and abs(value - v0) >= 10)""")
def change_events(spark, sf):
    o = observations(spark, sf)
    w, r = Window.partitionBy("series").orderBy("us", "event_id"), Window.partitionBy("series").orderBy("us").rangeBetween(-DAY, 0)
    c = o.withColumn("d", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("v0", F.first("value").over(r)).withColumn("u0", F.first("us").over(r))
    slow = (F.col("us") - F.col("u0") >= DAY // 2) & (F.abs(F.col("value") - F.col("v0")) >= 10)
    return c.select("event_id", (F.col("d") >= 20).alias("hard"), slow.alias("slow")).where("hard or slow")


@query("run_midpoints", _RUNS + """ select series, first_id, s - coalesce(s - lag(e) over w, 0) // 2 as from_us, e + coalesce(lead(s) over w - e, 0) // 2 as to_us from r window w as (partition by series order by s, first_id)""")
def run_midpoints(spark, sf):
    r = islands(observations(spark, sf), series="series", time="us", key="event_id", label="label", gap=DAY)
    w = Window.partitionBy("series").orderBy("s", "first_id")
    half = lambda x: F.floor(F.coalesce(x, F.lit(0)) / 2)
    return r.select("series", "first_id", (F.col("s") - half(F.col("s") - F.lag("e").over(w))).alias("from_us"), (F.col("e") + half(F.lead("s").over(w) - F.col("e"))).alias("to_us"))


@query("reference_agreement", "with e as (select vec_id, label, vec_id % 40 as track, embedding::double[] as v from embeddings), p as (select a.track, b.label, list_cosine_similarity(a.v, b.v) as c, a.vec_id from e a join e b on a.label = b.label and a.vec_id <> b.vec_id), m as (select track, label, vec_id, max(c) as c from p group by all) select track, label, count(*) as n from m group by all having count(*) >= 2 and avg(case when c >= 0.25 then 1.0 else 0 end) >= 0.75")
def reference_agreement(spark, sf):
    m = _alike(spark, sf, k=1).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"), "label"), "a")
    g = m.groupBy((F.col("a") % 40).alias("track"), "label").agg(F.count("*").alias("n"), F.avg(F.when(F.col("c") >= 0.25, 1.0).otherwise(0.0)).alias("share"))
    return g.where("n >= 2 and share >= 0.75").select("track", "label", "n")


@query("same_owner_everywhere", "with s as (select o_custkey, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as sig from orders group by 1) select sig, count(*) as members, min(o_custkey) as first from s group by sig")
def same_owner_everywhere(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("sig"))
    return s.groupBy("sig").agg(F.count("*").alias("members"), F.min("o_custkey").alias("first"))


@query("unconflicted_names", "select p_partkey // 3 as number, min(p_type) as name from part group by 1 having count(distinct p_type) = 1")
def unconflicted_names(spark, sf):
    p = table(spark, sf, "part").withColumn("number", F.floor(F.col("p_partkey") / 3))
    return p.groupBy("number").agg(F.min("p_type").alias("name"), F.count_distinct("p_type").alias("n")).where("n = 1").select("number", "name")


@query("merged_words", """with w as (select distinct on (sound_id) sound_id, source_id, lower(trim(word)) as word, start, end_sec, prob from source_sound where kind = 'word' and source_id is not null and word is not null and isfinite(start) and isfinite(end_sec) and end_sec >= start),
m as (select *, case when lag(word) over x = word and start - lag(end_sec) over x <= 0.45 then 0 else 1 end as opens from w window x as (partition by source_id order by start, sound_id)),
k as (select *, sum(opens) over (partition by source_id order by start, sound_id rows unbounded preceding) as g from m)
select source_id, min(word) as word, min(start) as start, max(end_sec) as end_sec, max(prob) as prob, count(*) as n from k group by source_id, g""")
def merged_words(spark, sf):
    s = table(spark, sf, "source_sound").where("kind = 'word' and source_id is not null and word is not null").where(M.is_number(F.col("start")) & M.is_number(F.col("end_sec")) & (F.col("end_sec") >= F.col("start")))
    s = s.dropDuplicates(["sound_id"]).withColumn("word", F.lower(F.trim("word")))
    w = Window.partitionBy("source_id").orderBy("start", "sound_id")
    goes = (F.lag("word").over(w) == F.col("word")) & (F.col("start") - F.lag("end_sec").over(w) <= 0.45)
    k = s.withColumn("opens", F.when(goes, 0).otherwise(1)).withColumn("g", F.sum("opens").over(w))
    return k.groupBy("source_id", "g").agg(F.min("word").alias("word"), F.min("start").alias("start"), F.max("end_sec").alias("end_sec"), F.max("prob").alias("prob"), F.count("*").alias("n")).drop("g")


@query("zero_filled_grid", _OBS + """, h as (select label, us // 86400000000 as day, count(*) as n from o group by all), d as (select unnest(range((select min(day) from h), (select max(day) from h) + 1)) as day),
l as (select distinct label from h) select l.label, d.day, coalesce(n, 0) as n from l cross join d left join h on h.label = l.label and h.day = d.day""")
def zero_filled_grid(spark, sf):
    return _grid(observations(spark, sf))


def _grid(o):
    h = o.groupBy("label", F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"))
    span = h.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"), F.lit(1).alias("one"))
    grid = h.select("label").distinct().withColumn("one", F.lit(1)).join(span, "one").drop("one")
    return grid.join(h, ["label", "day"], "left").select("label", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query("overlap_add", "with p as (select l_orderkey % 10 as plan, l_linenumber as track, (l_partkey % 20) + k as pos, l_quantity as x from lineitem, range(3) as r(k)), s as (select plan, pos, sum(x) as x from p group by all) select plan, pos, round(x / greatest(1, max(abs(x)) over (partition by plan)), 9) as x from s")
def overlap_add(spark, sf):
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 10).alias("plan"), F.explode(F.sequence(F.col("l_partkey") % 20, F.col("l_partkey") % 20 + 2)).alias("pos"), F.col("l_quantity").alias("x"))
    s = p.groupBy("plan", "pos").agg(F.sum("x").alias("x"))
    return s.select("plan", "pos", F.round(F.col("x") / F.greatest(F.lit(1.0), F.max(F.abs("x")).over(Window.partitionBy("plan"))), 9).alias("x"))


@query("placed_nests", """with e as (select p_partkey // 3 as parent, p_partkey as child, (p_partkey % 7)::bigint as a, (p_partkey % 7 + 20 + p_size)::bigint as b, (p_partkey % 2)::bigint as i from part where p_partkey > 0),
w as (select child as node, a as s, b as e, a - i as shift, 1 as depth from e where parent = 0) select 0::bigint as root, node, s, e, depth from (
 with recursive r as (select * from w union all select e.child, greatest(r.s, e.a + r.shift), least(r.e, e.b + r.shift), e.a + r.shift - e.i, r.depth + 1 from r join e on e.parent = r.node where least(r.e, e.b + r.shift) > greatest(r.s, e.a + r.shift)) select * from r)""")
def placed_nests(spark, sf):
    return _nests(table(spark, sf, "part"))


def _nests(part):
    k = F.col("p_partkey")
    # 0 is the root itself
    e = part.where("p_partkey > 0").select(F.floor(k / 3).alias("parent"), k.alias("child"), (k % 7).alias("start"), (k % 7 + 20 + F.col("p_size")).alias("end"), (k % 2).alias("source_in"))
    roots = part.sparkSession.range(1).withColumnRenamed("id", "node")
    return graph.flatten(e, roots).select("root", "node", "s", "e", "depth")


@query("plan_errors", "select o_orderkey, unnest(list_filter([case when o_totalprice <= 50000 then 'price' end, case when o_orderstatus not in ('O', 'F') then 'status' end, case when extract(year from o_orderdate) < 1993 then 'date' end], lambda x: x is not null)) as issue from orders")
def plan_errors(spark, sf):
    from strandline.operators.relational import issues

    rules = {"price": F.col("o_totalprice") > 50000, "status": F.col("o_orderstatus").isin("O", "F"), "date": F.year("o_orderdate") >= 1993}
    return issues(table(spark, sf, "orders"), "o_orderkey", rules)


@query("least_used_pick", "with c as (select p_type, p_brand, count(*) as used, avg(p_retailprice) as price from part group by all) select p_type, arg_min(p_brand, (used, -round(price, 6), p_brand)) as p_brand from c group by p_type")
def least_used_pick(spark, sf):
    c = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("used"), F.avg("p_retailprice").alias("price"))
    return c.groupBy("p_type").agg(F.min(F.struct("used", (-F.round("price", 6)).alias("price"), "p_brand")).alias("m")).select("p_type", "m.p_brand")


@query("mouth_shape", """with x as (select distinct sample_id, mouth_clarity as o, closeup_score as w, clear_face as r, speaking * 2 - 1 as s from samples where mouth_clarity is not null and closeup_score is not null and clear_face is not null and speaking is not null)
select sample_id, case when o < 0.12 then 'CLOSED' when s < -0.25 and o > 0.2 then 'CRY' when s > 0.35 and o > 0.18 and w > 0.45 then 'HAHA' when r > 0.55 and o > 0.22 and o < 0.75 and w < 0.7 then 'O' when w > 0.62 and o < 0.45 then 'E' when o > 0.35 then 'A' else 'NEUTRAL' end as label,
round(case when o < 0.12 then least(1, 0.6 + (0.12 - o) * 2) when s < -0.25 and o > 0.2 then least(1, 0.55 + abs(s) * 0.4) when s > 0.35 and o > 0.18 and w > 0.45 then least(1, 0.55 + s * 0.4) when r > 0.55 and o > 0.22 and o < 0.75 and w < 0.7 then least(1, 0.5 + r * 0.4) when w > 0.62 and o < 0.45 then least(1, 0.5 + w * 0.3) when o > 0.35 then least(1, 0.5 + o * 0.4) else 0.4 end, 9) as confidence from x""")
def mouth_shape(spark, sf):
    x = table(spark, sf, "samples").select("sample_id", "mouth_clarity", "closeup_score", "clear_face", (F.col("speaking") * 2 - 1).alias("s")).dropna().distinct()
    m = E.mouth(F.col("mouth_clarity"), F.col("closeup_score"), F.col("clear_face"), F.col("s"))
    return x.select("sample_id", m.alias("m")).select("sample_id", "m.label", F.round("m.confidence", 9).alias("confidence"))
