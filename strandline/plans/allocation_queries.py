"""Queries of assignments, contracts, models and settings, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import maths as M
from strandline.operators import allocation as A
from strandline.operators import series as S
from strandline.operators.ordered_scan import running
from strandline.plans.rule_queries import _EMB, _SMP, _samples
from strandline.sources import models
from strandline.sources.tables import intervals, observations, table

QUERIES, SQL = {}, {}
MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
c = F.col


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_IV = "with iv as (select user_id as series, epoch_us(ts) as s, epoch_us(ts) + floor(value * 60)::bigint * 1000000 as e, event_id as id, event_type as kind, case when value >= 60 then 0 else 1 end as tier from events where ts is not null)"
_NEEDS = (120, 60, 30, 10, 5)


@query("ranked_allocation", _IV.replace("with", "with recursive") + """, n as (select row_number() over (order by m desc) as step, m * 60000000::bigint as len, i from (values (0, 120), (1, 60), (2, 30), (3, 10), (4, 5)) t(i, m)),
c as (select distinct series from iv where e > s),
r as (select series, 0::bigint as step, []::struct(d int, id bigint, s bigint, e bigint, kind varchar)[] as got from c
 union all select r.series, n.step, list_concat(r.got, coalesce((select [arg_min({'d': n.i, 'id': iv.id, 's': iv.s, 'e': iv.s + n.len, 'kind': iv.kind}, (iv.tier, len(list_filter(r.got, lambda x: x.kind = iv.kind)), iv.s, iv.id))] from iv
  where iv.series = r.series and iv.e - iv.s >= n.len and len(list_filter(r.got, lambda x: iv.s < x.e + 300000000 and x.s - 300000000 < iv.s + n.len)) = 0 and len(list_filter(r.got, lambda x: x.kind = iv.kind)) < 2), []))
 from r join n on n.step = r.step + 1)
select r.series, n.i as demand, (list_filter(r.got, lambda x: x.d = n.i))[1].id as candidate from r cross join n where r.step = 5""")
def ranked_allocation(spark, sf):
    iv = intervals(spark, sf).where("s is not null and e > s").withColumn("kind", c("label")).withColumn("tier", F.when(c("e") - c("s") >= HOUR, 0).otherwise(1))
    lengths = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(n * MINUTE).cast("bigint").alias("length")) for i, n in enumerate(_NEEDS)]))
    demands = iv.select("series").distinct().withColumn("x", lengths).select("series", "x.id", "x.length")
    found = A.allocate_ranked(demands, iv.select("series", c("event_id").alias("id"), "s", "e", "kind", "tier"), plan="series", gap=5 * MINUTE, most_alike=2)
    return found.select("series", "demand", "candidate")


_APPS = "with a as (select distinct appearance_id as k, source_id, character_id, round(start_sec * 1000)::bigint as s, round(end_sec * 1000)::bigint as e, confidence from appearances where source_id is not null and isfinite(start_sec) and isfinite(end_sec))"


def _apps(spark, sf):
    a = table(spark, sf, "appearances").drop("ingested_at").distinct().where("source_id is not null").where(M.is_number(c("start_sec")) & M.is_number(c("end_sec")))
    return a.select(c("appearance_id").alias("k"), "source_id", "character_id", F.round(c("start_sec") * 1000).cast("bigint").alias("s"), F.round(c("end_sec") * 1000).cast("bigint").alias("e"), "confidence")


@query("contract_fold", _APPS.replace("with", "with recursive") + """, o as (select *, row_number() over (partition by source_id order by -round(coalesce(confidence, 0), 6), k) as i, e > s and character_id is not null as ok from a),
r as (select source_id, 0::bigint as i, null::bigint as k, null::varchar as issue, []::struct(s bigint, e bigint, c bigint)[] as got from o group by source_id
 union all select o.source_id, o.i, o.k, case when not o.ok then 'invalid' when len(list_filter(r.got, lambda x: x.c = o.character_id)) > 0 then 'slot' when len(list_filter(r.got, lambda x: o.s < x.e + 1000 and x.s < o.e + 1000)) > 0 then 'near' end,
 case when o.ok and len(list_filter(r.got, lambda x: x.c = o.character_id)) = 0 and len(list_filter(r.got, lambda x: o.s < x.e + 1000 and x.s < o.e + 1000)) = 0 then list_append(r.got, {'s': o.s, 'e': o.e, 'c': o.character_id}) else r.got end
 from r join o on o.source_id = r.source_id and o.i = r.i + 1)
select source_id, k, issue, case when issue is null then len(got) end as rank from r where i > 0""")
def contract_fold(spark, sf):
    """Appearances by confidence: one per character and source, a second apart from those accepted before."""
    a = _apps(spark, sf).withColumn("place", -F.round(F.coalesce("confidence", F.lit(0.0)), 6)).withColumn("valid", (c("e") > c("s")) & c("character_id").isNotNull())
    return A.accepted_in_order(a, plan="source_id", slot="character_id", key="k", gap=1000).select("source_id", "k", "issue", "rank")


@query("best_recording", """with s as (select distinct sound_id, source_id, kind, lower(word) as word, prob, start from source_sound where source_id is not null), w as (select * from s where kind = 'word' and word = 'hello' and prob >= 0.6),
n as (select source_id, sound_id, 0 as source, -prob as o from w union all select source_id, sound_id, 1, -prob from s where kind = 'action' and prob >= 0.8 union all select source_id, sound_id, 2, sound_id from s)
select source_id, sound_id, source from n qualify row_number() over (partition by source_id order by source, o, sound_id) = 1""")
def best_recording(spark, sf):
    """A recording per source: the word itself, else a sure sound, else the least one (AS6-AS8)."""
    s = table(spark, sf, "source_sound").where("source_id is not null").dropDuplicates(["sound_id"]).withColumn("word", F.lower("word"))
    take = lambda rows, order: rows.select("source_id", "sound_id", order.cast("double").alias("o"))
    word, sure = s.where("kind = 'word' and word = 'hello' and prob >= 0.6"), s.where("kind = 'action' and prob >= 0.8")
    return A.by_priority([take(word, -c("prob")), take(sure, -c("prob")), take(s, c("sound_id"))], "source_id", [c("o"), c("sound_id")]).drop("o")


_PAIRS = """with recursive s as (select distinct sound_id, source_id, kind, start, prob from source_sound where source_id is not null and isfinite(start) and prob is not null),
p as (select w.sound_id as a, x.sound_id as b, round(w.prob + x.prob - abs(w.start - x.start) / 10, 6) as score, w.source_id from s w join s x on w.source_id = x.source_id and w.kind = 'word' and x.kind = 'action' and abs(w.start - x.start) <= 2),
o as (select *, row_number() over (partition by source_id order by score desc, a, b) as i from p)"""


@query("matched_pairs", _PAIRS + """, r as (select source_id, 0::bigint as i, null::bigint as a, null::bigint as b, false as ok, []::bigint[] as ga, []::bigint[] as gb from o group by source_id
 union all select o.source_id, o.i, o.a, o.b, not list_contains(r.ga, o.a) and not list_contains(r.gb, o.b), case when list_contains(r.ga, o.a) or list_contains(r.gb, o.b) then r.ga else list_append(r.ga, o.a) end,
 case when list_contains(r.ga, o.a) or list_contains(r.gb, o.b) then r.gb else list_append(r.gb, o.b) end from r join o on o.source_id = r.source_id and o.i = r.i + 1) select a, b from r where ok""")
def matched_pairs(spark, sf):
    """Words with sounds that lie within two seconds, one to one."""
    s = table(spark, sf, "source_sound").where("source_id is not null and prob is not null").where(M.is_number(c("start"))).dropDuplicates(["sound_id"])
    cell = F.floor(c("start") / 2)
    w = s.where("kind = 'word'").select("source_id", c("sound_id").alias("a"), c("start").alias("t"), c("prob").alias("p"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    x = s.where("kind = 'action'").select("source_id", c("sound_id").alias("b"), c("start").alias("u"), c("prob").alias("q"), cell.alias("cell"))
    near = w.join(x, ["source_id", "cell"]).where(F.abs(c("t") - c("u")) <= 2)
    return A.matched(near.select("a", "b", F.round(c("p") + c("q") - F.abs(c("t") - c("u")) / 10, 6).alias("score"))).select("a", "b")


@query("completion_flags", """with p as (select p_brand, p_partkey, p_type = 'PROMO' as whole, p_size <= 5 as apart, p_partkey % 7 <> 0 as own from part),
t as (select *, case when whole and apart and own then 0 when apart and own then 1 when own then 2 else 3 end as tier from p), b as (select p_brand, min(tier) as best from t group by p_brand)
select p_brand, p_partkey, tier, concat_ws(',', case when not whole then 'boundary' end, case when not apart then 'gap' end, case when not own then 'duplicate' end) as flags from t join b using (p_brand) where tier = best""")
def completion_flags(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_type", "p_size")
    tiers = [{"boundary": c("p_type") == "PROMO"}, {"gap": c("p_size") <= 5}, {"duplicate": c("p_partkey") % 7 != 0}]
    return A.relaxed(p, key="p_brand", tiers=tiers).select("p_brand", "p_partkey", "tier", "flags")


@query("recent_labels", """with recursive l as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, l_linestatus) as i, l_returnflag as a, l_linestatus as b, 'X' || (l_linenumber % 2) as c from lineitem),
r as (select k, i, [a] as got from l where i = 1 union all select l.k, l.i, list_append(r.got, case when not list_contains(r.got[-2:], l.a) then l.a when not list_contains(r.got[-2:], l.b) then l.b when not list_contains(r.got[-2:], l.c) then l.c else l.a end) from r join l on l.k = r.k and l.i = r.i + 1)
select k as l_orderkey, array_to_string(arg_max(got, i), ',') as labels from r group by k""")
def recent_labels(spark, sf):
    options = F.array("l_returnflag", "l_linestatus", F.concat(F.lit("X"), (c("l_linenumber") % 2).cast("string")))
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", options.alias("o")))).alias("a"))
    return o.select("l_orderkey", F.array_join(A.not_recent(F.transform("a", lambda x: x["o"])), ",").alias("labels"))


@query("virtual_axis", "with s as (select source_id, case when isfinite(duration_sec) then round(duration_sec * 1000)::bigint else 0 end as d from sources) select source_id, coalesce(sum(d + 2000) over (order by source_id rows between unbounded preceding and 1 preceding), 0)::bigint as offset_ms from s")
def virtual_axis(spark, sf):
    """Sources one after another on one axis, with a separator that no gap rule bridges (SI8-SI10); taking it off gives local times."""
    known = F.when(M.is_number(c("duration_sec")), F.round(c("duration_sec") * 1000).cast("bigint")).otherwise(0)
    return running(table(spark, sf, "sources").select("source_id", (known + 2000).alias("d")), ["source_id"], "d", "offset_ms").drop("d")


@query("slot_batches", _SMP + " select sample_id, (row_number() over (partition by source_id order by time_sec, sample_id) - 1) // 16 as batch from s where category is null")
def slot_batches(spark, sf):
    """What is unresolved, in batches of 16 per source (JN20); a hot source is numbered block by block."""
    s = _samples(spark, sf).where("category is null").select("sample_id", "source_id", "time_sec", F.floor(c("time_sec") * 1000000).cast("bigint").alias("us"))
    n = S.running_sum(s, series="source_id", time="us", order=["time_sec", "sample_id"], value=F.lit(1), name="n", inclusive=False)
    return n.select("sample_id", F.floor(c("n") / 16).alias("batch"))


_OBS = "with o as (select user_id as series, epoch_us(ts) as us, event_type as label, value, event_id from events)"


@query("suppressed_events", _OBS + """, w as (select *, count(*) over x as n, min(label) over x = max(label) over x as same, max(value) over x as top from o window x as (partition by series order by us range between 86400000000 preceding and 86400000000 following))
select event_id from w where n >= 3 and same and top < 40""")
def suppressed_events(spark, sf):
    """Events that consistent rows on both sides bracket, with no hard change near (WN21)."""
    x = Window.partitionBy("series").orderBy("us").rangeBetween(-DAY, DAY)
    w = observations(spark, sf).select("event_id", F.count("*").over(x).alias("n"), (F.min("label").over(x) == F.max("label").over(x)).alias("same"), F.max("value").over(x).alias("top"))
    return w.where("n >= 3 and same and top < 40").select("event_id")


@query("even_subsample", "with p as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) - 1 as i, count(*) over (partition by p_brand) as n from part) select p_brand, p_partkey from p where n <= 8 or list_contains(list_transform(range(8), lambda j: (j * (n - 1)) // 7), i)")
def even_subsample(spark, sf):
    """Eight rows of a group at even positions (SR11)."""
    w = Window.partitionBy("p_brand")
    p = table(spark, sf, "part").select("p_brand", "p_partkey", (F.row_number().over(w.orderBy("p_partkey")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.floor(j * (c("n") - 1) / 7))
    return p.where((c("n") <= 8) | F.array_contains(at, c("i").cast("bigint"))).select("p_brand", "p_partkey")


@query("corrected_rows", _APPS + ", k as (select k, s, case when k % 10 = 0 then s + 500 else e end as e from a) select k, e - s as length, e > s as valid from k")
def corrected_rows(spark, sf):
    """Corrections are laid over the rows, which are then checked anew (VL9)."""
    a = _apps(spark, sf)
    fixed = a.where("k % 10 = 0").select("k", (c("s") + 500).alias("new_e"))
    k = a.join(fixed, "k", "left").withColumn("e", F.coalesce("new_e", "e"))
    return k.select("k", (c("e") - c("s")).alias("length"), (c("e") > c("s")).alias("valid"))


# Models: stand-ins whose answers SQL can give too.


def _measure():
    return lambda rows: pd.DataFrame({"openness": rows["mouth_clarity"].fillna(0).clip(0, 1) * 0.5, "seen": rows["face_visible"].fillna(0) >= 0.5})


@query("model_measures", "select distinct sample_id, round(greatest(0, least(1, case when mouth_clarity is null or isnan(mouth_clarity) then 0 else mouth_clarity end)) * 0.5, 6) as openness, coalesce(face_visible, 0) >= 0.5 as seen from samples")
def model_measures(spark, sf):
    """Landmarks and poses of each row (UD1, UD3)."""
    s = table(spark, sf, "samples").dropDuplicates(["sample_id"])
    m = models.observed(s, key="sample_id", inputs=["mouth_clarity", "face_visible"], name="measure", load=_measure, schema="openness double, seen boolean")
    return m.select("sample_id", F.round("openness", 6).alias("openness"), "seen")


def _regions():
    def run(rows):
        return pd.DataFrame({"x": [[(k * 7 + 30 * i) % 90 for i in range(3)] for k in rows["p_partkey"]], "score": [[(k * (i + 3)) % 17 for i in range(3)] for k in rows["p_partkey"]]})

    return run


@query("model_regions", "with r as (select p_partkey, (p_partkey * 7 + 30 * i) % 90 as x, (p_partkey * (i + 3)) % 17 as score from part, range(3) t(i)) select p_partkey, x, score from r qualify row_number() over (partition by p_partkey, x // 45 order by score desc, x) = 1")
def model_regions(spark, sf):
    """Several regions of a row, of which near ones count once, the best (UD2)."""
    r = models.observed(table(spark, sf, "part"), key="p_partkey", inputs=["p_partkey"], name="regions", load=_regions, schema="x array<bigint>, score array<bigint>")
    r = r.select("p_partkey", F.explode(F.arrays_zip("x", "score")).alias("r")).select("p_partkey", "r.*")
    w = Window.partitionBy("p_partkey", F.floor(c("x") / 45)).orderBy(F.desc("score"), "x")
    return r.withColumn("n", F.row_number().over(w)).where("n = 1").select("p_partkey", "x", "score")


def _embedder():
    def run(rows):
        if len(rows) > 16:
            raise MemoryError
        return pd.DataFrame({"length": [float((v.astype("float64") ** 2).sum() ** 0.5) for v in rows["embedding"]]})

    return run


@query("model_embeddings", _EMB + " select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) as length, null::varchar as problem from e")
def model_embeddings(spark, sf):
    """Batches that find no room are halved until they do (UD4, UD5)."""
    m = models.observed(table(spark, sf, "embeddings"), key="vec_id", inputs=["embedding"], name="embedder", load=_embedder, schema="length double")
    return m.select("vec_id", F.round("length", 4).alias("length"), "problem")


def _absent():
    raise RuntimeError("no device")


def _spoken():
    return lambda rows: pd.DataFrame({"heard": rows["word"].str.lower().str.strip()})


@query("model_speech", "select distinct sound_id, lower(trim(word)) as heard from source_sound where word is not null")
def model_speech(spark, sf):
    """A recogniser that isn't there is replaced by its fallback (UD7), loaded once per worker (UD11)."""
    s = table(spark, sf, "source_sound").where("word is not null").dropDuplicates(["sound_id"])
    return models.observed(s, key="sound_id", inputs=["word"], name="speech", load=_absent, fallback=_spoken, schema="heard string").select("sound_id", "heard")


def _strict():
    def run(rows):
        if (rows["p_size"] == 13).any():
            return pd.DataFrame({"grade": [1.0]}) if len(rows) > 1 else pd.DataFrame({"other": [0]})
        return pd.DataFrame({"grade": rows["p_size"].to_numpy() / 10.0})

    return run


@query("model_strict", "select p_partkey, case when p_size <> 13 and p_size <= 45 then p_size / 10.0 end as grade, case when p_size = 13 then 'answer of another shape' when p_size > 45 then 'answer that isn''t valid' end as problem from part")
def model_strict(spark, sf):
    """Answers are checked; a bad batch is split until the bad rows stand alone (UD8, UD10)."""
    check = lambda out: bool((out["grade"] <= 4.5).all())
    return models.observed(table(spark, sf, "part"), key="p_partkey", inputs=["p_size"], name="strict", load=_strict, schema="grade double", check=check)


def _paired():
    return lambda rows: pd.DataFrame({"same": rows["a"].fillna("").str.lower() == rows["b"].fillna("").str.lower()})


@query("model_pairs", _SMP + ", e as (select source_id, shot_id, arg_min(coalesce(category, ''), (time_sec, sample_id)) as a, arg_max(coalesce(category, ''), (time_sec, sample_id)) as b, min(sample_id) as k from s where shot_id is not null group by all) select k, lower(a) = lower(b) as same from e")
def model_pairs(spark, sf):
    """Two samples of a shot are looked at together (UD9)."""
    at, name = F.struct("time_sec", "sample_id"), F.coalesce("category", F.lit(""))
    e = _samples(spark, sf).where("shot_id is not null").groupBy("source_id", "shot_id").agg(F.min_by(name, at).alias("a"), F.max_by(name, at).alias("b"), F.min("sample_id").alias("k"))
    return models.observed(e, key="k", inputs=["a", "b"], name="paired", load=_paired, schema="same boolean").select("k", "same")


@query("model_refined", _SMP + ", best as (select source_id, shot_id from s where shot_id is not null group by all having avg(speaking) >= 0.3) select sample_id, round(greatest(0, least(1, coalesce(closeup_score, 0))) * 2, 6) as dense from s where (source_id, shot_id) in (select source_id, shot_id from best)")
def model_refined(spark, sf):
    """Dense work only on what was chosen (UD12)."""
    s = _samples(spark, sf)
    best = s.where("shot_id is not null").groupBy("source_id", "shot_id").agg(F.avg("speaking").alias("m")).where("m >= 0.3")
    dense = lambda: lambda rows: pd.DataFrame({"dense": rows["closeup_score"].fillna(0).clip(0, 1) * 2})
    m = models.observed_within(s, best, on=["source_id", "shot_id"], key="sample_id", inputs=["closeup_score"], name="dense", load=dense, schema="dense double")
    return m.select("sample_id", F.round("dense", 6).alias("dense"))
