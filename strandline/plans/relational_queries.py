"""Queries of joins, aggregations, expressions and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import maths as M
from strandline.functions import text as X
from strandline.operators import graph
from strandline.operators import relational as R
from strandline.operators.boxes import overlapping, sole_owner
from strandline.operators.ordered_scan import running
from strandline.operators.similar import similar_blocks
from strandline.sources.tables import observations, table

QUERIES, SQL = {}, {}
_OBS = "with o as (select user_id as series, epoch_us(ts) as us, event_type as label, value, event_id from events)"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("label_histogram", "select source, lang, count(*) as n from documents group by all")
def label_histogram(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("weighted_argmax", _OBS + ", s as (select series, label, sum(round(value * 100)::bigint) as w from o group by all) select series, arg_max(label, (w, label)) as label, max(w)::bigint as w from s group by series")
def weighted_argmax(spark, sf):
    s = observations(spark, sf).groupBy("series", "label").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("w"))
    return s.groupBy("series").agg(F.max(F.struct("w", "label")).alias("m")).select("series", "m.label", "m.w")


@query("null_propagating_sum", "select source_id, case when count(speaking) = count(*) then round(sum(speaking), 4) end as speaking, round(sum(speaking), 4) as known from samples group by source_id")
def null_propagating_sum(spark, sf):
    return table(spark, sf, "samples").groupBy("source_id").agg(F.round(R.strict_sum(F.col("speaking")), 4).alias("speaking"), F.round(F.sum("speaking"), 4).alias("known"))


@query("fraction_by_group", _OBS + ", n as (select series, label, count(*) as n from o group by all) select series, label, round(n / sum(n) over (partition by series), 6) as share from n qualify n >= 0.2 * sum(n) over (partition by series)")
def fraction_by_group(spark, sf):
    n = observations(spark, sf).groupBy("series", "label").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("series")))
    return n.where("n >= 0.2 * all").select("series", "label", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("ordered_group_instances", "select o_custkey, max(o_totalprice) as most, count(*) as n, string_agg(o_orderkey::varchar, ',' order by o_orderdate, o_orderkey) as orders from orders group by o_custkey")
def ordered_group_instances(spark, sf):
    o = table(spark, sf, "orders")
    g = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("a"))
    return g.select("o_custkey", "most", "n", F.array_join(F.transform("a", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("agreeing_groups", "select l_suppkey, count(*) as n from lineitem group by l_suppkey having avg(case when l_discount >= 0.02 then 1.0 else 0.0 end) >= 0.81")
def agreeing_groups(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg(F.when(F.col("l_discount") >= 0.02, 1.0).otherwise(0.0)).alias("share"))
    return g.where("share >= 0.81").select("l_suppkey", "n")


@query("masked_mean", "select source_id, round(coalesce(avg(closeup_score) filter (speaking > 0), avg(closeup_score)), 6) as m from samples group by source_id")
def masked_mean(spark, sf):
    return table(spark, sf, "samples").groupBy("source_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("speaking") > 0, F.col("closeup_score"))), F.avg("closeup_score")), 6).alias("m"))


@query("token_normalise", "select doc_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) as t, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as token, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from documents")
def token_normalise(spark, sf):
    """All titles. Tokens and slugs hold a-z and 0-9 only."""
    return _normalised(table(spark, sf, "documents"))


def _normalised(d):
    return d.select("doc_id", X.normalise(F.col("title")).alias("t"), X.token(F.col("title")).alias("token"), X.slug(F.col("title")).alias("slug"))


@query("junk_text", "select p_partkey, l >= 8 and d <= 6 as junk from (select p_partkey, length(t) as l, len(list_distinct(string_split(t, ''))) as d from (select p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') as t from part))")
def junk_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.is_junk(F.col("p_name"), 8, 6).alias("junk"))


@query("repeat_collapse", "select p_partkey, array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 or c[i] <> c[i - 1]), lambda i: c[i]), '') as t from (select p_partkey, string_split(p_name, '') as c from part)")
def repeat_collapse(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.collapse_repeats(F.col("p_name")).alias("t"))


@query("file_stem", "select source_id, regexp_extract(media_path, '([^/\\\\]+?)(\\.[^./\\\\]*)?$', 1) as stem from sources")
def file_stem(spark, sf):
    return table(spark, sf, "sources").select("source_id", X.file_stem(F.col("media_path")).alias("stem"))


@query("range_list_expand", """with p as (select p_partkey, p_size as a, p_size + p_partkey % 4 as b from part)
select p_partkey, unnest(list_concat(range(a, b + 1), [b + 2])) as n from p""")
def range_list_expand(spark, sf):
    p = table(spark, sf, "part").withColumn("b", F.col("p_size") + F.col("p_partkey") % 4)
    text = F.concat_ws(",", F.concat_ws("-", F.col("p_size").cast("string"), F.col("b").cast("string")), (F.col("b") + 2).cast("string"))
    return p.select("p_partkey", F.explode(X.expand_ranges(text).cast("array<bigint>")).alias("n"))


@query("ticks_roundtrip", "select event_id, round(value * 254016000000)::bigint as ticks from events")
def ticks_roundtrip(spark, sf):
    e = table(spark, sf, "events").select("event_id", M.seconds_to_ticks(F.col("value")).alias("ticks"))
    return e.withColumn("ticks", M.seconds_to_ticks(M.ticks_to_seconds(F.col("ticks").cast("string"))))


@query("snap_to_frame", "select event_id, floor(value * 24 + 0.5)::bigint as frame from events")
def snap_to_frame(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(M.snap(F.col("value"), 24.0) * 24).cast("bigint").alias("frame"))


_BOX = "with b as (select p_partkey as k, p_partkey % 50 as g, (p_partkey * 7) % 90 as x, (p_partkey * 13) % 80 as y, 20 + p_size as w, 15 + p_size % 20 as h from part)"
_IOU = """, i as (select a.g, a.k, b.k as other, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as n, a.w * a.h + b.w * b.h as s
 from b a join b on a.g = b.g and a.k < b.k)"""


def _boxes(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("k"), (k % 50).alias("g"), ((k * 7) % 90).alias("x"), ((k * 13) % 80).alias("y"), (20 + F.col("p_size")).alias("w"), (15 + F.col("p_size") % 20).alias("h"))


@query("iou_pairs", _BOX + _IOU + " select k, other, round(n / greatest(1, s - n), 6) as iou from i where n / greatest(1, s - n) >= 0.45")
def iou_pairs(spark, sf):
    return overlapping(_boxes(spark, sf), group="g", key="k", measure=M.iou, least=0.45).withColumn("iou", F.round("iou", 6))


@query("containment_owner", _BOX + """, c as (select a.k, o.k as owner from b a join b o on a.g = o.g and a.k <> o.k and a.x >= o.x and a.y >= o.y and a.x + a.w <= o.x + o.w and a.y + a.h <= o.y + o.h)
select k, min(owner) as owner from c group by k having count(*) = 1""")
def containment_owner(spark, sf):
    return sole_owner(_boxes(spark, sf), group="g", key="k")


@query("argmax_margin", "select sample_id, label, round(m, 6) + 0.0 as margin from (select sample_id, case when greatest(a, b, c) < 0.22 then 'neutral' when a >= b and a >= c then 'clear' when b >= c then 'close' else 'mouth' end as label, greatest(a, b, c) - (a + b + c - greatest(a, b, c) - least(a, b, c)) as m from (select distinct sample_id, coalesce(clear_face, 0) as a, coalesce(closeup_score, 0) as b, coalesce(mouth_clarity, 0) as c from samples))")
def argmax_margin(spark, sf):
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    picked = M.pick_with_margin({"clear": zero("clear_face"), "close": zero("closeup_score"), "mouth": zero("mouth_clarity")}, 0.22)
    return table(spark, sf, "samples").dropDuplicates(["sample_id"]).select("sample_id", picked.alias("p")).select("sample_id", "p.label", (F.round("p.margin", 6) + 0.0).alias("margin"))


@query("evidence_tier", "select distinct sample_id, case when face_visible >= 0.9 and clear_face >= 0.85 and speaking >= 0.35 then 1 when face_visible >= 0.999 and closeup_score >= 0.25 then 2 when face_visible >= 0.2 then 3 when coalesce(speaking, 0) <= 0.25 then 4 else 0 end as tier from samples")
def evidence_tier(spark, sf):
    c = F.col
    tier = M.first_rule([((c("face_visible") >= 0.9) & (c("clear_face") >= 0.85) & (c("speaking") >= 0.35), 1), ((c("face_visible") >= 0.999) & (c("closeup_score") >= 0.25), 2), (c("face_visible") >= 0.2, 3), (F.coalesce(c("speaking"), F.lit(0)) <= 0.25, 4)], 0)
    return table(spark, sf, "samples").select("sample_id", tier.alias("tier")).distinct()


@query("bit_reversed_order", "select n_nationkey, (n_nationkey & 1) * 16 + ((n_nationkey >> 1) & 1) * 8 + ((n_nationkey >> 2) & 1) * 4 + ((n_nationkey >> 3) & 1) * 2 + ((n_nationkey >> 4) & 1) as place from nation")
def bit_reversed_order(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", M.bit_reversed(F.col("n_nationkey").cast("bigint"), 5).alias("place"))


@query("all_readings_match", """with need as (select o_custkey as c, count(distinct o_orderpriority) as n from orders group by 1), want as (select distinct o_custkey as c, o_orderpriority as p from orders),
have as (select distinct o_custkey as c, extract(year from o_orderdate) as y, o_orderpriority as p from orders)
select c as o_custkey, y::bigint as year from have join want using (c, p) join need using (c) group by c, y, need.n having count(distinct p) = need.n""")
def all_readings_match(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("bigint"))
    return R.divide(o.select("o_custkey", "year", "o_orderpriority"), o.select("o_custkey", "o_orderpriority"), keep=["o_custkey", "year"], by="o_orderpriority")


@query("tiered_anchor_join", """select sound_id, category_list.category, case when prob >= 0.8 then 1 else 2 end as tier from (select distinct sound_id, word, prob from source_sound where kind = 'word' and prob >= 0.6) s
join category_list on substr(lower(trim(word)), 1, 1) = substr(category_list.category, 1, 1)""")
def tiered_anchor_join(spark, sf):
    s = table(spark, sf, "source_sound").where("kind = 'word' and prob >= 0.6").select("sound_id", "word", "prob").distinct()
    c = table(spark, sf, "category_list").select("category", F.substring("category", 1, 1).alias("i"))
    return s.withColumn("i", F.substring(F.lower(F.trim("word")), 1, 1)).join(c, "i").select("sound_id", "category", F.when(F.col("prob") >= 0.8, 1).otherwise(2).alias("tier"))


@query("cache_antijoin", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 40)")
def cache_antijoin(spark, sf):
    cache = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.not_cached(table(spark, sf, "orders").select("o_orderkey"), cache, "o_orderkey")


@query("before_after_diff", """with a as (select c_custkey, c_name, case when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer where c_custkey % 11 <> 0), b as (select c_custkey, c_name, c_acctbal from customer where c_custkey % 13 <> 0)
select coalesce(a.c_custkey, b.c_custkey) as c_custkey, case when a.c_custkey is null then 'added' when b.c_custkey is null then 'removed' else 'changed' end as what from a full join b using (c_custkey)
where a.c_custkey is null or b.c_custkey is null or a.c_acctbal is distinct from b.c_acctbal""")
def before_after_diff(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    a = c.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return R.differences(a, c.where("c_custkey % 13 <> 0"), "c_custkey", ["c_name", "c_acctbal"])


@query("top3_alternatives", "select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as place from part qualify place <= 3")
def top3_alternatives(spark, sf):
    return R.top_per_group(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "place")


@query("ranked_candidates", "select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_returnflag, l_discount desc, l_tax, l_quantity desc, l_shipdate, l_linenumber) as place from lineitem qualify place <= 2")
def ranked_candidates(spark, sf):
    order = [F.col("l_returnflag"), F.desc("l_discount"), F.col("l_tax"), F.desc("l_quantity"), F.col("l_shipdate"), F.col("l_linenumber")]
    return R.top_per_group(table(spark, sf, "lineitem"), ["l_orderkey"], order, 2).select("l_orderkey", "l_linenumber", "place")


@query("completion_tiers", """with c as (select p_brand, p_partkey, case when p_size <= 5 and p_type = 'PROMO' then 0 when p_size <= 5 then 1 when p_type = 'PROMO' then 2 end as tier from part)
select p_brand, p_partkey, tier from c qualify tier = min(tier) over (partition by p_brand)""")
def completion_tiers(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size", "p_type")
    tiers = [p.where("p_size <= 5 and p_type = 'PROMO'"), p.where("p_size <= 5"), p.where("p_type = 'PROMO'")]
    return R.first_tier(tiers, "p_brand").select("p_brand", "p_partkey", "tier")


_RULES = "with r as (select appearance_id, source_id is not null as a, character_id is not null as b, coalesce(isfinite(start_sec) and isfinite(end_sec), false) as c, coalesce(end_sec > start_sec and not isnan(end_sec), false) as d, coalesce(confidence between 0 and 1, false) as e from (select distinct * exclude (ingested_at) from appearances))"


def _rules():
    c = F.col
    return {
        "source": c("source_id").isNotNull(), "character": c("character_id").isNotNull(), "finite": M.is_number(c("start_sec")) & M.is_number(c("end_sec")),
        "order": (c("end_sec") > c("start_sec")) & ~F.isnan("end_sec"), "confidence": c("confidence").between(0, 1),
    }


@query("contract_issues", _RULES + " select appearance_id, 'source' as issue from r where not a union all select appearance_id, 'character' from r where not b union all select appearance_id, 'finite' from r where not c union all select appearance_id, 'order' from r where not d union all select appearance_id, 'confidence' from r where not e")
def contract_issues(spark, sf):
    return R.issues(table(spark, sf, "appearances").drop("ingested_at").distinct(), "appearance_id", _rules())


@query("contract_accepted", _RULES + " select appearance_id from r where a and b and c and d and e")
def contract_accepted(spark, sf):
    rows = table(spark, sf, "appearances").drop("ingested_at").distinct()
    for rule in _rules().values():
        rows = rows.where(rule)
    return rows.select("appearance_id")


_EMB = "with e as (select vec_id, label, embedding::double[] as v from embeddings), p as (select a.vec_id as a, b.vec_id as b, a.label, list_cosine_similarity(a.v, b.v) as c from e a join e b on a.label = b.label and a.vec_id <> b.vec_id)"


def _alike(spark, sf, **how):
    """Pairs (a, b, c) within a label, by blocks of vectors."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return similar_blocks(e, group="label", key="vec_id", vector="embedding", **how)


@query("cosine_pairs", _EMB + " select a, b, round(c, 6) as c from p where a < b and c >= 0.3")
def cosine_pairs(spark, sf):
    return _alike(spark, sf, least=0.3).where("a < b").select("a", "b", F.round("c", 6).alias("c"))


@query("nearest_reference", _EMB + " select a, arg_max(b, (round(c, 9), -b)) as b from p group by a")
def nearest_reference(spark, sf):
    return _alike(spark, sf, k=1).select("a", "b")


@query("ambiguous_reference", _EMB + ", r as (select a, c, row_number() over (partition by a order by c desc, b) as k from p) select x.a from r x join r y on x.a = y.a and x.k = 1 and y.k = 2 where x.c - y.c < 0.03")
def ambiguous_reference(spark, sf):
    r = _alike(spark, sf, k=2)
    return r.groupBy("a").agg(F.max("c").alias("x"), F.min("c").alias("y"), F.count("*").alias("n")).where("n = 2 and x - y < 0.03").select("a")


@query("centroid_medoid", _EMB + " , s as (select label, a, avg(c) as m from p group by all) select label, arg_max(a, (round(m, 9), -a)) as medoid from s group by label")
def centroid_medoid(spark, sf):
    """The mean cosine with all others of the label is that with their sum: no pair is formed."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", M.unit(F.col("embedding")).alias("v"))
    sums = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("w"), F.max("n").alias("n"))
    s = e.join(sums, "label").select("label", F.round((M.dot(F.col("v"), F.col("w")) - 1) / (F.col("n") - 1), 9).alias("m"), (-F.col("vec_id")).alias("k"))
    return s.groupBy("label").agg((-F.max(F.struct("m", "k"))["k"]).alias("medoid"))


@query("hamming_similar", "with e as (select vec_id, label, list_sum(list_transform(range(1, 33), lambda i: case when embedding[i] > 0 then (1::bigint << (i - 1)) else 0 end))::bigint as h from embeddings) select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id < b.vec_id where bit_count(xor(a.h, b.h)) <= 8")
def hamming_similar(spark, sf):
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 32), lambda x, i: F.when(x > 0, F.shiftleft(F.lit(1).cast("bigint"), 0) * F.pow(F.lit(2.0), i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    e = table(spark, sf, "embeddings").select("vec_id", "label", bits.alias("h"))
    other = e.select(F.col("vec_id").alias("b"), "label", F.col("h").alias("h2"))
    return e.join(other, "label").where((F.col("vec_id") < F.col("b")) & (F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))) <= 8)).select(F.col("vec_id").alias("a"), "b")


@query("nested_flatten", """with recursive edge as (select 'r' || r_regionkey as p, 'n' || n_nationkey as c, n_nationkey as a from nation join region on n_regionkey = r_regionkey
 union all select 'n' || c_nationkey, 'c' || c_custkey, c_custkey from customer), w as (select p as root, c, a::bigint as pos, 1 as depth from edge where p like 'r%'
 union all select w.root, e.c, w.pos + e.a, w.depth + 1 from w join edge e on e.p = w.c) select root, c, pos, depth from w""")
def nested_flatten(spark, sf):
    for t in ("region", "nation", "customer"):
        table(spark, sf, t).createOrReplaceTempView(f"strandline_{t}")
    return spark.sql("""
      with recursive edge as (
        select concat('r', r_regionkey) as p, concat('n', n_nationkey) as c, cast(n_nationkey as bigint) as a from strandline_nation join strandline_region on n_regionkey = r_regionkey
        union all select concat('n', c_nationkey), concat('c', c_custkey), c_custkey from strandline_customer),
      w as (
        select p as root, c, a as pos, 1 as depth from edge where p like 'r%'
        union all select w.root, e.c, w.pos + e.a, w.depth + 1 from w join edge e on e.p = w.c)
      select root, c, pos, depth from w""")


@query("unique_roots", "select r_regionkey from region where r_regionkey not in (select n_regionkey from nation where n_nationkey % 5 <> r_regionkey)")
def unique_roots(spark, sf):
    edges = table(spark, sf, "nation").where(F.col("n_nationkey") % 5 != F.col("n_regionkey")).select(F.col("n_regionkey").alias("child"))
    return graph.unreferenced(table(spark, sf, "region").select(F.col("r_regionkey").alias("node")), edges).select(F.col("node").alias("r_regionkey"))


@query("positional_join", "with a as (select row_number() over (order by s_suppkey) as i, s_suppkey from supplier), b as (select row_number() over (order by n_nationkey) as i, n_name from nation) select i, s_suppkey, n_name from a left join b using (i)")
def positional_join(spark, sf):
    number = lambda df, k: running(df.withColumn("one", F.lit(1).cast("bigint")), [k], "one", "i").withColumn("i", F.col("i") + 1).drop("one")
    a = number(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey")
    b = number(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return a.join(b, "i", "left").select("i", "s_suppkey", "n_name")


@query("selection_report", "select n_name, count(s_suppkey) as suppliers, coalesce(round(sum(s_acctbal), 2), 0) as balance from nation left join supplier on n_nationkey = s_nationkey group by n_name")
def selection_report(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"), F.sum("s_acctbal").alias("b"))
    n = table(spark, sf, "nation").join(s, "n_nationkey", "left")
    return n.select("n_name", F.coalesce("k", F.lit(0)).alias("suppliers"), F.coalesce(F.round("b", 2), F.lit(0.0)).alias("balance"))


@query("tpch_revenue", "select l_returnflag, l_linestatus, sum(l_quantity) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def tpch_revenue(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("tpch_star_join", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey group by n_name")
def tpch_star_join(spark, sf):
    c, o, li, s, n = (table(spark, sf, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("rollup_report", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup_report(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("distinct_counts", "select l_returnflag, count(distinct l_orderkey) as orders, count(distinct l_partkey) as parts from lineitem group by 1")
def distinct_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("set_ops", "select o_custkey from orders where o_orderstatus = 'F' intersect select c_custkey from customer where c_acctbal > 0 except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def set_ops(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(c.where("c_acctbal > 0").select("c_custkey")).subtract(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("json_property", "select event_type, sum(cast(json_extract(props, '$.k') as bigint))::bigint as k from events group by 1")
def json_property(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))
