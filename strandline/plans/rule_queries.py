"""Queries of words, boxes, palettes, signals and other expressions, with their SQL."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.functions import words as W
from strandline.operators import series as S
from strandline.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


c = F.col
_FOLD = "trim(regexp_replace(replace(lower(nfc_normalize({x})), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query("composed_titles", f"select doc_id, {_FOLD.format(x='title')} as t from documents")
def composed_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", W.composed("title").alias("t"))


@query("plain_titles", "select doc_id, regexp_replace(replace(replace(strip_accents(lower(replace(title, '?', 'd'))), 'đ', ''), 'ß', 'ss'), '[^a-z0-9]+', '', 'g') as t from documents")
def plain_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", W.plain("title").alias("t"))


_MARKS = W.EDGE_MARKS.replace("[]", "\\[\\]").replace("'", "''")
_DRAWN = " ".join(f"when regexp_full_match(t, '{p}') then '{w}'" for w, p in W.DRAWN_OUT.items())
_NUMBERS = " ".join(f"when t = '{k}' then '{v}'" for k, v in {**W.NUMBER_WORDS, **W.RESPELT}.items())
_SPOKEN = f"""heard as (select distinct sound_id, source_id, word, start, end_sec, prob from source_sound where word is not null),
edged as (select *, regexp_replace(regexp_replace({_FOLD.format(x="word")}, '’', '''', 'g'), '^[{_MARKS}]+|[{_MARKS}]+$', '', 'g') as t from heard),
numbered as (select * replace (case {_NUMBERS} else t end as t) from edged), spoken as (select * replace (case {_DRAWN} else t end as t) from numbered)"""


@query("spoken_tokens", f"with {_SPOKEN} select sound_id, t as token from spoken")
def spoken_tokens(spark, sf):
    return _heard(spark, sf).select("sound_id", "token")


def _heard(spark, sf):
    s = table(spark, sf, "source_sound").where("word is not null").drop("ingested_at").dropDuplicates(["sound_id"])
    return s.withColumn("token", W.spoken_token(c("word")))


@query("word_readings", f"""with {_SPOKEN}, w as (select distinct t from spoken where t <> ''), l as (select t, list_transform(string_split(upper(t), ''), lambda x, i: x || (i % 3)) as p from w),
v as (select t, p as a, list_concat(['HH', 'W'], p) as b from l),
k as (select t, list_transform([a, b, list_concat(['W'], a)], lambda p: list_transform(p, lambda x: regexp_replace(x, '[0-9]', '', 'g'))) as r from v)
select t as token, array_to_string(list_sort(list_distinct(list_transform(r, lambda p: array_to_string(case when p[1] = 'HH' and p[2] = 'W' then p[2:] else p end, ' ')))), '|') as readings from k""")
def word_readings(spark, sf):
    """Spelt out, with stress marks, and with and without aspiration: two of three readings are the same key."""
    w = _heard(spark, sf).select("token").where("token <> ''").distinct()
    p = F.transform(F.split(F.upper("token"), ""), lambda x, i: F.concat(x, ((i + 1) % 3).cast("string")))
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    return w.select("token", F.array_join(W.readings(F.array(p, F.concat(lit("HH", "W"), p), F.concat(lit("W"), p))), "|").alias("readings"))


ALIASES = {"haha": "laugh_low", "gasp": "gasp_short"}
_STEMS = {"laugh_low": ("emotion", "LAUGH"), "laugh_burst": ("emotion", "LAUGH"), "gasp_short": ("nonvocal", "NONVOCAL"), "sob_soft": ("emotion", "CRY"), "hum_low": ("vowel", "SPEECH")}
_STEM_VALUES = ", ".join(f"('{k}', '{g}', '{a}')" for k, (g, a) in _STEMS.items())


@query("taxonomy_lookup", f"""with n(name, grp, action) as (values {_STEM_VALUES}), s as (select distinct sound_id, action_stem, kind from source_sound),
k as (select *, case action_stem when 'haha' then 'laugh_low' when 'gasp' then 'gasp_short' else action_stem end as name from s)
select sound_id, coalesce(n.grp, kind) as grp, coalesce(action, 'UNCLEAR') as action, case coalesce(action, 'UNCLEAR') when 'SPEECH' then 'speech' when 'NONVOCAL' then 'effect' when 'UNCLEAR' then 'unknown' else 'vocal-event' end as sound_type,
case when action is null then 0.0 else 1.0 end as confidence from k left join n using (name)""")
def taxonomy_lookup(spark, sf):
    """STR11-STR15, STR19, STR20: the list wins over the row, what it doesn't know stays unclear."""
    names = spark.createDataFrame([(k, *v) for k, v in _STEMS.items()], "name string, grp string, action string")
    s = table(spark, sf, "source_sound").select("sound_id", "action_stem", "kind").distinct()
    found = W.looked_up(s, names, by="action_stem", aliases=ALIASES, dims=["grp", "action"])
    action = F.coalesce("action", F.lit("UNCLEAR"))
    kind = F.when(action == "SPEECH", "speech").when(action == "NONVOCAL", "effect").when(action == "UNCLEAR", "unknown").otherwise("vocal-event")
    return found.select("sound_id", F.coalesce("grp", "kind").alias("grp"), action.alias("action"), kind.alias("sound_type"), F.when(c("action").isNull(), 0.0).otherwise(1.0).alias("confidence"))


_LABELS = ["person", "red car", "skeleton", "person monster", "bus person", "truck", "poster"]
_LABEL = "list_value(" + ", ".join(f"'{x}'" for x in _LABELS) + ")[(p_partkey % 7 + 1)::int]"


def _label():
    return F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (c("p_partkey") % 7 + 1).cast("int"))


@query("label_families", f"select p_partkey, case when p_partkey % 7 in (1, 5) then 'vehicle' when p_partkey % 7 in (0, 4) then 'person' when p_partkey % 7 = 2 then 'creature' end as family from part")
def label_families(spark, sf):
    return table(spark, sf, "part").select("p_partkey", W.family(_label()).alias("family"))


@query("descriptors", "select p_partkey, case when p_partkey % 5 = 0 then 'cat' when p_partkey % 5 = 1 then 'gray-' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') else regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') end as d from part")
def descriptors(spark, sf):
    raw = F.when(c("p_partkey") % 5 == 0, " Kitten! ").when(c("p_partkey") % 5 == 1, F.concat(F.lit("Pale Grey "), "p_name")).otherwise(F.concat(F.lit("dark-"), "p_name"))
    return table(spark, sf, "part").select("p_partkey", W.descriptor(raw).alias("d"))


@query("plain_guids", "select doc_id, md5(doc_id::varchar) as g from documents")
def plain_guids(spark, sf):
    h = F.upper(F.md5(c("doc_id").cast("string")))
    raw = F.concat(F.lit("{"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 24), F.lit("}"))
    return table(spark, sf, "documents").select("doc_id", W.plain_guid(raw).alias("g"))


@query("packed_names", "select doc_id, title as t from documents where title is not null")
def packed_names(spark, sf):
    """Hex text of a compressed component, opened again (SRC23, SRC25, SRC26): what can't be opened is null."""

    @F.pandas_udf("string")
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda s: zlib.compress(s.encode()).hex())

    @F.pandas_udf("string")
    def unpack(x: pd.Series) -> pd.Series:
        def one(s):
            try:
                return zlib.decompress(bytes.fromhex(s)).decode()
            except (ValueError, zlib.error):
                return None

        return x.map(one)

    return table(spark, sf, "documents").where("title is not null").select("doc_id", unpack(pack("title")).alias("t"))


_TRACK = "with t as (select distinct on (id) * from track where id is not null)"


def _tracks(spark, sf):
    return table(spark, sf, "track").where("id is not null").dropDuplicates(["id"])


@query("shifted_intervals", _TRACK + " select id, 'r:' || id as uid, array_to_string(list_transform(intervals, lambda x: array_to_string(list_transform(x, lambda v: round((v + 5) * 1000)::bigint), '-')), ',') as spans from t")
def shifted_intervals(spark, sf):
    """All times of a nested field moved, all ids with a prefix (MTH3)."""
    ms = lambda v: F.round((v + 5) * 1000).cast("bigint").cast("string")
    spans = F.transform("intervals", lambda x: F.array_join(F.transform(x, ms), "-"))
    return _tracks(spark, sf).select("id", F.concat(F.lit("r:"), c("id").cast("string")).alias("uid"), F.array_join(spans, ",").alias("spans"))


@query("match_units", _TRACK + """, u as (select id, unnest(case when intervals is null or len(intervals) = 0 then [null] else intervals end) as x, generate_subscripts(case when intervals is null or len(intervals) = 0 then [null] else intervals end, 1) as k from t)
select id, case when x is null then id::varchar else format('{}/seg-{:03d}', id, k - 1) end as unit, round(x[2] - x[1], 4) as length from u""")
def match_units(spark, sf):
    """One unit per interval, numbered; a record without intervals stays one unit (ARR1, ARR2)."""
    u = _tracks(spark, sf).select("id", F.posexplode_outer("intervals").alias("k", "x"))
    name = F.when(c("x").isNull(), c("id").cast("string")).otherwise(F.format_string("%d/seg-%03d", "id", "k"))
    return u.select("id", name.alias("unit"), F.round(F.get("x", F.lit(1)) - F.get("x", F.lit(0)), 4).alias("length"))


@query("merged_settings", "select p_partkey, p_size as a, case when p_partkey % 3 = 0 then -1 else p_size + 1 end as b, case when p_partkey % 3 = 0 then 7 end as c from part")
def merged_settings(spark, sf):
    """A nested overlay wins key by key (ARR3)."""
    base = F.create_map(F.lit("a"), c("p_size").cast("int"), F.lit("b"), (c("p_size") + 1).cast("int"))
    over = F.when(c("p_partkey") % 3 == 0, F.create_map(F.lit("b"), F.lit(-1), F.lit("c"), F.lit(7))).otherwise(F.expr("map()").cast("map<string,int>"))
    m = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
    return table(spark, sf, "part").select("p_partkey", m.alias("m")).select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


@query("reset_fields", "select sample_id, case when face_visible < 0.5 then null else round(closeup_score, 4) end as closeup, round(speaking, 4) as speaking, case when face_visible < 0.5 then 'none' else 'kept' end as state from (select distinct sample_id, face_visible, closeup_score, speaking from samples)")
def reset_fields(spark, sf):
    """Fields of a nested record are cleared and overwritten where it isn't measured (ARR7)."""
    s = table(spark, sf, "samples").select("sample_id", "face_visible", "closeup_score", "speaking").distinct()
    s = s.select("sample_id", "face_visible", F.struct(F.round("closeup_score", 4).alias("closeup"), F.round("speaking", 4).alias("speaking"), F.lit("old").alias("state")).alias("r"))
    lost = c("face_visible") < 0.5
    r = c("r").withField("closeup", F.when(~F.coalesce(lost, F.lit(False)), c("r.closeup"))).withField("state", F.when(lost, "none").otherwise("kept"))
    return s.select("sample_id", r.alias("r")).select("sample_id", "r.*")


_BOX = f"""with b as (select p_partkey as k, p_partkey // 50 as frame, {_LABEL} as label, ((p_partkey * 7) % 90)::double as x, ((p_partkey * 13) % 80)::double as y, (20 + p_size)::double as w, (15 + p_size % 20)::double as h, (p_partkey * 31 % 100) / 100.0 as score from part)"""
_AREA = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def _boxes(spark, sf):
    """A frame has fifty boxes at most, however large the table is."""
    k = c("p_partkey")
    box = F.array(((k * 7) % 90).cast("double"), ((k * 13) % 80).cast("double"), (20 + c("p_size")).cast("double"), (15 + c("p_size") % 20).cast("double"))
    return table(spark, sf, "part").select(k.alias("k"), F.floor(k / 50).cast("bigint").alias("frame"), _label().alias("label"), box.alias("box"), ((k * 31 % 100) / 100).alias("score"))


def _with_others(boxes):
    other = boxes.select("frame", c("k").alias("k2"), c("label").alias("label2"), c("box").alias("box2"), c("score").alias("score2"))
    return boxes.join(other, "frame").where("k <> k2")


@query("held_boxes", _BOX + f" select a.k, b.k as owner from b a join b on a.frame = b.frame and a.k <> b.k where {_AREA} / (a.w * a.h) >= 0.8")
def held_boxes(spark, sf):
    return _with_others(_boxes(spark, sf)).where(G.held_within(c("box"), c("box2"))).select("k", c("k2").alias("owner"))


@query("unique_owner", _BOX + f""", o as (select a.k, b.k as owner, b.w * b.h as size from b a join b on a.frame = b.frame and a.k <> b.k where {_AREA} / (a.w * a.h) >= 0.8 and b.w * b.h >= 1.5 * a.w * a.h)
select k, arg_min(owner, (size, owner)) as owner, count(*) as owners from o group by k""")
def unique_owner(spark, sf):
    """Held by a box half as large again: the smallest claims first (JN19, JN21)."""
    size = lambda b: b[2] * b[3]
    o = _with_others(_boxes(spark, sf)).where(G.held_within(c("box"), c("box2")) & (size(c("box2")) >= 1.5 * size(c("box"))))
    return o.groupBy("k").agg(F.min(F.struct(size(c("box2")).alias("s"), "k2"))["k2"].alias("owner"), F.count("*").alias("owners"))


@query("prominent_box", _BOX + ", s as (select *, greatest(0, w * h) * (1 - 0.4 * least(1, sqrt(((x + w / 2) / 160 - 0.5) ** 2 + ((y + h / 2) / 120 - 0.5) ** 2) / 0.7072)) * (1 + 4 * score) as p from b) select frame, arg_max(k, (round(p, 6), -k)) as k from s group by frame")
def prominent_box(spark, sf):
    p = F.round(G.prominence(c("box"), 160.0, 120.0, c("score")), 6)
    return _boxes(spark, sf).groupBy("frame").agg((-F.max(F.struct(p.alias("p"), (-c("k")).alias("k")))["k"]).alias("k"))


@query("clipped_boxes", _BOX + " select k, greatest(0, x - 10)::int as x, greatest(0, y - 10)::int as y, (least(100, x - 10 + w) - greatest(0, x - 10))::int as w, (least(90, y - 10 + h) - greatest(0, y - 10))::int as h from b where least(100, x - 10 + w) > greatest(0, x - 10) and least(90, y - 10 + h) > greatest(0, y - 10)")
def clipped_boxes(spark, sf):
    moved = F.array(c("box")[0] - 10, c("box")[1] - 10, c("box")[2], c("box")[3])
    b = _boxes(spark, sf).select("k", G.clipped_box(moved, 100.0, 90.0).alias("b")).where("b is not null")
    return b.select("k", *[c("b")[i].alias(n) for i, n in enumerate("xywh")])


_TILE_SQL = ", ".join(f"[{x}, {y}, {w}, {h}]" for x, y, w, h in G.TILES)


@query("screening_tiles", f"with s as (select distinct source_id, (16 * fps)::double as w, (9 * fps)::double as h from sources), t as (select *, unnest([{_TILE_SQL}]) as f, generate_subscripts([{_TILE_SQL}], 1) as k from s) select source_id, k - 1 as tile, round(f[1] * w, 3) as x, round(f[2] * h, 3) as y, round(f[3] * w, 3) as w, round(f[4] * h, 3) as h from t")
def screening_tiles(spark, sf):
    s = table(spark, sf, "sources").select("source_id", (16 * c("fps")).alias("w"), (9 * c("fps")).alias("h")).distinct()
    t = s.select("source_id", F.posexplode(G.tiles(c("w"), c("h"))).alias("tile", "b"))
    return t.select("source_id", "tile", *[F.round(c("b")[i], 3).alias(n) for i, n in enumerate("xywh")])


_EMB = "with e as (select vec_id, label, embedding::double[] as v from embeddings)"


@query("landmark_ratios", _EMB + """, m as (select vec_id, greatest(sqrt((v[1] - v[3]) ** 2 + (v[2] - v[4]) ** 2), 1e-6) as width, sqrt((v[5] - v[7]) ** 2 + (v[6] - v[8]) ** 2) as gape, greatest(sqrt((v[9] - v[11]) ** 2 + (v[10] - v[12]) ** 2), 1e-6) as eyes, abs(v[13] - (v[1] + v[3]) / 2) as off from e)
select vec_id, round(gape / width, 4) as aperture, round(width / eyes, 4) as width_ratio, round(greatest(0, 1 - off / width * 2), 4) as frontal, round(greatest(0, 1 - abs(gape / width - 0.6)), 4) as roundness from m""")
def landmark_ratios(spark, sf):
    p = lambda i: F.array(c("embedding")[2 * i].cast("double"), c("embedding")[2 * i + 1].cast("double"))
    m = table(spark, sf, "embeddings").select("vec_id", G.mouth_ratios(*[p(i) for i in range(7)]).alias("m")).select("vec_id", "m.*")
    return m.select("vec_id", *[F.round(x, 4).alias(x) for x in ("aperture", "width_ratio", "frontal", "roundness")])


@query("pose_confirmed", _EMB + " select vec_id, v[1] > 0 and v[3] > 0 and len(list_filter(v[1:12], lambda x: x > 0)) >= 6 as ok from e")
def pose_confirmed(spark, sf):
    seen = F.filter(F.transform(F.slice("embedding", 1, 12), lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return table(spark, sf, "embeddings").select("vec_id", G.pose_confirmed(seen, [0, 2], 6).alias("ok"))


@query("visual_quality", """with s as (select distinct sample_id, clear_face as a, closeup_score as b, mouth_clarity as m from samples), z as (select sample_id, case when a is null or isnan(a) then 0 else greatest(0, least(1, a)) end as a, case when b is null or isnan(b) then 0 else greatest(0, least(1, b * 4)) end as b, case when m is null or isnan(m) then 0 else greatest(0, least(1, m)) end as m from s)
select sample_id, round(0.5 * a + 0.3 * b + 0.2 * (1 - m), 4) as q from z""")
def visual_quality(spark, sf):
    s = table(spark, sf, "samples").select("sample_id", "clear_face", "closeup_score", "mouth_clarity").dropDuplicates(["sample_id"])
    return s.select("sample_id", F.round(G.quality(c("clear_face"), c("closeup_score"), c("mouth_clarity")), 4).alias("q"))


@query("resampled_vectors", _EMB + ", r as (select vec_id, v, i, i * 63 / 15.0 as x from e, range(16) t(i)) select vec_id, i::int as i, round(v[floor(x)::int + 1] + (v[least(floor(x)::int + 1, 63) + 1] - v[floor(x)::int + 1]) * (x - floor(x)), 4) as y from r")
def resampled_vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(G.resampled(c("embedding"), 16)).alias("i", "y")).select("vec_id", "i", F.round("y", 4).alias("y"))


@query("audible_bounds", _EMB + """, p as (select vec_id, v, list_max(list_transform(v, lambda x: abs(x))) as peak from e), l as (select *, list_filter(range(64), lambda i: abs(v[i + 1]) > greatest(0.0001, peak * 0.001)) as loud from p)
select vec_id, list_min(loud)::int as first, list_max(loud)::int as last, round(peak, 4) as peak, round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64), 4) as rms from l""")
def audible_bounds(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", G.audible(c("embedding")).alias("a")).select("vec_id", "a.*")
    return a.select("vec_id", "first", "last", F.round("peak", 4).alias("peak"), F.round("rms", 4).alias("rms"))


_HUE = _EMB + ", m as (select vec_id, label, list_transform(v[1:16], lambda x: abs(x)) as a from e), h as (select vec_id, label, list_transform(a, lambda x: x / list_sum(a)) as h from m)"
_BANDS = ", ".join(f"case when {' + '.join(f'h[{i + 1}]' for i in at)} >= 0.12 then '{n}' end" for n, at in sorted(G.BANDS.items()))


@query("colour_bands", _HUE + f" select vec_id, array_to_string(list_filter([{_BANDS}], lambda x: x is not null), ',') as bands from h")
def colour_bands(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(G.bands(G.histogram(c("embedding"))), ",").alias("bands"))


@query("palette_fits", _HUE + """, ref as (select label, arg_min(h, vec_id) as w from h group by label),
a as (select label, w, list_reverse_sort(list_transform(range(16), lambda i: [w[i + 1], -i])) as r from ref), s as (select label, w, list_filter(r, lambda x: x[1] >= 0.12) as s from a),
f as (select label, w, -s[1][2]::int as i, s from s), g as (select label, w, i, -list_filter(s, lambda x: least(abs(-x[2] - i), 16 - abs(-x[2] - i)) >= 3)[1][2]::int as j from f),
t as (select h.vec_id, h.h, g.w, unnest([i, j]) as n from h join g using (label)),
ok as (select vec_id, n is null or (h[(n + 15) % 16 + 1] + h[n + 1] + h[(n + 1) % 16 + 1] >= greatest(0.03, 0.15 * (w[(n + 15) % 16 + 1] + w[n + 1] + w[(n + 1) % 16 + 1])) and h[n + 1] >= greatest(0.02, 0.15 * w[n + 1])) as y from t)
select vec_id, bool_and(y) as fits from ok group by vec_id""")
def palette_fits(spark, sf):
    """Each vector's palette against the first of its label (MTH32, CL11)."""
    h = table(spark, sf, "embeddings").select("vec_id", "label", G.histogram(c("embedding")).alias("h"))
    ref = h.groupBy("label").agg(F.min_by("h", "vec_id").alias("w"))
    return h.join(ref, "label").select("vec_id", G.palette_fits(c("h"), c("w")).alias("fits"))


@query("best_palette", _HUE + ", ref as (select vec_id as r, h as w from h where vec_id < 5) select vec_id, round(max(list_sum(list_transform(range(1, 17), lambda i: least(h[i], w[i])))), 4) as score from h, ref group by vec_id")
def best_palette(spark, sf):
    """Best histogram intersection with a handful of references (CL10): these are five vectors, held in one array."""
    h = table(spark, sf, "embeddings").select("vec_id", G.histogram(c("embedding")).alias("h"))
    refs = h.where("vec_id < 5").agg(F.collect_list("h").alias("refs"))
    return h.join(F.broadcast(refs)).select("vec_id", F.round(F.array_max(F.transform("refs", lambda w: G.histogram_shared(c("h"), w))), 4).alias("score"))


_SCORED = """with s as (select distinct sample_id, source_id, shot_id, coalesce(confidence, 0) as rms, coalesce(face_visible, 0) * 0.3 as zcr, coalesce(clear_face, 0) * 2500 as cent, coalesce(closeup_score, 0) as sub, coalesce(speaking, 0) as low, case when mouth_clarity is null or isnan(mouth_clarity) then 0 else mouth_clarity end as mid from samples),
f as (select *, least(1, cent / 2500) as bright, 0.2 as high from s),
g as (select *, [sub * 1.8 + (1 - bright) * 0.45 - high * 1.4 - mid * 0.15, low * 1.45 + sub * 0.45 + (1 - abs(bright - 0.38)) * 0.25 - high * 1.1, mid * 1.35 + (1 - abs(bright - 0.55)) * 0.35 - sub * 0.2, high * 1.7 + bright * 0.9 - sub * 0.5] as v from f)"""


def _scores():
    """Linear scores of four classes from measured features (MTH14)."""
    num = lambda n: F.nanvl(F.coalesce(c(n), F.lit(0.0)), F.lit(0.0))
    bright, high = F.least(F.lit(1.0), num("clear_face")), 0.2
    sub, low, mid = num("closeup_score"), num("speaking"), num("mouth_clarity")
    return {
        "U": sub * 1.8 + (1 - bright) * 0.45 - high * 1.4 - mid * 0.15,
        "O": low * 1.45 + sub * 0.45 + (1 - F.abs(bright - 0.38)) * 0.25 - high * 1.1,
        "A": mid * 1.35 + (1 - F.abs(bright - 0.55)) * 0.35 - sub * 0.2,
        "E": high * 1.7 + bright * 0.9 - sub * 0.5,
    }


def _picked(scores):
    """The best class, 0.5 and its lead as confidence within 0.4..0.95; below 0.22 it is neutral (MTH15)."""
    ranked = F.array_sort(F.array(*[F.struct((-F.round(s, 6)).alias("s"), F.lit(n).alias("label")) for n, s in scores.items()]))
    best, lead = -ranked[0]["s"], ranked[1]["s"] - ranked[0]["s"]
    sure = F.greatest(F.lit(0.4), F.least(F.lit(0.95), 0.5 + lead))
    return F.struct(F.when(best < 0.22, "NEUTRAL").otherwise(ranked[0]["label"]).alias("label"), F.round(F.when(best < 0.22, 0.4).otherwise(sure), 6).alias("confidence"))


@query("class_scores", _SCORED + """, r as (select sample_id, list_sort(list_transform([1, 2, 3, 4], lambda i: {'s': -round(v[i], 6), 'l': ['U', 'O', 'A', 'E'][i]})) as r from g)
select sample_id, case when -r[1].s < 0.22 then 'NEUTRAL' else r[1].l end as label, round(case when -r[1].s < 0.22 then 0.4 else greatest(0.4, least(0.95, 0.5 + r[2].s - r[1].s)) end, 6) as confidence from r""")
def class_scores(spark, sf):
    s = table(spark, sf, "samples").dropDuplicates(["sample_id"])
    return s.select("sample_id", _picked(_scores()).alias("p")).select("sample_id", "p.*")


@query("span_labels", _SCORED + """, a as (select source_id, shot_id, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] as v, count(*) as n from g where source_id is not null and shot_id is not null group by all),
r as (select source_id, shot_id, n, list_sort(list_transform([1, 2, 3, 4], lambda i: {'s': -round(v[i], 6), 'l': ['U', 'O', 'A', 'E'][i]})) as r from a)
select source_id, shot_id, n, case when -r[1].s < 0.22 then 'NEUTRAL' else r[1].l end as label from r""")
def span_labels(spark, sf):
    """A span's label from the means over its rows (AG11)."""
    s = table(spark, sf, "samples").dropDuplicates(["sample_id"]).where("source_id is not null and shot_id is not null")
    means = s.select("source_id", "shot_id", *[v.alias(k) for k, v in _scores().items()]).groupBy("source_id", "shot_id").agg(F.count("*").alias("n"), *[F.avg(k).alias(k) for k in "UOAE"])
    return means.select("source_id", "shot_id", "n", _picked({k: c(k) for k in "UOAE"})["label"].alias("label"))


@query("acoustic_class", _SCORED + """ select sample_id, case when cent >= 2000 and zcr >= 0.15 and sub < 0.18 then 'WHISTLE' when cent >= 1800 and sub >= 0.2 and zcr >= 0.15 then 'COUGH' when sub <= 0.05 and cent < 1400 then 'BELL' when sub <= 0.15 and mid >= 0.85 and cent between 700 and 1800 then 'BEEP' when sub >= 0.75 and zcr <= 0.06 then 'SIGH' end as label from g""")
def acoustic_class(spark, sf):
    """A cascade of thresholds, none of which may hold (MTH16)."""
    num = lambda n: F.nanvl(F.coalesce(c(n), F.lit(0.0)), F.lit(0.0))
    cent, zcr, sub, mid = num("clear_face") * 2500, num("face_visible") * 0.3, num("closeup_score"), num("mouth_clarity")
    rules = [
        ((cent >= 2000) & (zcr >= 0.15) & (sub < 0.18), "WHISTLE"), ((cent >= 1800) & (sub >= 0.2) & (zcr >= 0.15), "COUGH"), ((sub <= 0.05) & (cent < 1400), "BELL"),
        ((sub <= 0.15) & (mid >= 0.85) & cent.between(700, 1800), "BEEP"), ((sub >= 0.75) & (zcr <= 0.06), "SIGH"),
    ]
    return table(spark, sf, "samples").dropDuplicates(["sample_id"]).select("sample_id", F.coalesce(*[F.when(r, F.lit(n)) for r, n in rules]).alias("label"))


@query("accepted_words", f"with {_SPOKEN} select sound_id, prob >= 0.6 or (prob >= 0.4 and t in ('hello', 'wait')) as accepted from spoken where t <> ''")
def accepted_words(spark, sf):
    """A likely word, or a less likely one that the name supports (MTH17)."""
    named = c("token").isin("hello", "wait")
    return _heard(spark, sf).where("token <> ''").select("sound_id", ((c("prob") >= 0.6) | ((c("prob") >= 0.4) & named)).alias("accepted"))


_APP = "with a as (select distinct appearance_id, source_id, character_id, start_sec, end_sec, evidence, confidence from appearances)"


@query("used_bounds", _APP + """ select appearance_id, case when evidence = 'voice' then least(end_sec, start_sec + 1) else end_sec end as used_end, case when evidence = 'voice' then least(1.0, end_sec - start_sec) else coalesce(confidence, end_sec - start_sec) end as need,
coalesce(start_sec, end_sec, 0) as low from a where isfinite(start_sec) and isfinite(end_sec)""")
def used_bounds(spark, sf):
    """Ends of rows that count by their beginning only, the evidence a demand needs, and bounds by a chain of fallbacks (MTH26-MTH28)."""
    a = table(spark, sf, "appearances").drop("ingested_at").distinct()
    finite = lambda n: c(n).isNotNull() & ~F.isnan(n) & (F.abs(c(n)) < float("inf"))
    a, prefix, length = a.where(finite("start_sec") & finite("end_sec")), F.coalesce(c("evidence") == "voice", F.lit(False)), c("end_sec") - c("start_sec")
    return a.select(
        "appearance_id", F.when(prefix, F.least("end_sec", c("start_sec") + 1)).otherwise(c("end_sec")).alias("used_end"),
        F.when(prefix, F.least(F.lit(1.0), length)).otherwise(F.coalesce("confidence", length)).alias("need"), F.coalesce("start_sec", "end_sec", F.lit(0.0)).alias("low"),
    )


_PAIRED = {"voice": ["face"], "body": ["face", "object"]}


@query("pair_scores", _APP + """, p as (select a.appearance_id as k, b.appearance_id as o, a.end_sec - a.start_sec as have, b.end_sec - b.start_sec as need, coalesce(a.confidence, 0) * 0.4 + coalesce(b.confidence, 0) * 0.1 as conf,
 case when a.evidence = b.evidence or (a.evidence, b.evidence) in (('voice', 'face'), ('face', 'voice'), ('body', 'face'), ('face', 'body'), ('body', 'object'), ('object', 'body')) then 1.0 else 0.15 end as fam
 from a join a b on a.character_id = b.character_id and a.source_id = b.source_id and a.appearance_id = b.appearance_id - 1 where isfinite(a.start_sec) and isfinite(a.end_sec) and isfinite(b.start_sec) and isfinite(b.end_sec))
select k, o, round(case when have <= 0 then 0 else 2 * fam + case when have < need * 0.6 then have / greatest(need, 0.000001) * 0.5 else greatest(0.2, 1 - abs(have - need) / greatest(need * 3, 1)) end + conf end, 4) as score from p""")
def pair_scores(spark, sf):
    """Family, fit of length and confidence of a pair (MTH18, MTH19)."""
    finite = lambda n: c(n).isNotNull() & ~F.isnan(n) & (F.abs(c(n)) < float("inf"))
    a = table(spark, sf, "appearances").drop("ingested_at").distinct().where(finite("start_sec") & finite("end_sec"))
    a = a.select("character_id", "source_id", c("appearance_id").alias("k"), c("evidence").alias("ev"), (c("end_sec") - c("start_sec")).alias("len"), F.coalesce("confidence", F.lit(0.0)).alias("conf"))
    b = a.select("character_id", "source_id", c("k").alias("o"), c("ev").alias("ev2"), c("len").alias("need"), c("conf").alias("conf2"))
    p = a.withColumn("o", c("k") + 1).join(b, ["character_id", "source_id", "o"])
    pairs = [(x, y) for x, ys in _PAIRED.items() for y in ys]
    same = F.coalesce(c("ev") == c("ev2"), F.lit(False))
    for x, y in pairs:
        same = same | F.coalesce(((c("ev") == x) & (c("ev2") == y)) | ((c("ev") == y) & (c("ev2") == x)), F.lit(False))
    fit = F.when(c("len") < c("need") * 0.6, c("len") / F.greatest("need", F.lit(1e-6)) * 0.5).otherwise(F.greatest(F.lit(0.2), 1 - F.abs(c("len") - c("need")) / F.greatest(c("need") * 3, F.lit(1.0))))
    score = F.when(c("len") <= 0, 0.0).otherwise(2 * F.when(same, 1.0).otherwise(0.15) + fit + c("conf") * 0.4 + c("conf2") * 0.1)
    return p.select("k", "o", F.round(score, 4).alias("score"))


@query("prop_veto", _BOX + f""", p as (select a.k, {_AREA} as n, a.w * a.h as s, b.w * b.h as t, a.x + a.w / 2 between b.x and b.x + b.w and a.y + a.h / 2 between b.y and b.y + b.h as mid, a.score > b.score and a.score >= 0.4 as stronger from b a join b on a.frame = b.frame and a.label = 'person' and b.label = 'poster')
select k, bool_or(not stronger and (n / greatest(1, s + t - n) >= 0.5 or n / s >= 0.8 or (mid and n / s >= 0.35))) as vetoed from p group by k""")
def prop_veto(spark, sf):
    """A box that lies on a prop is vetoed unless it is the stronger measurement (FIL11)."""
    p = _with_others(_boxes(spark, sf)).where("label = 'person' and label2 = 'poster'")
    a, b = c("box"), c("box2")
    on = (G.overlap_ratio(a, b) >= 0.5) | G.held_within(a, b) | (G.centre_within(a, b) & (G.shared_area(a, b) / (a[2] * a[3]) >= 0.35))
    return p.groupBy("k").agg(F.bool_or(~((c("score") > c("score2")) & (c("score") >= 0.4)) & on).alias("vetoed"))


@query("overlay_frames", _BOX + f""", o as (select distinct a.frame from b a join b on a.frame = b.frame where a.label = 'poster' and b.label = 'bus person' and a.score >= 0.3 and b.score >= 0.3 and a.w / 90 between 0.18 and 0.65 and {_AREA} / (a.w * a.h) >= 0.8)
select frame, count(*) as boxes, frame in (select frame from o) as overlay from b group by frame""")
def overlay_frames(spark, sf):
    """Whether a frame has a wide label that a panel box holds (FIL12): an existential pair within the frame's own array."""
    f = _boxes(spark, sf).groupBy("frame").agg(F.count("*").alias("boxes"), F.collect_list(F.struct("label", "box", "score")).alias("b"))
    wide = lambda p: (p["label"] == "poster") & (p["score"] >= 0.3) & (p["box"][2] / 90).between(0.18, 0.65)
    held = lambda p, q: (q["label"] == "bus person") & (q["score"] >= 0.3) & G.held_within(p["box"], q["box"])
    return f.select("frame", "boxes", F.exists("b", lambda p: wide(p) & F.exists("b", lambda q: held(p, q))).alias("overlay"))


_SMP = "with s as (select distinct sample_id, source_id, shot_id, time_sec, closeup_score, face_visible, speaking, category from samples where source_id is not null and isfinite(time_sec))"


def _samples(spark, sf):
    s = table(spark, sf, "samples").where("source_id is not null and time_sec is not null and not isnan(time_sec) and abs(time_sec) < double('infinity')")
    return s.dropDuplicates(["sample_id"])


@query("static_overlays", _SMP + """, g as (select source_id, floor(closeup_score * 40)::bigint as cell from s where closeup_score is not null group by all having count(*) >= 6 and max(time_sec) - min(time_sec) >= 3 and count(distinct shot_id) >= 2 and avg(case when face_visible >= 0.5 then 1.0 else 0.0 end) >= 0.55)
select source_id, count(*) as n from s where closeup_score is not null and (source_id, floor(closeup_score * 40)::bigint) not in (select source_id, cell from g) group by source_id""")
def static_overlays(spark, sf):
    """Rows of places that stay the same over times and shots are taken out (FIL13)."""
    s = _samples(spark, sf).where("closeup_score is not null").withColumn("cell", F.floor(c("closeup_score") * 40).cast("bigint"))
    share = F.avg(F.when(c("face_visible") >= 0.5, 1.0).otherwise(0.0))
    g = s.groupBy("source_id", "cell").agg(F.count("*").alias("n"), (F.max("time_sec") - F.min("time_sec")).alias("span"), F.count_distinct("shot_id").alias("shots"), share.alias("stable"))
    fixed = g.where("n >= 6 and span >= 3 and shots >= 2 and stable >= 0.55").select("source_id", "cell")
    return s.join(fixed, ["source_id", "cell"], "left_anti").groupBy("source_id").agg(F.count("*").alias("n"))


@query("same_subject", _BOX + f", p as (select a.k, {_AREA} as n, a.w * a.h as s, b.w * b.h as t, a.label = b.label as known from b a join b on a.frame = b.frame and b.k = a.k + 1) select k, n / greatest(1, s + t - n) >= case when known then 0.25 else 0.45 end as same from p")
def same_subject(spark, sf):
    """Whether a box goes on in the next one (FIL17): less overlap is enough where the track agrees."""
    b = _boxes(spark, sf)
    nxt = b.select((c("k") - 1).alias("k"), "frame", c("box").alias("box2"), c("label").alias("label2"))
    return b.join(nxt, ["frame", "k"]).select("k", (G.overlap_ratio(c("box"), c("box2")) >= F.when(c("label") == c("label2"), 0.25).otherwise(0.45)).alias("same"))


@query("screened_projects", "select project_uid, bool_and(sample_fps is not null and sample_fps > 0 and sample_fps <= 24) as eligible, count(*) as sources from sources group by project_uid")
def screened_projects(spark, sf):
    """A project qualifies if all its sources do (FIL16, FIL20)."""
    ok = F.coalesce((c("sample_fps") > 0) & (c("sample_fps") <= 24), F.lit(False))
    return table(spark, sf, "sources").groupBy("project_uid").agg(F.bool_and(ok).alias("eligible"), F.count("*").alias("sources"))


@query("pattern_orders", "with p as (select l_orderkey, l_linenumber, l_shipmode, row_number() over (partition by l_orderkey, l_shipmode order by l_linenumber) = 1 as first from (select *, case when l_linenumber % 2 = 1 then 'A' else l_returnflag end as l_shipmode from lineitem)) select l_orderkey, bool_and(first = (l_shipmode <> 'A' or l_linenumber = 1)) as maps, count(*) as n from p group by l_orderkey")
def pattern_orders(spark, sf):
    """Whether in each order the first of a kind is a primary row and each repeat a companion (JN4)."""
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(c("l_linenumber") % 2 == 1, "A").otherwise(c("l_returnflag")).alias("m"))
    first = F.row_number().over(Window.partitionBy("l_orderkey", "m").orderBy("l_linenumber")) == 1
    return li.withColumn("first", first).groupBy("l_orderkey").agg(F.bool_and(c("first") == ((c("m") != "A") | (c("l_linenumber") == 1))).alias("maps"), F.count("*").alias("n"))


@query("misaligned_rows", "with s as (select distinct l_orderkey, l_linenumber from lineitem) select l_orderkey, l_linenumber, case when l_orderkey % 97 = 0 then 'moved' else 'missing' end as issue from s where l_orderkey % 97 = 0 or (l_orderkey + l_linenumber) % 89 = 0")
def misaligned_rows(spark, sf):
    """Two detectors row by row: what has no partner or another time (JN33)."""
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (c("l_linenumber") * 0.04).alias("t")).distinct()
    b = a.where("(l_orderkey + l_linenumber) % 89 <> 0 or l_orderkey % 97 = 0").select("l_orderkey", "l_linenumber", (c("t") + F.when(c("l_orderkey") % 97 == 0, 0.001).otherwise(0.0)).alias("u"))
    both = a.join(b, ["l_orderkey", "l_linenumber"], "left")
    return both.select("l_orderkey", "l_linenumber", F.when(c("u").isNull(), "missing").when(F.abs(c("t") - c("u")) > 1e-5, "moved").alias("issue")).where("issue is not null")


@query("readable_share", _SMP + """, w as (select *, round(time_sec * 1000000)::bigint as us from s), n as (select *, coalesce(least(lead(us) over (partition by source_id order by us, sample_id) - us, 100000), 100000) as w from w)
select source_id, round(sum(case when face_visible >= 0.5 then w else 0 end) / sum(w), 6) as readable, round(sum(w) / 1000000.0, 4) as covered from n group by source_id""")
def readable_share(spark, sf):
    """Share of readable time and time covered, a row holding for a tenth of a second at most (AG8)."""
    s = _samples(spark, sf).select(c("source_id").alias("series"), F.round(c("time_sec") * 1000000).cast("bigint").alias("us"), c("sample_id").alias("key"), "face_visible")
    held = S.weights(s, series="series", time="us", key="key", interval=100_000)
    return held.groupBy(c("series").alias("source_id")).agg(F.round(F.sum(F.when(c("face_visible") >= 0.5, c("w")).otherwise(0)) / F.sum("w"), 6).alias("readable"), F.round(F.sum("w") / 1000000, 4).alias("covered"))


@query("pooled_header", "select project_uid, min(fps) as fps, max(case when isfinite(duration_sec) then duration_sec end) as longest, round(sum(case when isfinite(analyzed_seconds) then analyzed_seconds end), 3) as analysed, count(*) as n from sources group by project_uid")
def pooled_header(spark, sf):
    """Least rate, longest source, sums of what is known (AG19)."""
    finite = lambda n: F.when(~F.isnan(n) & (F.abs(c(n)) < float("inf")), c(n))
    return table(spark, sf, "sources").groupBy("project_uid").agg(F.min("fps").alias("fps"), F.max(finite("duration_sec")).alias("longest"), F.round(F.sum(finite("analyzed_seconds")), 3).alias("analysed"), F.count("*").alias("n"))


@query("agreeing_ends", _SMP + """, e as (select source_id, shot_id, arg_min(lower(category), (time_sec, sample_id)) as a, arg_max(lower(category), (time_sec, sample_id)) as b from s where shot_id is not null and category is not null group by all)
select source_id, shot_id, a = b as agree from e""")
def agreeing_ends(spark, sf):
    """Whether the first and the last sample of a shot agree (CL12)."""
    s = _samples(spark, sf).where("shot_id is not null and category is not null").groupBy("source_id", "shot_id")
    at, name = F.struct("time_sec", "sample_id"), F.lower("category")
    return s.agg((F.min_by(name, at) == F.max_by(name, at)).alias("agree"))


@query("better_model", _SMP + """, u as (select source_id, avg(case when face_visible < 0.5 then 1.0 else 0.0 end) as a, avg(case when speaking > 0.5 then 1.0 else 0.0 end) as b, count(*) as n from s group by source_id) select source_id, n >= 8 and a >= 0.45 and a - b >= 0.1 as switch from u""")
def better_model(spark, sf):
    """Switch only where much is uncertain and the other is surer (CL13)."""
    u = _samples(spark, sf).groupBy("source_id").agg(F.avg(F.when(c("face_visible") < 0.5, 1.0).otherwise(0.0)).alias("a"), F.avg(F.when(c("speaking") > 0.5, 1.0).otherwise(0.0)).alias("b"), F.count("*").alias("n"))
    return u.select("source_id", ((c("n") >= 8) & (c("a") >= 0.45) & (c("a") - c("b") >= 0.1)).alias("switch"))


@query("lead_in", _APP + " select source_id, min(start_sec) as lead, count(*) filter (start_sec < 60 and end_sec > 0) as occupied from a where isfinite(start_sec) and isfinite(end_sec) and source_id is not null and end_sec > start_sec group by source_id")
def lead_in(spark, sf):
    """Time before the first interval of a source, and what lies in its opening (GR5)."""
    a = table(spark, sf, "appearances").drop("ingested_at").distinct()
    finite = lambda n: c(n).isNotNull() & ~F.isnan(n) & (F.abs(c(n)) < float("inf"))
    a = a.where(finite("start_sec") & finite("end_sec") & c("source_id").isNotNull() & (c("end_sec") > c("start_sec")))
    return a.groupBy("source_id").agg(F.min("start_sec").alias("lead"), F.count_if((c("start_sec") < 60) & (c("end_sec") > 0)).alias("occupied"))


@query("media_paths", "select lower(replace(media_path, '\\', '/')) as path, min(source_id) as first from sources where not regexp_full_match(media_path, '[0-9]*') group by 1")
def media_paths(spark, sf):
    """Distinct paths, whatever their case and slashes, with where they come first; digits only are none (SRC20, SR13)."""
    s = table(spark, sf, "sources").where(~c("media_path").rlike("^[0-9]*$"))
    return s.groupBy(F.lower(F.translate("media_path", "\\", "/")).alias("path")).agg(F.min("source_id").alias("first"))


@query("track_items", _TRACK + " select t.id, t.subject_kind, s.media_path from t join sources s using (source_id)")
def track_items(spark, sf):
    """Items of a track with the media they point to (SRC17-SRC19)."""
    return _tracks(spark, sf).select("id", "source_id", "subject_kind").join(table(spark, sf, "sources").select("source_id", "media_path"), "source_id").select("id", "subject_kind", "media_path")


@query("project_summary", """with t as (select distinct on (id) * from track where id is not null) select project_uid, count(distinct s.source_id) as sources, count(t.id) as tracks, count(distinct case when t.shot_id is not null then (t.source_id, t.shot_id) end) as shots from sources s left join t using (source_id) group by project_uid""")
def project_summary(spark, sf):
    """A project as a whole: sources, tracks and shots (SRC21)."""
    t = _tracks(spark, sf).groupBy("source_id").agg(F.count("*").alias("tracks"), F.count_distinct("shot_id").alias("shots"))
    s = table(spark, sf, "sources").select("project_uid", "source_id").join(t, "source_id", "left")
    return s.groupBy("project_uid").agg(F.count_distinct("source_id").alias("sources"), F.coalesce(F.sum("tracks"), F.lit(0)).alias("tracks"), F.coalesce(F.sum("shots"), F.lit(0)).alias("shots"))


@query("recording_class", """with s as (select distinct sound_id, source_id, kind, lower(word) as word, action_stem, prob from source_sound where source_id is not null)
select source_id, coalesce(max(action_stem) filter (kind = 'action' and prob >= 0.9), case when count(*) filter (kind = 'word' and prob >= 0.6) > 0 then 'words' end, max(action_stem) filter (kind = 'action'), 'unclear') as label from s group by source_id""")
def recording_class(spark, sf):
    """What a whole recording is: a strong sound, else words, else any sound (WN24, WN26)."""
    s = table(spark, sf, "source_sound").where("source_id is not null").dropDuplicates(["sound_id"])
    strong = F.max(F.when((c("kind") == "action") & (c("prob") >= 0.9), c("action_stem")))
    worded = F.when(F.count_if((c("kind") == "word") & (c("prob") >= 0.6)) > 0, F.lit("words"))
    return s.groupBy("source_id").agg(F.coalesce(strong, worded, F.max(F.when(c("kind") == "action", c("action_stem"))), F.lit("unclear")).alias("label"))


@query("framed_energy", _EMB + """, f as (select vec_id, v, k from e, range(7) t(k)), w as (select vec_id, k, unnest(v[k * 8 + 1 : k * 8 + 16]) as x, generate_subscripts(v[k * 8 + 1 : k * 8 + 16], 1) as i from f),
h as (select *, x * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 16)) as y, lag(x) over (partition by vec_id, k order by i) as p from w)
select vec_id, k::int as frame, round(sqrt(avg(y * y)), 4) as rms, count(*) filter (x * p < 0) as crossings from h group by vec_id, k""")
def framed_energy(spark, sf):
    """Overlapping frames of a signal with a Hann window: energy and zero crossings (WN15, WN16, SRC9)."""
    e = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("frame"), "embedding")
    x = F.transform(F.slice("embedding", c("frame") * 8 + 1, F.lit(16)), lambda v: v.cast("double"))
    y = F.transform(x, lambda v, i: v * (0.5 - 0.5 * F.cos(2 * F.pi() * i / 16)))
    signs = F.zip_with(F.slice(x, 1, 15), F.slice(x, 2, 15), lambda a, b: F.when(a * b < 0, 1).otherwise(0))
    return e.select("vec_id", "frame", F.round(F.sqrt(G.total(F.transform(y, lambda v: v * v)) / 16), 4).alias("rms"), F.aggregate(signs, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("crossings"))


@query("leading_silence", _EMB + ", l as (select vec_id, list_min(list_filter(range(64), lambda i: abs(v[i + 1]) > 0.05)) as first from e) select vec_id, first::int as first from l where first > 2 or first is null")
def leading_silence(spark, sf):
    """Inputs whose sound begins too late (VL7)."""
    first = F.array_min(F.filter(F.transform("embedding", lambda x, i: F.when(F.abs(x.cast("double")) > 0.05, i)), lambda i: i.isNotNull()))
    return table(spark, sf, "embeddings").select("vec_id", first.alias("first")).where("first > 2 or first is null")


@query("shortest_need", "select o_orderstatus, max(case when o_orderpriority = '1-URGENT' then o_totalprice end) as longest, min(o_totalprice) as shortest from orders group by o_orderstatus")
def shortest_need(spark, sf):
    """The longest of the demands that come first, the shortest of all (AS15)."""
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.max(F.when(c("o_orderpriority") == "1-URGENT", c("o_totalprice"))).alias("longest"), F.min("o_totalprice").alias("shortest"))
