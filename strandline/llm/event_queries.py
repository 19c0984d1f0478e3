"""Queries of problems 1 and 3: nearest samples of sounds, runs of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.nearest import nearest_in_time
from strandline.llm.runs import collapse_runs
from strandline.sources.tables import table

TOLERANCE = 0.25
MAX_GAP = 1.5
#: More names than this are no list of categories.
MAX_ENTRIES = 10_000


def p1_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Every sound with its nearest sample and the time between them, to microseconds."""
    found = nearest_in_time(
        table(spark, sf, "source_sound"),
        table(spark, sf, "samples"),
        entity="source_id",
        left_id="sound_id",
        left_time="start",
        right_id="sample_id",
        right_time="time_sec",
        tolerance=TOLERANCE,
    )
    return found.selectExpr("sound_id", "sample_id", "cast(round(delta_sec * 1000000) as bigint) as delta_us")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_nearest(spark, sf).select("sound_id", "sample_id")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    entries = [r[0] for r in table(spark, sf, "category_list").select("category").dropna().distinct().limit(MAX_ENTRIES + 1).collect()]
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"category_list holds more than {MAX_ENTRIES} names")
    return collapse_runs(table(spark, sf, "samples"), entity="source_id", time="time_sec", key="sample_id", label="category", entries=entries, max_gap=MAX_GAP)


def p3_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run, single samples too."""
    return _runs(spark, sf).selectExpr(
        "entity as source_id", "category", "first_id as first_sample_id", "last_id as last_sample_id", "n", "cast(round(duration_sec * 1000000) as bigint) as duration_us"
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).where("n >= 2").selectExpr("first_id as first_sample_id", "last_id as last_sample_id")


QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest, "p3_found": p3_found, "p3_runs": p3_runs}

_NEAREST = """
with snd as (select distinct sound_id, source_id, start from source_sound where source_id is not null and isfinite(start)),
smp as (select source_id, time_sec, min(sample_id) as sample_id from samples where source_id is not null and isfinite(time_sec) group by all),
b as (select snd.sound_id, smp.sample_id, smp.time_sec - snd.start as d, 0 as o from snd asof join smp on snd.source_id = smp.source_id and snd.start >= smp.time_sec),
f as (select snd.sound_id, smp.sample_id, smp.time_sec - snd.start as d, 1 as o from snd asof join smp on snd.source_id = smp.source_id and snd.start <= smp.time_sec),
best as (select * from (select * from b union all select * from f) where abs(d) <= 0.25 qualify row_number() over (partition by sound_id order by abs(d), o) = 1)
"""
_FULL = "０１２３４５６７８９ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
_PLAIN = "0123456789abcdefghijklmnopqrstuvwxyz"
_ALIKE, _LATIN = "авсеніјкморѕтухԁԛԝ", "abcehijkmopstyxdqw"
LETTERS_SQL = f"regexp_replace(translate(strip_accents(lower(category)), '{_FULL}{_ALIKE}', '{_PLAIN}{_LATIN}'), '[^\\pL]', '', 'g')"
_RUNS = f"""
with spelt as (select distinct category, {LETTERS_SQL} as f from samples where category is not null),
named as (select category as entry, {LETTERS_SQL} as g from category_list),
means as (select spelt.category, arg_min(entry, levenshtein(f, g)) as entry from spelt join named on levenshtein(f, g) <= 2 group by spelt.category),
smp as (select distinct sample_id, source_id, time_sec, entry from samples join means using (category) where source_id is not null and isfinite(time_sec)),
marked as (select *, case when lag(entry) over w = entry and time_sec - lag(time_sec) over w <= 1.5 then 0 else 1 end as opens from smp window w as (partition by source_id order by time_sec, sample_id)),
numbered as (select *, sum(opens) over (partition by source_id order by time_sec, sample_id rows unbounded preceding) as k from marked),
runs as (
  select source_id, entry as category, first(sample_id order by time_sec, sample_id) as first_sample_id, last(sample_id order by time_sec, sample_id) as last_sample_id,
    count(*) as n, cast(round((max(time_sec) - min(time_sec)) * 1000000) as bigint) as duration_us
  from numbered group by source_id, entry, k)
"""
SQL = {
    "p1_found": _NEAREST + "select sound_id, sample_id from best",
    "p1_nearest": _NEAREST + "select sound_id, sample_id, cast(round(d * 1000000) as bigint) as delta_us from best",
    "p3_found": _RUNS + "select first_sample_id, last_sample_id from runs where n >= 2",
    "p3_runs": _RUNS + "select * from runs",
}
