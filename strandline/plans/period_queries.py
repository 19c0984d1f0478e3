"""Queries of problem 5: periods and gaps of appearances and of verified ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.periods import periods_and_gaps, whole_ms
from strandline.sources.tables import table

ENTITY = ["origin", "source_id", "character_id"]


def _bounds(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "appearances").select(
        F.lit("appearances").alias("origin"), "source_id", "character_id", whole_ms(F.col("start_sec")).alias("s"), whole_ms(F.col("end_sec")).alias("e")
    )
    ranges = table(spark, sf, "merge_evidence").select("source_id", F.explode("verified_ranges").alias("r")).where(F.size("r") == 2)
    checked = ranges.select(
        F.lit("verified_ranges").alias("origin"), "source_id", F.lit(0).cast("bigint").alias("character_id"), whole_ms(F.col("r")[0]).alias("s"), whole_ms(F.col("r")[1]).alias("e")
    )
    return seen.unionByName(checked)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return periods_and_gaps(_bounds(spark, sf), ENTITY, "s", "e").select("origin", "source_id", "character_id", "kind", "start_ms", "end_ms")


def p5_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per entity: number of periods and gaps, time covered and time open."""
    found = periods_and_gaps(_bounds(spark, sf), ENTITY, "s", "e")
    period, length = F.col("kind") == "period", F.col("end_ms") - F.col("start_ms")
    return found.groupBy(*ENTITY).agg(
        F.count(F.when(period, 1)).alias("periods"),
        F.count(F.when(~period, 1)).alias("gaps"),
        F.sum(F.when(period, length).otherwise(0)).alias("covered_ms"),
        F.sum(F.when(~period, length).otherwise(0)).alias("open_ms"),
    )


_PERIODS = """
with raw as (
  select 'appearances' as origin, source_id, character_id, start_sec as a, end_sec as b from appearances
  union all
  select 'verified_ranges', source_id, 0::bigint, r[1], r[2]
  from (select source_id, unnest(verified_ranges) as r from merge_evidence) where len(r) = 2
), ms as (
  select origin, source_id, character_id, cast(round(a * 1000) as bigint) as s, cast(round(b * 1000) as bigint) as e
  from raw where isfinite(a) and isfinite(b) and source_id is not null and character_id is not null
), good as (
  select *, max(e) over (partition by origin, source_id, character_id order by s, e rows between unbounded preceding and 1 preceding) as high
  from ms where e > s
), marked as (
  select *, sum(case when high is null or s > high then 1 else 0 end) over (partition by origin, source_id, character_id order by s, e rows unbounded preceding) as n
  from good
), periods as (
  select origin, source_id, character_id, n, min(s) as s, max(e) as e from marked group by all
), found as (
  select origin, source_id, character_id, 'period' as kind, s as start_ms, e as end_ms from periods
  union all
  select origin, source_id, character_id, 'gap', e, nxt from (
    select *, lead(s) over (partition by origin, source_id, character_id order by s) as nxt from periods) where nxt is not null
)
"""

QUERIES = {"p5_found": p5_found, "p5_coverage": p5_coverage}

SQL = {
    "p5_found": _PERIODS + "select origin, source_id, character_id, kind, start_ms, end_ms from found",
    "p5_coverage": _PERIODS
    + """select origin, source_id, character_id, count(*) filter (kind = 'period') as periods, count(*) filter (kind = 'gap') as gaps,
  cast(coalesce(sum(end_ms - start_ms) filter (kind = 'period'), 0) as bigint) as covered_ms,
  cast(coalesce(sum(end_ms - start_ms) filter (kind = 'gap'), 0) as bigint) as open_ms
from found group by all""",
}
