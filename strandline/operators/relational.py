"""Joins and aggregations with rules of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divide(pairs: DataFrame, divisor: DataFrame, *, keep: list[str], by: str) -> DataFrame:
    """Relational division (JN6): the ``keep`` values that occur with every value of ``divisor.by`` in their first column.

    ``divisor`` has the first ``keep`` column and ``by``; a candidate must match each of its values.
    """
    group = keep[0]
    need = divisor.groupBy(group).agg(F.count_distinct(by).alias("need"))
    have = pairs.join(divisor.select(group, by).distinct(), [group, by]).groupBy(*keep).agg(F.count_distinct(by).alias("have"))
    return have.join(need, group).where("have = need").select(*keep)


def not_cached(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests whose key isn't in the cache (JN17)."""
    return requests.join(cache.select(key).distinct(), key, "left_anti")


def differences(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that were added, removed or changed (JN22): key, what. Nulls are equal to nulls."""
    a = before.select(key, F.struct(*columns).alias("a"), F.lit(1).alias("ina"))
    b = after.select(key, F.struct(*columns).alias("b"), F.lit(1).alias("inb"))
    what = F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(key, what.alias("what")).where("what is not null")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of a group (SR2, SR3), with ``place``."""
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def strict_sum(x: Column) -> Column:
    """A sum that is null if any value is (AG18)."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def first_tier(tiers: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first tier that has any for a key (AS10): the columns and ``tier``."""
    both = None
    for i, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(i))
        both = t if both is None else both.unionByName(t)
    best = both.groupBy(key).agg(F.min("tier").alias("tier"))
    return both.join(best, [key, "tier"])


def issues(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule (VL1): key, issue. A rule that is null is broken."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(key, F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("issue"))
