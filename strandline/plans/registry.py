"""All core queries by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import allocation_queries, evidence_queries, interval_queries, ordered_queries, period_queries, relational_queries, rule_queries, series_queries, stream_queries

MODULES = [period_queries, series_queries, interval_queries, relational_queries, ordered_queries, stream_queries, evidence_queries, rule_queries, allocation_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return period_queries.p5_found(spark, folder)
