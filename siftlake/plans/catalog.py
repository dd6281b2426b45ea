"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.plans import data_queries, more_queries, reference_queries

_MODULES = [data_queries, reference_queries, more_queries]


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return reference_queries.scan_rule_counts(spark, d)
