"""All named queries of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import checks, conversations, profiles, registry, rows, scores, series, texts, wider  # noqa: F401  each registers its queries


def queries() -> dict:
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prompt_length_profile(spark, sf_dir)
