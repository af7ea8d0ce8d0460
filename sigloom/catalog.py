"""All queries of the engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigloom.plans import search, text, tools

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES = text.QUERIES | search.QUERIES | tools.QUERIES


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as topics, searched among the documents."""
    return search.topic_search(spark, sf_dir)
