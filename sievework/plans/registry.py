"""All registered queries of the reference's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audited, curation, parsing, relational, reviewed


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**curation.QUERIES, **relational.QUERIES, **parsing.QUERIES, **audited.QUERIES, **reviewed.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**curation.SQL, **relational.SQL, **parsing.SQL, **audited.SQL, **reviewed.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curation in one plan: a funnel, exact duplicates by normal form, and scripts of what is left."""
    return curation.curated(spark, sf_dir)
