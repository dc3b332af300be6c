"""Registry of the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.plans import audits, joins, matching, reports, scans, texts  # noqa: F401  (they register their queries)
from quillmill.plans.base import QUERIES, SQL


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the primary domain that the gate gives them."""
    return QUERIES["primary_domain_counts"](spark, d)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
