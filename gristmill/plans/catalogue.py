"""Every query of the engine's own operators, by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.plans import page_queries, report_queries, state_queries, text_queries
from gristmill.plans.registry import QUERIES, SQL, Query

MODULES = (text_queries, report_queries, page_queries, state_queries)  # importing them enters their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_queries.concern_shares(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
