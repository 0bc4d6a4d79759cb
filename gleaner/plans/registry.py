"""The engine's queries over the test tables, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import catalog_queries, detail_queries, report_queries, route_queries, stream_queries, table_queries, text_queries
from gleaner.plans.query import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog_queries", "detail_queries", "flagship", "report_queries", "route_queries", "stream_queries", "table_queries", "text_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' risk levels and how many have no known authentication."""
    return text_queries.risk_bucket_counts(spark, sf_dir)
