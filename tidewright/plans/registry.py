"""All queries of the core, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import demand_queries, graph_queries, metric_queries, record_queries, spatial_queries, stream_queries, text_queries

MODULES = [demand_queries, graph_queries, metric_queries, record_queries, spatial_queries, stream_queries, text_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
