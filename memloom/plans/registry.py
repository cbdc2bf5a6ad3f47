"""Named queries over the shared tables, with the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memloom.plans import graph_queries, ingest_queries, search_queries, store_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]

_PARTS = (table_queries, store_queries, search_queries, graph_queries, ingest_queries)
QUERIES: dict[str, Query] = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
