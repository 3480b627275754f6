"""All named queries of the engine and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from intervalis.plans import detail_queries, fold_queries, motion_queries, pair_queries, rollup_queries, search_queries, series_queries, state_queries

_PARTS = (search_queries, rollup_queries, series_queries, fold_queries, detail_queries, pair_queries, motion_queries, state_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.REGISTER.queries.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.REGISTER.sql.items()}
