"""Every registered query of the catalogue engine with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import search, shelf, sources, stores, tables, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**search.QUERIES, **tables.QUERIES, **texts.QUERIES, **shelf.QUERIES, **sources.QUERIES, **stores.QUERIES}
ORACLE_SQL: dict[str, str] = {**search.ORACLE_SQL, **tables.ORACLE_SQL, **texts.ORACLE_SQL, **shelf.ORACLE_SQL, **sources.ORACLE_SQL, **stores.ORACLE_SQL}
