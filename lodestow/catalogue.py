"""Every registered query of the library and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import cargo_queries, crate_queries, general_queries, intake_queries, limit_queries, packing_queries, revision_queries, sheet_queries, text_queries

_MODULES = (cargo_queries, crate_queries, general_queries, intake_queries, limit_queries, packing_queries, revision_queries, sheet_queries, text_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
