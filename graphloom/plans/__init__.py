"""Registered queries: each module holds queries of one family beside their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import communities, competency, constraints, decisions, ledger, mapping, matching, operations, relational, schemes, streams, versions  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
