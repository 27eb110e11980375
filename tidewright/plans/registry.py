"""All queries by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import documents, events, files, geometry, merging, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for part in (documents, events, files, geometry, merging, tracks):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
