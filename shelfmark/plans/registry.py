"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import discs, freshness, library, matching, places, selection, serving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**matching.QUERIES, **selection.QUERIES, **serving.QUERIES, **library.QUERIES, **places.QUERIES, **discs.QUERIES, **freshness.QUERIES}
ORACLE_SQL: dict[str, str] = {**matching.ORACLE_SQL, **selection.ORACLE_SQL, **serving.ORACLE_SQL, **library.ORACLE_SQL, **places.ORACLE_SQL, **discs.ORACLE_SQL, **freshness.ORACLE_SQL}
