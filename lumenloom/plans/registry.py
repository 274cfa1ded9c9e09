"""All registered telemetry queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenloom.plans import analytics, extra, files, forms, lines, linked, metrics, more, polls, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (metrics, records, lines, forms, files, more, extra, analytics, polls, linked):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
