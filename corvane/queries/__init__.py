"""One query for each operator over the star schema and the text tables, with SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graphs, joins, modes, scans, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for module in (modes, scans, joins, graphs, texts):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
