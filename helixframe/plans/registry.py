"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.plans import assembly_queries, cohort_queries, recruit_queries, source_queries, table_queries

_ALL = recruit_queries.QUERIES | cohort_queries.QUERIES | assembly_queries.QUERIES | table_queries.QUERIES | source_queries.QUERIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for name, (query, _) in _ALL.items()}
#: Queries that SQL cannot express have none.
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
