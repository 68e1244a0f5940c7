"""All registered queries of the library proper, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkwright.plans import conditions, decisions, edits, evaluation, findings, fitting, graphs, model, placement, relations, streams, text, trees

MODULES = (conditions, decisions, edits, evaluation, findings, fitting, graphs, model, placement, relations, streams, text, trees)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
