"""All registered queries of the core with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codescout.plans import code, documents, events, graphs, overviews, questions, symbols

_ALL = documents.QUERIES | code.QUERIES | graphs.QUERIES | questions.QUERIES | events.QUERIES | symbols.QUERIES | overviews.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, (_, sql) in _ALL.items() if sql}
