"""All registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestore.plans import governance, graphs, ledgers, measures, memory, relations, replicas, rules, search, texts

MODULES = [search, texts, relations, graphs, ledgers, rules, memory, governance, replicas, measures]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
