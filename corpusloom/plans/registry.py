"""Every named query of the core and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import chunks, evaluation, events, retrieval

_PARTS = [chunks, retrieval, evaluation, events]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for p in _PARTS for k, f in p.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _PARTS for k, s in p.S.items()}
