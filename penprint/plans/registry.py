"""Registered queries: one Spark job + one DuckDB oracle SQL per operator.

Each entry maps a name to ``(spark_fn(spark, sf_dir) -> DataFrame, sql | None)``.
The SQL runs on DuckDB views named after the input tables.  Column names and
types are aligned on both sides (counts BIGINT, indices INTEGER/BIGINT,
measures DOUBLE rounded where summation order differs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Entry = tuple[Callable[[SparkSession, str], DataFrame], "str | None"]
REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the query modules fills REGISTRY
    from penprint.plans import (  # noqa: F401
        q_closed_set, q_files, q_models, q_sampling, q_text, q_verification,
    )
    return REGISTRY
