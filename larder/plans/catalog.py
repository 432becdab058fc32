"""All registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.plans.registry import ORACLE, QUERIES, Tables

FAMILIES = [
    "cleaning_queries", "resolution_queries", "nutrition_queries", "validation_queries", "retrieval_queries",
    "constraint_queries", "ranking_queries", "feedback_queries", "streaming_queries",
]


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"larder.plans.{name}")


def _bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bind(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
