"""Registered queries: name -> (builder(spark, sf_dir) -> DataFrame, DuckDB SQL | None).

Modules call ``register`` at import time; ``__spark_entry__`` exposes the
union. Every query reads the driver's tables (through the canonical views)
over their whole extent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from ledgerlake.plans import (q_basic, q_clean, q_customers, q_inventory,  # noqa: F401
                                  q_extra, q_forecast, q_plans, q_products, q_sources, q_text,
                                  q_time)
