"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB twin over the driver views; ``None`` marks an
    operator that SQL cannot express, which is checked rows-only.
    """

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


MODULES = (
    "q_sources",
    "q_filters",
    "q_aggregates",
    "q_shapes",
    "q_functions",
    "q_redact",
    "q_joins",
    "q_breaker",
    "q_retry",
    "q_render",
    "q_streaming",
)


def load_all() -> None:
    """Import every catalogue module so their queries register."""
    import importlib

    for m in MODULES:
        try:
            importlib.import_module(f"faultline.plans.{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"faultline.plans.{m}":
                raise
