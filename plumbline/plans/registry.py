"""Registered queries: a name, the Spark plan and (where SQL can say it) the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) -> DataFrame under name."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            # count_if is a HUGEINT in DuckDB; a filtered count is the BIGINT Spark returns
            SQL[name] = " ".join(sql.split("\n")).strip().replace(
                "count_if(", "count(*) FILTER (WHERE ")
        return fn
    return add


def load() -> None:
    """Import the modules that register queries."""
    from plumbline.plans import (  # noqa: F401
        q_anomaly, q_cause, q_clean, q_compare, q_history, q_ingest, q_profile, q_scalar,
        q_scan, q_score, q_whole)
