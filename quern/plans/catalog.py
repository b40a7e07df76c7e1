"""Every registered query of the reference's operators and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import build_queries, compile_queries, io_queries, model_queries, report_queries, retrieval_queries, text_queries, training_queries  # noqa: F401
from quern.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
