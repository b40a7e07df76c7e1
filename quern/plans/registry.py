"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The data folder's tables, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under `name`, with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return register


# SQL fragments for the expressions of quern.functions.text.


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


WS = "'[ \\t\\n\\r]+'"
PUNCT = "'[!-/:-@\\[-`{-~]'"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {WS}), lambda w: w <> '')"


def _no_articles(x: str) -> str:
    return f"array_to_string(list_filter(string_split_regex({x}, {WS}), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def norm_b(x: str) -> str:
    return _no_articles(f"regexp_replace(lower({x}), {PUNCT}, '', 'g')")


def norm_a(x: str) -> str:
    return norm_b(f"regexp_replace({x}, '[ \\t\\n\\r]*_[ \\t\\n\\r]*', '_', 'g')")


def multiset(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))), 0)"


def f1(common: str, np: str, ng: str, empty: str = "0.0") -> str:
    return f"CASE WHEN {np} = 0 AND {ng} = 0 THEN {empty} WHEN {np} = 0 OR {ng} = 0 OR {common} = 0 THEN 0.0 ELSE 2.0 * ({common} / {np}) * ({common} / {ng}) / ({common} / {np} + {common} / {ng}) END"


def h8(key: str, salt: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8) AS BIGINT)"


def hkey(key: str, salt: str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{salt}')"
