"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    """Registers a query under its name, with its DuckDB SQL over the named common tables where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"with {'recursive ' if recursive else ''}{', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


def columns(d: dict, prefix: str = "") -> list:
    return [v.alias(prefix + k) for k, v in d.items()]
