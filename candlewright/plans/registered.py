"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from candlewright.shipping import ensure

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")

        @wraps(f)
        def run(spark, sf_dir):
            ensure(spark)
            return f(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return f

    return add
