"""Name to query, and name to SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.plans.adapter import Tables, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function of `Tables`; `sql` is its twin over the named adapter views."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            TWINS[name] = twin(views, sql)
        return fn

    return wrap
