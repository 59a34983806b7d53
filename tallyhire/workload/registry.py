"""Registered queries: a name, the Spark form, and the check query where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhire.workload.world import World, flat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(world) -> DataFrame`` under ``name``."""
    def wrap(fn: Callable[[World], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: flat(fn(World(spark, folder)))
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return wrap


def load_all() -> None:
    from tallyhire.workload import crawling, feeds, scalars, skills, state, temporal, views  # noqa: F401
