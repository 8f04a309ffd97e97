"""Query registry: a Spark callable and, where SQL can express it, its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from conceptspark.fixtures import Corpus
from conceptspark.plans.views import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(corpus) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Corpus(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = compose(sql, extra)
        return fn

    return register
