"""Named queries over the views, each with SQL that computes the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.plans.views import Source, with_views
from rollcall.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function from Source to DataFrame under ``name``."""

    def register(build: Callable[[Source], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Source(tune(spark), folder))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = with_views(oracle)
        return build

    return register
