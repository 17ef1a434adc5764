"""All registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callgauge.plans import (  # noqa: F401  (fills the registry)
    flow_queries,
    generation_queries,
    lint_queries,
    oracle_views,
    score_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from callgauge.plans.registry import ORACLES, QUERIES, runnable, with_ctes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(build) for name, build in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}
