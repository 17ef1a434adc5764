"""Registry of queries and of the SQL each one is checked with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callgauge.plans.fixtures import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL over the fixture views that gives the same rows."""

    def keep(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def _used(sql: str, taken: list[str]) -> None:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", sql))
    for name, body in CTES.items():
        if name in words and name not in taken:
            _used(body, taken)
            if name not in taken:
                taken.append(name)


def with_ctes(sql: str) -> str:
    """Put the fixture views the SQL mentions in front of it."""
    taken: list[str] = []
    _used(sql, taken)
    if not taken:
        return sql
    views = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in taken)
    lead = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if lead:
        return f"WITH RECURSIVE {views},\n{sql[lead.end():]}"
    return f"WITH {views}\n{sql}"


def runnable(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))
