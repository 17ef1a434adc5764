"""Joins of a large table with a specification table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 32


def is_small(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``max_rows + 1`` rows to see whether the table may be broadcast."""
    return table.limit(max_rows + 1).count() <= max_rows


def join_spec(
    rows: DataFrame,
    spec: DataFrame,
    on: list[str],
    how: str = "left",
    small: bool | None = None,
    spread: str | None = None,
) -> DataFrame:
    """Join ``rows`` with a table that is unique on ``on``.

    A small ``spec`` (counted here unless the caller knows) is broadcast, so
    ``rows`` are not moved. A larger one is joined on (on, salt): one key may hold
    a third of ``rows``, and the salt spreads it over ``SALTS`` tasks.
    """
    if small if small is not None else is_small(spec):
        return rows.join(F.broadcast(spec), on, how)
    seed = F.xxhash64(*[F.col(c) for c in ([spread] if spread else _plain_columns(rows))])
    salted_rows = rows.withColumn("_salt", F.pmod(seed, F.lit(SALTS)).cast("int"))
    salted_spec = spec.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted_rows.join(salted_spec, [*on, "_salt"], how).drop("_salt")


def _plain_columns(rows: DataFrame) -> list[str]:
    flat = ("bigint", "int", "string", "double", "timestamp", "timestamp_ntz", "date")
    return [name for name, kind in rows.dtypes if kind in flat]
