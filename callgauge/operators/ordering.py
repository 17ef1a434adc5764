"""Position and next-row operators that stay parallel when one key owns most rows.

A plain ``row_number() over (partition by key order by ..)`` sorts every row of
a key in one task. Here a key is cut into slices of its order (a time slice, a
number range, or quantiles of its own rows). Rows are ranked inside a slice, and a narrow table with one row
per (key, slice) carries the running count or the next slice's first row. The
rows are shuffled once, by (key, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgauge.operators.dims import join_spec
from callgauge.session import saved


def time_slice(ts: str, seconds: int = 60) -> Column:
    """A minute by default: a key with a third of a month's rows has 43,200 slices of it."""
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / F.lit(seconds)).cast("bigint")


def number_slice(column: str, width: int = 256) -> Column:
    return F.floor(F.col(column) / F.lit(width)).cast("bigint")


SLICE_ROWS = 100_000
SLICES = 128
_ACCURACY = 2000


def _number(rows: DataFrame, column: str) -> Column | None:
    """An order-preserving number of a column, None for kinds that have none."""
    kind = dict(rows.dtypes)[column]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    return F.col(column) if numeric else None


def with_even_slices(rows: DataFrame, key: list[str], order: list[str], most: int = SLICE_ROWS) -> DataFrame:
    """Add ``_slice``, an array that ascends with ``order`` inside each key, so that slices hold about ``most`` rows or a ``SLICES``-th of a large cell.

    A key above ``most`` rows is cut at quantiles of the first order column, sketched in one aggregation, and a quantile is
    a slice by itself, so that many rows at one time stand alone; these are cut at quantiles of the next column, and so on. Keys are not sorted anywhere,
    and the cuts of the few large cells are one row each. Nulls come first, as in an ascending sort; columns that
    are no number and no time are not cut. An order column with few values does not split its equal rows: the last column
    should tell rows apart.
    """
    out = rows.withColumn("_slice", F.array().cast("array<int>"))
    shares = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    cells = [*key, "_slice"]
    for column in order:
        number = _number(rows, column)
        if number is None:
            break
        cuts = F.array_distinct(F.percentile_approx(number, shares, _ACCURACY)).alias("_cuts")
        # Odd cells hold one value of the column before, so the next column may cut them.
        alike = F.coalesce(F.element_at("_slice", -1) % 2 != 0, F.lit(True)) if column != order[0] else F.lit(True)
        large = out.where(alike).groupBy(*cells).agg(F.count("*").alias("_n"), cuts).where(F.col("_n") > most)
        large = saved(large.drop("_n"), "slice-cuts")
        if large.isEmpty():
            break
        out = join_spec(out, large, cells, "left", spread=order[-1])
        place = F.size(F.filter("_cuts", lambda cut: cut < number)) * 2 + F.array_contains("_cuts", number).cast("int")
        place = F.when(F.col("_cuts").isNull(), F.lit(0)).when(number.isNull(), F.lit(-1)).otherwise(place)
        out = out.withColumn("_slice", F.concat("_slice", F.array(place))).drop("_cuts")
    return out


def value_slice(rows: DataFrame, value: str, slices: int = 256) -> Column:
    """Which of about ``slices`` equally full ranges a value of ``rows`` lies in, by splitters from one quantile sketch.

    ``rows`` should hold each value once. The splitters are compared in a tree, so a row costs log2(slices) comparisons.
    """
    shares = [i / slices for i in range(1, slices)]
    found = rows.agg(F.percentile_approx(value, F.array(*[F.lit(s) for s in shares]), 100 * slices)).first()[0]
    splitters = sorted(set(found or []))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(value) <= F.lit(splitters[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(splitters)).cast("bigint")


def with_position(rows: DataFrame, key: list[str], order: list[str], cut: Column | None, name: str, most: int = SLICE_ROWS) -> DataFrame:
    """Add ``name``: the 0-based position of the row inside its key.

    Without ``cut`` the slices follow the data (see ``with_even_slices``), which takes an aggregation of its own.
    """
    sliced = with_even_slices(rows, key, order, most) if cut is None else rows.withColumn("_slice", cut)
    per_slice = [*key, "_slice"]
    before = (
        sliced.groupBy(*per_slice)
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*per_slice).orderBy(*order))
    return (
        sliced.withColumn("_inside", inside)
        .join(before, per_slice)
        .withColumn(name, (F.col("_before") + F.col("_inside") - 1).cast("int"))
        .drop("_slice", "_inside", "_before")
    )


def with_next(rows: DataFrame, key: list[str], order: str, cut: Column, columns: list[str]) -> DataFrame:
    """Add ``next_<c>`` for each column: the value on the row right after, in ``order``."""
    sliced = rows.withColumn("_slice", cut)
    per_slice = [*key, "_slice"]
    head = F.struct(*[F.col(c).alias(c) for c in columns])
    heads = (
        sliced.groupBy(*per_slice)
        .agg(F.min_by(head, F.col(order)).alias("_head"))
        .withColumn("_next_head", F.lead("_head").over(Window.partitionBy(*key).orderBy("_slice")))
        .drop("_head")
    )
    inside = F.lead(head).over(Window.partitionBy(*per_slice).orderBy(order))
    out = sliced.withColumn("_next", inside).join(heads, per_slice, "left")
    found = F.coalesce(F.col("_next"), F.col("_next_head"))
    for c in columns:
        out = out.withColumn(f"next_{c}", found[c])
    return out.drop("_slice", "_next", "_next_head")


UNIT_SLICES = 4096


def unit_slice(value: str) -> Column:
    """Slices of values between 0 and 1 (others fall into the first or last): at most ``UNIT_SLICES`` + 1."""
    return F.greatest(F.lit(0), F.least(F.lit(UNIT_SLICES), F.floor(F.col(value) * UNIT_SLICES))).cast("bigint")


def with_running(rows: DataFrame, order: Column, amount: str, cut: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows before this one in a global order of unique values.

    ``cut`` cuts the order into a bounded number of slices, whose sums alone meet in one place; rows are summed inside
    their slice. Slices have to ascend with ``order``.
    """
    sliced = rows.withColumn("_slice", cut)
    sums = sliced.groupBy("_slice").agg(F.sum(amount).alias("_sum"))
    upto = F.sum("_sum").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("_slice", F.coalesce(upto, F.lit(0)).alias("_before"))
    inside = F.sum(amount).over(Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    placed = sliced.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(before, "_slice")
    return placed.withColumn(name, F.col("_before") + F.col("_inside")).drop("_slice", "_inside", "_before")
