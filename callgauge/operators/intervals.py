"""How sure a statistic is: Poisson bootstrap in one aggregation, percentile intervals over the replicates.

In each replicate a case counts as often as a Poisson(1) draw says. The draw comes from a hash of the case's key, so it is the
same whichever task, attempt or judge meets the case; nothing is sampled and no row is moved but sums per group and replicate.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgauge.session import ship_code

PRIME = 2**31 - 1
REPLICATES = 200
SEED = 2024
COVERAGE = 0.95
# Counts above this have a probability under 1e-9, below the resolution of a draw.
MOST = 11


def multipliers(replicates: int = REPLICATES, seed: int = SEED) -> list[tuple[int, int, int]]:
    """One member of a pairwise independent hash family per replicate."""
    drawn = random.Random(seed)
    return [(drawn.randrange(1, PRIME), drawn.randrange(1, PRIME), drawn.randrange(PRIME)) for _ in range(replicates)]


def thresholds() -> list[int]:
    """Draws at or above the k-th threshold count at least k + 1 times."""
    mass = [math.exp(-1) / math.factorial(k) for k in range(MOST)]
    return [math.floor(PRIME * sum(mass[: k + 1])) for k in range(MOST)]


# Rows drawn at once: weighted sums of halves of so many values are exact in double precision.
DRAWN_ROWS = 4096
HALF = 2**24


def _weighed(batch: pa.RecordBatch, by: list[str], names: list[str], replicates: int, seed: int) -> pa.RecordBatch:
    """Weighted sums of a few rows, for each of their groups and every replicate: ``name``_hi times ``HALF`` plus ``name``_lo."""
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    groups = column("_group").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    keyed = column("_h").is_valid().to_numpy(zero_copy_only=False)
    h, g = (column(c).fill_null(0).to_numpy(zero_copy_only=False)[:, None] for c in ("_h", "_g"))
    a, b, c = np.array(multipliers(replicates, seed), dtype="int64").reshape(-1, 3).T
    drawn = (h * a % PRIME + g * b % PRIME + c) % PRIME
    weights = np.searchsorted(np.array(thresholds()), drawn, side="right").astype("float64")
    weights[~keyed] = 0
    weights = np.hstack([np.ones((batch.num_rows, 1)), weights])
    values = [column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in names]
    halves = np.stack([half for v in values for half in (v // HALF, v % HALF)], axis=1).astype("float64")
    firsts = np.unique(groups, return_index=True)[1]
    sums = np.concatenate([weights[at].T @ halves[at] for at in (groups == groups[first] for first in firsts)]).astype("int64")
    taken = pa.array(np.repeat(firsts, replicates + 1))
    columns = [column(name).take(taken) for name in by]
    columns += [pa.array(np.tile(np.arange(replicates + 1, dtype="int32"), len(firsts)))]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(s) for s in sums.T]], [*by, "replicate", *_halves(names)])


def _halves(names: list[str]) -> list[str]:
    return [f"{n}_{half}" for n in names for half in ("hi", "lo")]


def resampled(rows: DataFrame, by: list[str], key: str, sums: dict[str, str], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Weighted sums of whole-number expressions for each group and replicate; replicate 0 weighs every row once.

    ``key`` names the case: rows of the same case share their weight. Rows with a null key count in replicate 0 alone; a null
    value adds nothing; an empty table gives no row. Sums are decimals without fraction, so they do not depend on the order of
    rows. Weights are drawn in arrays, a few thousand rows at once; the shuffle holds at most groups times ``replicates`` + 1
    rows from each task.
    """
    ship_code(rows.sparkSession)
    digest = f"md5(CAST({key} AS STRING))"
    part = lambda at: f"CAST(conv(substr({digest}, {at}, 8), 16, 10) AS BIGINT) % {PRIME}L"
    whole = lambda e: f"CAST(CAST({e} AS DECIMAL(18,0)) AS BIGINT)"
    group = f"to_json(struct({', '.join(by)}))" if by else "''"
    values = rows.selectExpr(*by, f"{group} AS _group", f"{part(1)} AS _h", f"{part(9)} AS _g", *[f"{whole(e)} AS {n}" for n, e in sums.items()])
    names = list(sums)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DRAWN_ROWS):
                yield _weighed(batch.slice(at, DRAWN_ROWS), by, names, replicates, seed)

    kinds = T.StructType([*[values.schema[c] for c in by], T.StructField("replicate", T.IntegerType())])
    kinds = T.StructType([*kinds, *[T.StructField(n, T.LongType()) for n in _halves(names)]])
    found = values.mapInArrow(drawn, kinds).groupBy(*by, "replicate")
    total = lambda n: f"CAST(sum(CAST({n}_hi AS DECIMAL(28,0))) * {HALF} + sum(CAST({n}_lo AS DECIMAL(28,0))) AS DECIMAL(38,0))"
    return found.agg(*[F.expr(f"coalesce({total(n)}, 0)").alias(n) for n in names])


def with_intervals(sums: DataFrame, by: list[str], statistics: dict[str, str], coverage: float = COVERAGE, decimals: int = 6) -> DataFrame:
    """Each statistic of the sums with its percentile interval: name, name_low, name_high.

    A replicate in which a statistic is undefined (no case of a kind) is left out of its interval. The replicates of a group
    are as many rows as ``resampled`` was asked for, so exact percentiles are taken.
    """
    known = sums.selectExpr(*by, "replicate", *[f"{e} AS {n}" for n, e in statistics.items()])
    tail = (1 - coverage) / 2
    found = []
    for name in statistics:
        found.append(F.round(F.max(F.when(F.col("replicate") == 0, F.col(name))), decimals).alias(name))
        drawn = F.when(F.col("replicate") > 0, F.col(name))
        found.append(F.round(F.percentile(drawn, tail), decimals).alias(f"{name}_low"))
        found.append(F.round(F.percentile(drawn, 1 - tail), decimals).alias(f"{name}_high"))
    return known.groupBy(*by).agg(*found)


def ratio(over: str, under: str, scale: int = 1) -> str:
    """A quotient of two sums as a double, null where there is nothing to divide by."""
    return f"CAST({over} AS DOUBLE) / nullif(CAST({under} AS DOUBLE) * {scale}, 0D)"


# Scores have four decimals: ten-thousandths are whole numbers.
SCORE_SUMS = {
    "n_correct": "kind = 'correct' AND tc IS NOT NULL",
    "t_correct": "IF(kind = 'correct', round(tc * 10000), 0)",
    "n_broken": "kind = 'broken' AND tc IS NOT NULL",
    "t_broken": "IF(kind = 'broken', round(tc * 10000), 0)",
    "n_cases": "kind = 'broken'",
}
PAIR_SUMS = {
    "n": "1",
    "x": "round(tc_a * 10000)",
    "y": "round(tc_b * 10000)",
    "xx": "round(tc_a * 10000) * round(tc_a * 10000)",
    "yy": "round(tc_b * 10000) * round(tc_b * 10000)",
    "xy": "round(tc_a * 10000) * round(tc_b * 10000)",
}


def _moment(n: str, products: str, x: str, y: str) -> str:
    return f"CAST({n} * {products} - {x} * {y} AS DOUBLE)"


PEARSON = (
    f"{_moment('n', 'xy', 'x', 'y')} / nullif(sqrt({_moment('n', 'xx', 'x', 'x')}) * sqrt({_moment('n', 'yy', 'y', 'y')}), 0D)"
)


def judge_intervals(scores: DataFrame, by: list[str], false_pass: float, replicates: int = REPLICATES) -> DataFrame:
    """Gap between correct and broken cases and the share of broken cases that pass, with intervals."""
    sums = SCORE_SUMS | {"n_passed": f"kind = 'broken' AND tc >= {false_pass}"}
    counted = resampled(scores, by, "call_id", sums, replicates)
    gap = f"{ratio('t_correct', 'n_correct', 10000)} - {ratio('t_broken', 'n_broken', 10000)}"
    return with_intervals(counted, by, {"gap": gap, "false_pass": ratio("n_passed", "n_cases")})


def agreement_intervals(both: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Pearson correlation of two judges over the cases both scored, with its interval."""
    return with_intervals(resampled(both, [], "call_id", PAIR_SUMS, replicates), [], {"pearson": PEARSON})
