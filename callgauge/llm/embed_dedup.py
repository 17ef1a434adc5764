"""Near-duplicate embeddings: every pair at or above a cosine, found by PCA-ordered tiles.

Vectors are turned to principal axes and dealt into tiles by quantiles along the first two, so a tile is compact and of
bounded size. Two tiles meet unless their boxes along the leading axes are further apart than any link can be. Within
a pair of tiles the products of the leading axes are accumulated first; the rest of a product is at most the product of
the remaining norms, and a pair whose bound stays below the threshold is dropped. What survives all steps is decided by
the cosine in double precision.

Equal vectors are one class with a count. A pair of tiles gives, for each vector, its number of links and one edge to
the smallest vector of its linked set, never the list of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import written
from callgauge.llm.components import components

THRESHOLD = 0.95
TILE_ROWS = 4096
LEADING_AXES = 8
STEPS = (16, 32, 48)
SLACK = 1e-4
BLOCK = 512


def _matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), dtype=np.float64)


def _units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors; scaling by the largest component first keeps very large and very small ones exact."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their class keys (vec_id, n_dims, k1, k2), and the classes (rep, n, n_dims, embedding) of usable vectors.

    The keys are null for vectors that link with nothing: null, empty, all zero, or with null or non-finite components.
    """
    vector = F.col("embedding").cast("array<double>")
    usable = F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
        & F.col("vec_id").isNotNull(),
        F.lit(False),
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, vector).alias("embedding"))
    keyed = rows.select(
        "vec_id",
        "embedding",
        F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")).alias("k1"),
        F.when(F.col("embedding").isNotNull(), F.hash("embedding")).alias("k2"),
    )
    grouped = keyed.filter("embedding IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("embedding").alias("embedding")
    )
    return keyed.drop("embedding"), grouped.withColumn("n_dims", F.size("embedding"))


def _axes(rows: DataFrame, n_dims: int) -> np.ndarray:
    """Principal axes, the strongest first, from second moments summed over all vectors (n_dims squared numbers)."""

    def moments(parts):
        total = np.zeros((n_dims, n_dims))
        for part in parts:
            if len(part):
                unit = _units(_matrix(part["embedding"]))
                total += unit.T @ unit
        yield pd.DataFrame({"cell": np.arange(n_dims * n_dims), "value": total.ravel()})

    cells = rows.select("embedding").mapInPandas(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    matrix = np.zeros(n_dims * n_dims)
    for cell, value in cells.collect():
        matrix[cell] = value
    values, axes = np.linalg.eigh(matrix.reshape(n_dims, n_dims))
    return np.ascontiguousarray(axes[:, np.argsort(-values)])


def _linked(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float):
    """Yield index arrays (i, j) of the pairs with cosine >= threshold, block by block."""
    unit_l, unit_r = _units(left), _units(right)
    turned_l, turned_r = unit_l @ axes, unit_r @ axes
    n_dims = left.shape[1]
    steps = [s for s in STEPS if s < n_dims] + [n_dims]
    rest_l = [np.sqrt(np.maximum(0, (turned_l[:, s:] ** 2).sum(axis=1))).astype(np.float32) for s in steps]
    rest_r = [np.sqrt(np.maximum(0, (turned_r[:, s:] ** 2).sum(axis=1))).astype(np.float32) for s in steps]
    first_l, first_r = turned_l[:, : steps[0]].astype(np.float32), turned_r[:, : steps[0]].astype(np.float32)
    floor = threshold - SLACK
    for begin in range(0, len(left), BLOCK):
        block = slice(begin, begin + BLOCK)
        bound = first_l[block] @ first_r.T
        bound += np.outer(rest_l[0][block], rest_r[0])
        i, j = np.nonzero(bound >= floor)
        if len(i) > 0.05 * bound.size:  # many survive: one product of whole vectors is cheaper than pair by pair
            i, j = np.nonzero(unit_l[block] @ unit_r.T >= threshold)
            yield i + begin, j
            continue
        i += begin
        product = np.zeros(len(i))
        done = 0
        for step, rl, rr in zip(steps, rest_l, rest_r, strict=True):
            product += np.einsum("nd,nd->n", turned_l[i, done:step], turned_r[j, done:step])
            keep = product + rl[i].astype(float) * rr[j] >= floor
            i, j, product, done = i[keep], j[keep], product[keep], step
        cosine = np.einsum("nd,nd->n", unit_l[i], unit_r[j])
        keep = cosine >= threshold
        yield i[keep], j[keep]


def _smallest_reached(size: int, pairs: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest id it reaches by the pairs."""
    label = ids.copy()
    while True:
        old = label.copy()
        for a, b in pairs:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        if (label == old).all():
            return label


def _compare(axes: np.ndarray, threshold: float):
    def task(part: pd.DataFrame) -> pd.DataFrame:
        a, b = int(part["a"].iloc[0]), int(part["b"].iloc[0])
        left = part[part["tile"] == a]
        right = left if a == b else part[part["tile"] == b]
        ids_l, ids_r = left["rep"].to_numpy(), right["rep"].to_numpy()
        n_l, n_r = left["n"].to_numpy(), right["n"].to_numpy()
        count_l, count_r = np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
        pairs = []
        for i, j in _linked(_matrix(left["embedding"]), _matrix(right["embedding"]), axes, threshold):
            if a == b:
                other = i != j
                i, j = i[other], j[other]
            count_l += np.bincount(i, weights=n_r[j], minlength=len(left)).astype(np.int64)
            if a != b:
                count_r += np.bincount(j, weights=n_l[i], minlength=len(right)).astype(np.int64)
                j = j + len(left)
            pairs.append((i, j))
        ids, counts = (ids_l, count_l) if a == b else (np.concatenate([ids_l, ids_r]), np.concatenate([count_l, count_r]))
        low = _smallest_reached(len(ids), pairs, ids)
        some = counts > 0
        return pd.DataFrame({"rep": ids[some], "links": counts[some], "low": low[some]})

    return task


def _tiles(rows: DataFrame, axes: np.ndarray) -> DataFrame:
    """Deal vectors into tiles of about ``TILE_ROWS`` by quantiles along two axes; adds slab, tile and the leading coordinates."""

    def turn(parts):
        for part in parts:
            if len(part):
                lead = _units(_matrix(part["embedding"])) @ axes[:, :LEADING_AXES]
                yield part.assign(lead=list(lead))

    placed = rows.select("rep", "n", "embedding").mapInPandas(turn, "rep long, n long, embedding array<double>, lead array<double>")
    placed = written(placed, "turned")
    count = placed.count()
    slabs = max(1, math.ceil(math.sqrt(count / TILE_ROWS)))
    if slabs == 1:
        return placed.withColumn("tile", F.lit(0).cast("long"))
    cuts = [i / slabs for i in range(1, slabs)]
    second = F.get("lead", F.lit(1)) if axes.shape[1] > 1 else F.lit(0.0)
    edges = placed.agg(F.percentile_approx(F.col("lead")[0], cuts, 100 * slabs)).first()[0]
    slab = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("lead")[0]))
    placed = placed.withColumn("slab", slab)
    inner = placed.groupBy("slab").agg(F.percentile_approx(second, cuts, 100 * slabs).alias("cuts"))  # one row for each slab
    return placed.join(inner, "slab").withColumn("tile", (F.col("slab") * slabs + F.size(F.filter("cuts", lambda e: e < second))).cast("long")).drop("cuts", "slab")


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a <= b, of tiles whose boxes are near enough. Tiles meet by cells along the first axis."""
    reach = math.sqrt(2 - 2 * threshold) + SLACK
    box = tiles.groupBy("tile").agg(*[f(F.get("lead", F.lit(i))).alias(f"{name}{i}") for i in range(LEADING_AXES) for name, f in (("lo", F.min), ("hi", F.max))])
    box = written(box, "boxes")
    cell = lambda x: F.floor(x / reach)
    left = box.withColumn("cell", F.explode(F.sequence(cell(F.col("lo0")), cell(F.col("hi0"))))).alias("l")
    right = box.withColumn("cell", F.explode(F.sequence(cell(F.col("lo0") - reach), cell(F.col("hi0") + reach)))).alias("r")
    apart = F.lit(0.0)
    for i in range(LEADING_AXES):
        gap = F.greatest(F.lit(0.0), F.col(f"l.lo{i}") - F.col(f"r.hi{i}"), F.col(f"r.lo{i}") - F.col(f"l.hi{i}"))
        apart = apart + F.coalesce(gap * gap, F.lit(0.0))
    met = left.join(right, F.col("l.cell") == F.col("r.cell")).filter((F.col("l.tile") <= F.col("r.tile")) & (apart <= reach * reach))
    return met.select(F.col("l.tile").alias("a"), F.col("r.tile").alias("b")).distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing
    (component_id is then the row's own id, kept is true). Vectors of different lengths do not link. Repeated rows count as
    vectors of their own with one id. An empty table gives no rows.
    """
    keyed, found = classes(vectors)
    found = written(found, "vector-classes")
    results = None
    for (n_dims,) in found.select("n_dims").distinct().collect():
        own = found.filter(F.col("n_dims") == n_dims)
        axes = _axes(own, n_dims)
        tiles = written(_tiles(own, axes), "tiles")
        pairs = _tile_pairs(tiles, threshold)
        sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
        met = sides.join(tiles.drop("lead"), "tile").groupBy("a", "b").applyInPandas(_compare(axes, threshold), "rep long, links long, low long")
        results = met if results is None else results.union(met)
    if results is None:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    results = written(results, "tile-links")
    counts = results.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(results.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    per_class = found.select("k1", "k2", "rep", "n").join(counts, "rep", "left").join(joined, "rep", "left")
    per_class = per_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    per_class = written(per_class, "class-results")
    out = keyed.join(per_class, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
