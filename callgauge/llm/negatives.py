"""Hard negatives of anchors: exact integer scores by Strassen products of tiles, kept in mergeable heaps.

Anchors and candidates are dealt by a hash of the whole row into a grid: a cell holds one part of the anchors and one of
the candidates, of sizes that do not grow with the tables, and the grid is about as wide as it is high in rows moved. A
cell multiplies anchor by candidate tiles with Strassen's recursion on int64 (odd sizes are padded with zeros; sums and
differences of integers are exact) and keeps, tile after tile, for each anchor a heap of its best rows of its own label,
or, for each positive, a heap of the best rows of other labels inside the positive's window. Heaps of cells are merged
by a ranking window over their few rows, which Spark cuts to the same size before its shuffle.

Positives come first, in one pass over the grid; their scores set the windows of the second pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgauge.llm.common import written

SCALE = 256
ANCHORS_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
LOWEST_PERCENT, HIGHEST_PERCENT = 30, 90
LABELS = 10
# Rows of a cell, and of a tile inside it.
CELL_ANCHORS, CELL_CANDIDATES = 8192, 32768
TILE_ANCHORS, TILE_CANDIDATES = 256, 4096
STRASSEN_LEAF = 16

POSITIVE = "anchor long, anchor_id long, positive_id long, positive_score long"
NEGATIVE = "anchor long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = STRASSEN_LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2**64 as all int64 arithmetic, so exact wherever the true value fits."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, o = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :o], b[:j, o:], b[j:, :o], b[j:, o:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * o), dtype=np.int64)
    out[:i, :o] = p1 + p4 - p5 + p7
    out[:i, o:] = p3 + p5
    out[i:, :o] = p2 + p4
    out[i:, o:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best ``size`` (score, id) of each of ``count`` owners, best first: higher scores, then smaller ids. Merging is associative."""

    def __init__(self, count: int, size: int):
        self.size = size
        self.owner = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.int64)
        self.id = np.empty(0, dtype=np.int64)
        self.count = count

    def merge(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, ids = np.append(self.owner, owner), np.append(self.score, score), np.append(self.id, ids)
        # ~x reverses the order of int64 without an overflow.
        order = np.lexsort((ids, ~score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        first = np.searchsorted(owner, np.arange(self.count))
        keep = np.arange(len(owner)) - first[owner] < self.size
        self.owner, self.score, self.id = owner[keep], score[keep], ids[keep]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones padded with zeros."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _width(*tables: pa.Table) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for t in tables for c in t.column("vector").chunks), default=0)


def _sides(anchors: pa.Table, candidates: pa.Table):
    """Candidates by id, then anchors by label; each as label, id, matrix."""
    width = _width(anchors, candidates)
    candidates = candidates.sort_by([("vec_id", "ascending")])
    return (_matrix(anchors.column("vector"), width), anchors.column("label").to_numpy(), anchors.column("vec_id").to_numpy()), (
        _matrix(candidates.column("vector"), width),
        candidates.column("label").to_numpy(),
        candidates.column("vec_id").to_numpy(),
    )


def _positives(size: int):
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        heaps = Heaps(len(anchors), size)
        if len(anchors) and len(candidates):
            (left, own, own_id), (right, label, ids) = _sides(anchors, candidates)
            for one in np.intersect1d(own, label):
                mine, theirs = np.flatnonzero(own == one), np.flatnonzero(label == one)
                for a in range(0, len(mine), TILE_ANCHORS):
                    rows = mine[a : a + TILE_ANCHORS]
                    for b in range(0, len(theirs), TILE_CANDIDATES):
                        tile = theirs[b : b + TILE_CANDIDATES]
                        scores = strassen(left[rows], right[tile].T)
                        others = own_id[rows][:, None] != ids[tile][None, :]
                        order = np.lexsort((np.broadcast_to(ids[tile], scores.shape), ~scores, ~others), axis=1)[:, :size]
                        i, j = np.repeat(np.arange(len(rows)), order.shape[1]), order.ravel()
                        real = others[i, j]
                        i, j = i[real], j[real]
                        heaps.merge(rows[i], scores[i, j], ids[tile][j])
        return pa.table(
            {
                "anchor": anchors.column("anchor").to_numpy()[heaps.owner],
                "anchor_id": anchors.column("vec_id").to_numpy()[heaps.owner],
                "positive_id": heaps.id,
                "positive_score": heaps.score,
            }
        )

    return cell


def _negatives(size: int, lowest: int, highest: int):
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        # A row of anchors holds one anchor with all its positives.
        pairs = anchors.column("positives").combine_chunks()
        if isinstance(pairs, pa.ChunkedArray):
            pairs = pa.concat_arrays(pairs.chunks) if pairs.num_chunks else pa.array([], type=pairs.type)
        bounds = pairs.offsets.to_numpy().astype(np.int64)
        bounds = bounds - (bounds[0] if len(bounds) else 0)
        flat = pairs.flatten()
        positive_id = flat.field("positive_id").to_numpy(zero_copy_only=False)
        score = flat.field("positive_score").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(anchors)), np.diff(bounds))
        floor, roof = -((-lowest * score) // 100), (highest * score) // 100
        heaps = Heaps(len(score), size)
        if len(score) and len(candidates):
            (left, own, _), (right, label, ids) = _sides(anchors, candidates)
            for a in range(0, len(left), TILE_ANCHORS):
                rows = np.arange(a, min(a + TILE_ANCHORS, len(left)))
                for b in range(0, len(right), TILE_CANDIDATES):
                    tile = slice(b, b + TILE_CANDIDATES)
                    scores = strassen(left[rows], right[tile].T)
                    own_heaps, own_scores, own_ids = [], [], []
                    for i, row in enumerate(rows.tolist()):
                        other = np.flatnonzero(label[tile] != own[row])
                        falling = np.argsort(~scores[i, other], kind="stable")  # equal scores stay by id
                        other = other[falling]
                        low_to_high = ~scores[i, other]
                        for pair in range(bounds[row], bounds[row + 1]):
                            begin, end = np.searchsorted(low_to_high, ~roof[pair]), np.searchsorted(low_to_high, ~floor[pair], side="right")
                            taken = other[begin : min(end, begin + size)]
                            own_heaps.append(np.full(len(taken), pair))
                            own_scores.append(scores[i, taken])
                            own_ids.append(ids[tile][taken])
                    if own_heaps:
                        heaps.merge(np.concatenate(own_heaps), np.concatenate(own_scores), np.concatenate(own_ids))
        who = owner[heaps.owner]
        return pa.table(
            {
                "anchor": anchors.column("anchor").to_numpy()[who],
                "anchor_id": anchors.column("vec_id").to_numpy()[who],
                "positive_id": positive_id[heaps.owner],
                "positive_score": score[heaps.owner],
                "negative_id": heaps.id,
                "negative_score": heaps.score,
            }
        )

    return cell


def _part(frame: DataFrame, parts: int):
    return F.pmod(F.xxhash64(F.lit(parts), "row"), F.lit(parts)).cast("int")


def _grid(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_candidates: int):
    """Both sides copied to the cells (a, b) of the grid, grouped by cell."""
    high = max(1, -(-n_anchors // CELL_ANCHORS))
    wide = max(1, -(-n_candidates // CELL_CANDIDATES), -(-candidates.sparkSession.sparkContext.defaultParallelism // high))
    left = anchors.withColumn("a", _part(anchors, high)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    candidates = candidates.toDF(*candidates.columns)  # columns of its own beside those of the anchors
    right = candidates.withColumn("b", _part(candidates, wide)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))


def _best(rows: DataFrame, owner: list[str], score: str, key: str, size: int) -> DataFrame:
    """``rows`` with their ``rank`` (from 1) among those of their owner, the first ``size``."""
    window = Window.partitionBy(*owner).orderBy(F.col(score).desc(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= size)


def mine(
    vectors: DataFrame,
    anchors: str = f"vec_id % {ANCHORS_EVERY} = 0",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = (LOWEST_PERCENT, HIGHEST_PERCENT),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (vec_id, label, vector: integers).

    ``anchors`` is a condition on vec_id. An anchor's positives are its best other rows of its label; the negatives of
    a positive are the best rows of other labels whose score is between the two percentages of the positive's. Ties
    go to the smaller vec_id.

    Rows with a null id, label, vector or component take no part. Shorter vectors count as continued by zeros. Rows equal
    in all three columns count once; rows that share only their id are different rows, but never positives of each
    other. An anchor without positives, or a positive without negatives, gives no rows, nor does an empty table. A score
    times 100 has to fit into 64 bits: a larger component is an error, not a wrong result.
    """
    usable = "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)"
    bound = "exists(vector, x -> x NOT BETWEEN -sqrt(92233720368547758D / size(vector)) AND sqrt(92233720368547758D / size(vector)))"
    fits = F.when(F.expr(bound), F.raise_error(F.lit("components too large for scores of 64 bits"))).otherwise(F.col("vector"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"))
    rows = rows.filter(usable).withColumn("vector", fits).distinct()
    rows = written(rows.withColumn("row", F.xxhash64("vec_id", "label", "vector")), "mined-vectors")
    chosen = rows.filter(anchors).withColumn("anchor", F.xxhash64("row", "vec_id"))
    n_rows, n_anchors = rows.count(), chosen.count()
    near = _grid(chosen, rows, n_anchors, n_rows).applyInArrow(_positives(positives), POSITIVE)
    near = written(_best(near, ["anchor"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    pairs = near.groupBy("anchor").agg(F.array_distinct(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))
    far = _grid(chosen.join(pairs, "anchor"), rows, n_anchors, n_rows).applyInArrow(_negatives(negatives, *window), NEGATIVE)
    ranked = _best(far, ["anchor", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def prepared_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of ``embeddings`` (vec_id, embedding, label): every seventh id gets the next label, components are scaled and rounded down.

    A vector with a null or non-finite component becomes null.
    """
    double = F.col("embedding").cast("array<double>")
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform(double, lambda x: F.floor(x * SCALE))
    return embeddings.select("vec_id", label.alias("label"), F.when(finite, whole).alias("vector"))


def report(embeddings: DataFrame) -> DataFrame:
    return mine(prepared_vectors(embeddings))
