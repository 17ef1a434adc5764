"""Periodic runs of words by suffix-tree extensions from Lyndon roots, and texts with the repeats taken out.

A run is a stretch of words with smallest period q (words q apart are equal) and length at least ``max(LEAST_WORDS,
LEAST_TIMES * q)`` that no neighbouring word extends. For each of the two orders of the words (as numbered, and
reversed) the longest Lyndon word at every position is a candidate root; every run has such a root among them. Ukkonen
suffix trees of the words and of their reversal answer how far a candidate extends: a longest common extension is the
depth of a lowest common ancestor, which is a range minimum over the Euler tour. All extensions of a stretch are asked at
once, so the minima are worked out level by level and only one level is held.

Trees are built for the stretches that can hold a run: each three neighbouring words of a run stand in it at least three
times, so other places are cut away first. This loses no run and adds none.

Work is by row: a document's words are held by one task, nothing else is.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6
LEAST_TIMES = 4
FILTER_ROUNDS = 8
OUT_CHARS = 4_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

Words = list[bytes]


def words(text: str | None) -> Words:
    """The words of a text: its stretches without a blank or a control character from tab to carriage return."""
    return text.encode().split() if text else []


class SuffixTree:
    """Ukkonen's tree of a sequence of numbers from 1; a 0 is appended as its end."""

    def __init__(self, sequence: list[int]):
        signs = [*sequence, 0]
        size = len(signs)
        base = max(signs) + 1
        start, end, link, edges, leaves = [0], [0], [0], {}, []
        node = at = length = rest = 0
        for i, sign in enumerate(signs):
            open_link = 0
            rest += 1
            while rest:
                if not length:
                    at = i
                key = node * base + signs[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    if open_link:
                        link[open_link] = node
                    open_link = node
                else:
                    first = start[child]
                    span = min(end[child], i + 1) - first
                    if length >= span:
                        at += span
                        length -= span
                        node = child
                        continue
                    if signs[first + length] == sign:
                        length += 1
                        if open_link:
                            link[open_link] = node
                        break
                    split = len(start)
                    middle = first + length
                    start += (first, i)
                    end += (middle, size)
                    link += (0, 0)
                    leaves.append(split + 1)
                    edges[key] = split
                    edges[split * base + sign] = split + 1
                    edges[split * base + signs[middle]] = child
                    start[child] = middle
                    if open_link:
                        link[open_link] = split
                    open_link = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - rest + 1
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        kids = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
        order = np.argsort(keys)  # by parent, then by first number
        keys, kids = keys[order], kids[order]
        bounds = np.searchsorted(keys // base, np.arange(len(start) + 1)).tolist()
        kids = kids.tolist()
        self.size = size
        self.leaves = np.array(leaves)
        self.children = [kids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.span = (np.array(end) - np.array(start)).tolist()
        # The end (number 0) is the first child of its parent.
        self.ends = set(leaves[-1:]) | {int(k) for k in np.array(kids)[keys % base == 0]}
        self._tour()

    def _tour(self) -> None:
        """Euler tour as depths, and where each leaf stands in it."""
        depth, seen, tour = [0] * len(self.span), [0] * len(self.span), []
        children, span, stack = self.children, self.span, [0]
        while stack:
            node = stack.pop()
            if node < 0:
                tour.append(depth[~node])
                continue
            kids = children[node]
            own = depth[node]
            seen[node] = len(tour)
            tour.append(own)
            if kids:
                for kid in reversed(kids):
                    depth[kid] = own + span[kid]
                    stack += (kid, ~node)
                stack.pop()
        self.tour = np.array(tour)
        self.first = np.array(seen)[self.leaves]

    def ranks(self, reversed_order: bool = False) -> list[int]:
        """The rank of each suffix; a suffix that another one begins with comes first in both orders."""
        if not reversed_order:
            ranks = np.empty(self.size, dtype=np.int64)
            ranks[np.argsort(self.first)] = np.arange(self.size)
            return ranks.tolist()
        place, children, ends, stack, found = {}, self.children, self.ends, [0], 0
        while stack:
            node = stack.pop()
            kids = children[node]
            if not kids:
                place[node] = found
                found += 1
            elif kids[0] in ends:
                stack += kids[1:]
                stack.append(kids[0])
            else:
                stack += kids
        return [place[leaf] for leaf in self.leaves.tolist()]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of suffixes i and j (different ones), for many pairs at once."""
        low, high = np.minimum(self.first[i], self.first[j]), np.maximum(self.first[i], self.first[j]) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        minima, width = self.tour, 1
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                minima = np.minimum(minima[:-width], minima[width:])
                width *= 2
            mine = level == k
            out[mine] = np.minimum(minima[low[mine]], minima[high[mine] - width])
        return out


def lyndon_lengths(ranks: list[int]) -> np.ndarray:
    """The length of the longest Lyndon word at each position: the next smaller suffix begins behind it."""
    size = len(ranks)
    after = [size] * size
    for i in range(size - 2, -1, -1):
        own, j = ranks[i], i + 1
        while ranks[j] > own:
            j = after[j]
        after[i] = j
    return (np.array(after) - np.arange(size))[:-1]


def stretch_runs(sequence: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs of one stretch of numbers from 0, in no order."""
    size = len(sequence)
    none = np.empty((0, 3), dtype=np.int64)
    _, dense = np.unique(sequence, return_inverse=True)
    listed = (dense + 1).tolist()
    tree = SuffixTree(listed)
    roots = []
    for backward in (False, True):
        period = lyndon_lengths(tree.ranks(backward))
        at = np.flatnonzero(LEAST_TIMES * period <= size)
        roots.append(np.stack([at, period[at]], axis=1))
    at, period = np.unique(np.concatenate(roots), axis=0).T
    right = tree.common(at, at + period)
    # The first root of a run begins in its first period, so at least all but two periods lie to the right of it.
    far = right >= (LEAST_TIMES - 2) * period
    at, period, right = at[far], period[far], right[far]
    if not len(at):
        return none
    left = np.zeros(len(at), dtype=np.int64)
    inner = at > 0
    mirrored = SuffixTree(listed[::-1])
    left[inner] = mirrored.common(size - at[inner], size - at[inner] - period[inner])
    length = left + period + right
    keep = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    return np.unique(np.stack([at - left, length, period], axis=1)[keep], axis=0)


def _stretches(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches outside of which no run can be: in them each three words stand three times at least."""
    n = len(numbers)
    if n < LEAST_WORDS:
        return []
    kinds = int(numbers.max()) + 1
    pairs = numbers[:-1] * kinds + numbers[1:]
    if kinds >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = np.unique(pairs[:-1] * kinds + numbers[2:], return_inverse=True)[1]
    places = np.arange(len(triples))
    part = np.zeros(len(triples), dtype=np.int64)
    for _ in range(FILTER_ROUNDS):
        _, where, times = np.unique(part * len(triples) + triples[places], return_inverse=True, return_counts=True)
        good = times[where] >= 3
        kept = places[good]
        if not len(kept):
            return []
        fresh = np.r_[True, (np.diff(kept) > 1)]
        lengths = np.diff(np.append(np.flatnonzero(fresh), len(kept)))
        long = np.repeat(lengths >= LEAST_WORDS - 2, lengths)
        same = len(kept) == len(places) and long.all()
        places, part = kept[long], (np.cumsum(fresh) - 1)[long]
        if same or not len(places):
            break
    if not len(places):
        return []
    begins = np.flatnonzero(np.r_[True, np.diff(places) > 1])
    ends = np.append(begins[1:], len(places)) - 1
    return list(zip(places[begins].tolist(), (places[ends] + 3).tolist(), strict=True))


def find_runs(text: Words) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words, by start, then period."""
    number = {word: i for i, word in enumerate(dict.fromkeys(text))}
    if len(text) - len(number) < LEAST_WORDS * (LEAST_TIMES - 1) // LEAST_TIMES:
        return []
    numbers = np.fromiter(map(number.__getitem__, text), dtype=np.int64, count=len(text))
    found = []
    for begin, end in _stretches(numbers):
        rows = stretch_runs(numbers[begin:end])
        rows[:, 0] += begin
        found += map(tuple, rows.tolist())
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(text: Words, runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(text)
    change = np.zeros(len(text) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    dropped = np.cumsum(change[:-1]) > 0
    return b" ".join([word for word, gone in zip(text, dropped.tolist(), strict=True) if not gone])


def _output(ids: list, runs: list, texts: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    rows = [[dict(zip(("start", "length", "period"), run, strict=True)) for run in own] for own in runs]
    return pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(rows, type=kind), pa.array(texts, type=pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])


def detect(docs: DataFrame, words_of: Callable[[int | None, str | None], Words] | None = None) -> DataFrame:
    """(doc_id, runs: array of (start, length, period) by start, then period, collapsed: text without the repeats) per row.

    ``words_of`` gives the words of a row from its doc_id and text (default: those of ``words``). A null or empty text has
    no words, no runs and an empty collapsed text; a null doc_id is kept; repeated rows give repeated rows; an empty table
    gives an empty one. Only doc_id and text are read, so further columns of any name do not matter.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs, texts, chars = [], [], [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = key.as_py(), text.as_py()
                own = words(text) if words_of is None else words_of(key, text)
                found = find_runs(own)
                ids.append(key)
                runs.append(found)
                texts.append(collapse(own, found))
                chars += len(texts[-1])
                if chars >= OUT_CHARS:
                    yield _output(ids, runs, texts)
                    ids, runs, texts, chars = [], [], [], 0
            if ids:
                yield _output(ids, runs, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, f"doc_id long, runs {RUNS}, collapsed string")


def with_tails(key: int | None, text: str | None) -> Words:
    """Words of a row; every tenth document by its id's checksum repeats a stretch of its words to its end."""
    own = words(text)
    mixed = None if key is None else zlib.crc32(str(key).encode())
    if mixed is None or mixed % 10 or not own:
        return own
    seed = mixed // 10
    begin = seed % len(own)
    rest = len(own) - begin
    period = 1 + rest // (3 + seed % 8)
    unit = own[begin : begin + period]
    return own[:begin] + (unit * (rest // period + 1))[:rest]


def report(docs: DataFrame) -> DataFrame:
    """Per document: number of runs, the longest one, digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    ranked = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(ranked, F.lit(0))
    length = -F.col("best.shorter")
    return (
        detect(docs, with_tails)
        .withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            F.col("best.start").alias("start"),
            length.alias("length"),
            F.col("best.period").alias("period"),
            F.expr("1000 * -best.shorter DIV best.period").alias("exponent_milli"),
            F.sha2(lines, 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
