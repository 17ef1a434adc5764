"""Jaccard self-join of shingle sets by token-combination prefixes.

Tokens (hashes of five-word shingles) are ordered: rare ones first, then frequent ones, each by hash. A document is indexed
under a prefix of its tokens, singly while they are rare. Frequent tokens are dealt into sub-classes, and the prefix is
extended by one token for each sub-class it touches, so that similar documents must share two tokens of one sub-class:
only such pairs of frequent tokens are indexed. The shorter document of a pair needs a shorter prefix than the longer one.

Why no link is lost: if a set of n tokens must share at least o of them, a prefix may miss n - o. A prefix whose rare
tokens and, for each sub-class, whose tokens beyond the first number n - o + 1 cannot miss them all, whichever of the two
prefixes ends first. With Jaccard at least 4/5, o is 8/9 of the shorter set and 4/5 of the longer one.

Equal sets are one class. A parity sketch (the parity of the number of tokens at each of 512 places) bounds the symmetric
difference of two sets from below, so pairs that differ in more places than similar sets can are dropped inside the joins,
without being emitted; no similar pair is. A wider sketch follows for the
pairs that are left. Candidates are verified on whole sets of 64-bit hashes. Keys of the same classes are one key. Classes that share a
key first meet one leader of the key; what is linked then is one component, and the exact round compares only pairs that are
still apart, each at one of the keys that it shares wherever the widest keys of both classes name one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgauge.llm.arrays import mix, powers
from callgauge.llm.common import small, text_or_empty, written
from callgauge.llm.components import components

WORDS = 5
# Tokens held by at least LEAST_FREQUENT documents are frequent, or by so many that no more than MAX_FREQUENT can be: that
# bounds what is sent to every task (8 bytes each). Counting goes by the first 48 bits of a token, so tokens that share them
# are frequent together.
PREFIX = np.uint64(0xFFFF_FFFF_FFFF_0000)
LEAST_FREQUENT = 32
MAX_FREQUENT = 1 << 21
STAR_ROUNDS = 2
WIDEST_KEYS = 4
PART_CHARS = 1_000_000
HELD_TOKENS = 1_500_000
SHARD_TOKENS = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Each byte's sign in a word's hash; A-Z count as a-z, blanks as nothing.
_SIGNS = mix(np.arange(1, 257, dtype=np.uint64))
_SIGNS[65:91] = _SIGNS[97:123]
_SIGNS[_SPACE] = 0
_BASE = int(powers(2)[1])
_back = np.ones(1, dtype=np.uint64)
_PLACES = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)
# The smallest set sizes of bands; a set at most 5/4 as large as another is at most one band above it.
_BANDS = np.unique(np.ceil(1.25 ** np.arange(0, 130)).astype(np.float64))


def _inverse_powers(n: int) -> np.ndarray:
    global _back
    if len(_back) < n:
        grown = np.full(max(n, 2 * len(_back)), pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        grown[0] = 1
        _back = np.multiply.accumulate(grown)
    return _back[:n]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of one to four words has its whole sequence as one."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(encoded) + b" ", dtype=np.uint8)
    begins = np.cumsum([1, *(len(t) + 1 for t in encoded)])[:-1]
    # Words begin and end where blanks do; their hashes are differences of one running sum, moved to the first power.
    turns = np.flatnonzero(np.diff(_SPACE[data])) + 1
    at, ends = turns[::2], turns[1::2]
    running = np.cumsum(_SIGNS[data] * powers(len(data)))
    words = mix((running[ends - 1] - running[at - 1]) * _inverse_powers(len(data))[at] + mix((ends - at).astype(np.uint64)))
    edges = np.append(np.searchsorted(at, begins), len(words))
    rolled = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
    for j in range(WORDS):
        rolled += words[j : j + len(rolled)] * _PLACES[j]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= WORDS:
            sets.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            sets.append(mix(np.array([(words[a:b] * _PLACES[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def class_key(tokens: np.ndarray) -> int:
    """A 64-bit key of a set; equal sets have equal keys."""
    return int(mix(np.array([mix(tokens).sum() + np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)[0])


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(tokens: np.ndarray) -> bytes:
    """The parity sketch of 8192 places, which tells long sets apart too."""
    return np.packbits((np.bincount((tokens >> np.uint64(51)).astype(np.int64), minlength=8192) & 1).astype(np.uint8)).tobytes()


def long_prefix(n):
    return n - (4 * n + 4) // 5 + 1


def short_prefix(n):
    return n - (8 * n + 8) // 9 + 1


def _sub_classes(band: int) -> int:
    return max(1, int(_BANDS[band] / 10))


def _combined(tokens: np.ndarray, need: int, band: int) -> np.ndarray:
    """Keys of the pairs of frequent tokens (by hash) of one sub-class in the prefix that misses ``need`` tokens."""
    sub = (mix(tokens) % np.uint64(_sub_classes(band))).astype(np.int64)
    order = np.argsort(sub, kind="stable")
    starts = np.r_[True, sub[order][1:] != sub[order][:-1]]
    beyond = np.empty(len(tokens), dtype=bool)
    beyond[order] = ~starts
    end = int(np.searchsorted(np.cumsum(beyond), need)) + 1
    taken, sub = tokens[:end], sub[:end]
    order = np.argsort(sub, kind="stable")
    taken, sub = taken[order], sub[order]
    keys = []
    for step in range(1, end):
        same = sub[step:] == sub[:-step]
        if not same.any():
            break
        keys.append(taken[:-step][same] * np.uint64(3) + mix(taken[step:][same]))
    joined = np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)
    return mix(joined + np.uint64(band + 1))


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and which of them also serve it as the shorter one of a pair. ``tokens`` ascend; ``frequent`` are flags."""
    n = len(tokens)
    if n < 4:  # only an equal set is similar enough
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    need_long, need_short = long_prefix(n), short_prefix(n)
    rare = tokens[~frequent]
    keys, short = [rare[:need_long]], [np.arange(min(need_long, len(rare))) < need_short]
    band = int(np.searchsorted(_BANDS, n, side="right")) - 1
    if len(rare) < need_long:
        usual = tokens[frequent]
        own = _combined(usual, need_long - len(rare), band)
        keys.append(own)
        if len(rare) < need_short:
            first = _combined(usual, need_short - len(rare), band)
            short.append(np.isin(own, first))
            above = _combined(usual, need_short - len(rare), band + 1)
            keys.append(above)
            short.append(np.ones(len(above), dtype=bool))
        else:
            short.append(np.zeros(len(own), dtype=bool))
    return np.concatenate(keys), np.concatenate(short)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) in portions of bounded size."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(key)
            texts.append(text)
            chars += len(text)
            if chars >= PART_CHARS:
                yield ids, shingle_sets(texts)
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, shingle_sets(texts)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


SKETCH = tuple(f"k{i}" for i in range(8))
CLASSES, COUNTS, FREQUENT, POSTINGS, SETS = "doc_id long, n long, c long, " + ", ".join(f"{k} long" for k in SKETCH), "shard int, once binary, more binary, times binary", "token long", "key long, c long, n int, short boolean", "c long, n long, wide binary, tokens binary"


def _classes(batches):
    for ids, sets in _portions(batches):
        yield _batch(CLASSES, ids, [len(s) for s in sets], [class_key(s) for s in sets], *np.array([parity_sketch(s) for s in sets]).T)


def _sets(batches):
    seen = set()  # classes this task has given: equal texts are one set
    for _, sets in _portions(batches):
        fresh = {class_key(s): s for s in sets if len(s)}
        fresh = {c: s for c, s in fresh.items() if c not in seen}
        seen.update(fresh)
        yield _batch(SETS, list(fresh), [len(s) for s in fresh.values()], [wide_sketch(s) for s in fresh.values()], [s.tobytes() for s in fresh.values()])


def _packed(prefixes: np.ndarray) -> bytes:
    """Ascending prefixes as one number and the steps between them, of four bytes each if they fit."""
    if not len(prefixes):
        return b""
    values = prefixes >> np.uint64(16)
    steps = np.diff(values)
    kind = np.uint32 if int(steps.max(initial=0)) < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + values[:1].tobytes() + steps.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=np.uint64)
    steps = np.frombuffer(data[9:], dtype=np.uint32 if data[0] == 4 else np.uint64)
    return np.cumsum(np.append(np.frombuffer(data[1:9], dtype=np.uint64), steps.astype(np.uint64)), dtype=np.uint64) << np.uint64(16)


def _frequent_tokens(rows: DataFrame, total: int) -> np.ndarray:
    """Prefixes (see ``PREFIX``) of the frequent ones tokens of all documents; sorted, at most ``MAX_FREQUENT``."""
    shards = max(8, -(-total // SHARD_TOKENS))
    least = max(LEAST_FREQUENT, -(-total // MAX_FREQUENT))

    def flush(held):
        tokens, times = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(tokens, (np.arange(1, shards) * (2**64 // shards)).astype(np.uint64)) if shards > 1 else np.empty(0, dtype=int)
        parts = [(n, t[k == 1], t[k > 1], k[k > 1].astype(np.int64)) for n, (t, k) in enumerate(zip(np.split(tokens, edges), np.split(times, edges), strict=True)) if len(t)]
        return _batch(COUNTS, [p[0] for p in parts], *[[_packed(p[i]) for p in parts] for i in (1, 2)], [p[3].tobytes() for p in parts])

    def count(batches):
        held, size = [], 0
        for _, sets in _portions(batches):
            for tokens in sets:
                held.append(tokens & PREFIX)
                size += len(tokens)
            if size >= HELD_TOKENS:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def add(part: pa.Table) -> pa.Table:
        once, more = (np.concatenate([_unpacked(x) for x in part.column(c).to_pylist()]) for c in ("once", "more"))
        times = np.frombuffer(b"".join(part.column("times").to_pylist()), dtype=np.int64)
        tokens = np.concatenate([once, more])
        weights = np.concatenate([np.ones(len(once), dtype=np.int64), times])
        order = np.argsort(tokens)
        tokens, weights = tokens[order], weights[order]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, dtype=int)
        sums = np.add.reduceat(weights, starts) if len(starts) else np.empty(0)
        return pa.table({"token": pa.array(tokens[starts][sums >= least].view(np.int64), type=pa.int64())})

    found = rows.mapInArrow(count, COUNTS).groupBy("shard").applyInArrow(add, FREQUENT)
    return np.sort(found.toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))


def _postings(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def index(batches):
        usual = sent.value
        for _, sets in _portions(batches):
            joined = np.concatenate(sets) & PREFIX
            place = np.searchsorted(usual, joined)
            flags = np.zeros(len(joined), dtype=bool)
            if len(usual):
                flags = usual[np.minimum(place, len(usual) - 1)] == joined
            keys, classes, sizes, short, at = [], [], [], [], 0
            for tokens in sets:
                own, serves = signatures(tokens, flags[at : at + len(tokens)])
                at += len(tokens)
                if len(own):
                    keys.append(own)
                    short.append(serves)
                    classes.append(np.full(len(own), class_key(tokens), dtype=np.int64))
                    sizes.append(np.full(len(own), len(tokens), dtype=np.int32))
            if keys:
                yield _batch(POSTINGS, np.concatenate(keys).view(np.int64), np.concatenate(classes), np.concatenate(sizes), np.concatenate(short))

    return rows.mapInArrow(index, POSTINGS)


def _verified(pairs: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose sets are similar. Sets are made anew for the classes that occur, from one document each."""
    classes = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = written(reps.join(classes, "c").select("doc_id"), "candidate-docs")
    # Texts stay where they are while the ids are few enough to be sent to them.
    sets = written(rows.join(small(wanted), "doc_id", "left_semi").mapInArrow(_sets, SETS), "candidate-sets")

    def alike(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(-1, 128) for i in (3, 5))
            odd = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            keep = 9 * odd <= batch.column(2).to_numpy() + batch.column(4).to_numpy()
            yield _batch("a long, b long", batch.column(0).to_numpy()[keep], batch.column(1).to_numpy()[keep])

    # Wide sketches first: whole sets travel only for pairs that are nearly sure to be similar.
    told = pairs.join(sets.select(F.col("c").alias("a"), "n", "wide"), "a").join(sets.selectExpr("c AS b", "n AS n2", "wide AS wide2"), "b")
    pairs = written(told.select("a", "b", "n", "wide", "n2", "wide2").mapInArrow(alike, "a long, b long").distinct(), "likely-pairs")
    likely = small(written(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "likely-classes"))
    whole = sets.join(likely, "c", "left_semi").select("c", "tokens")
    left, right = whole.toDF("a", "left"), whole.toDF("b", "right")

    def similar(batches):
        for batch in batches:
            keep_a, keep_b = [], []
            for a, b, left, right in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                left, right = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
                place = np.minimum(np.searchsorted(right, left), len(right) - 1)
                both = int((right[place] == left).sum())
                if 100 * both >= 80 * (len(left) + len(right) - both):
                    keep_a.append(a)
                    keep_b.append(b)
            yield _batch("a long, b long", keep_a, keep_b)

    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(similar, "a long, b long"), "links")


_NEAR = "4 * greatest(n, n2) <= 5 * least(n, n2)"
# Similar sets differ in at most a ninth of their sizes' sum.
_ALIKE = "9 * (" + " + ".join(f"bit_count({k} ^ {k}_2)" for k in SKETCH) + ") <= n + n2"


def _with_component(postings: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return postings.withColumn("comp", F.col("c"))
    found = components(links).select(F.col("node").alias("c"), F.col("component").alias("found"))
    return postings.join(written(found, "found"), "c", "left").withColumn("comp", F.coalesce("found", "c")).drop("found")


def _second(frame: DataFrame, *columns: str) -> DataFrame:
    """The other side of a self-join: ``columns`` get a 2."""
    return frame.withColumnsRenamed({c: c + ("2" if c in ("c", "n", "comp") else "_2") for c in columns})


def _merged(postings: DataFrame) -> DataFrame:
    """(key, m, c, n, short, keys): keys of the same ``m`` classes become the smallest of them, which counts them in ``keys``.

    Any two classes share the merged key if they share one of its keys, and it serves wherever one of them does.
    """
    ends = Window.partitionBy("key")
    sets = {"s": F.bit_xor(F.xxhash64("c")).over(ends), "s2": F.bit_xor(F.xxhash64(F.lit(1), "c")).over(ends), "m": F.count("*").over(ends)}
    merged = postings.withColumns(sets).groupBy("s", "s2", "m", "c", "n")
    return merged.agg(F.min("key").alias("key"), F.max("short").alias("short"), F.count("*").alias("keys")).drop("s", "s2")


def _apart(placed: DataFrame, sketches: DataFrame) -> DataFrame:
    """(c, c2) of classes of different components that share a key and may be similar.

    A pair comes at one key only where both classes have a common one among the ``WIDEST_KEYS`` keys that most classes share
    and that serve them as the shorter of a pair: it is sure to be met at that key, so that the others are not needed.
    """
    crowd = placed.groupBy("key", "comp").agg(F.count("*").alias("held")).groupBy("key").agg(F.max(F.struct("held", "comp")).alias("main"), F.count("*").alias("comps"))
    crowd = crowd.filter("comps > 1").select("key", F.col("main.comp").alias("main"))
    shared = written(placed.join(crowd, "key"), "shared-apart")
    widest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "key"))), 1, WIDEST_KEYS)
    named = shared.filter("short").groupBy("c").agg(widest["key"].alias("widest"))
    opened = written(shared.select("key", "c", "short", "comp", "main").join(sketches.join(named, "c", "left"), "c"), "opened")
    few = opened.filter("comp <> main")
    other = _second(opened.drop("main"), "c", "n", "short", "comp", "widest", *SKETCH)
    serves = "(n < n2 AND short) OR (n2 < n AND short_2) OR (n = n2 AND (short OR short_2))"
    here = "coalesce(key = array_min(array_intersect(widest, widest_2)), true)"
    met = few.join(other, "key").filter(f"comp <> comp2 AND (comp2 = main OR c < c2) AND {_NEAR} AND ({serves}) AND {_ALIKE} AND {here}")
    return met.select("c", "c2")


def links_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n, c; links: a, b). Links join classes, and connect every two classes that similar pairs connect."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    documents = written(rows.mapInArrow(_classes, CLASSES), "set-classes")
    reps = documents.filter("n >= 4").groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    sketches = documents.filter("n >= 4").groupBy("c").agg(F.first("n").alias("n"), *[F.first(k).alias(k) for k in SKETCH])
    total = documents.agg(F.sum("n")).first()[0] or 0
    if not total:
        return documents, documents.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0)
    index = _postings(rows.filter("doc_id IS NOT NULL"), _frequent_tokens(rows, total))
    # Dealt by key once: a key of several classes is seen, and its postings taken, where they are. The window's rows spill.
    ends = Window.partitionBy("key")
    shared = index.withColumns({"low": F.min("c").over(ends), "high": F.max("c").over(ends)}).filter("low <> high")
    postings = shared.groupBy("key", "c", "n").agg(F.max("short").alias("short"))
    postings = written(_merged(postings), "merged-postings")
    links = None
    for turn in range(STAR_ROUNDS):
        placed = _with_component(postings, links)
        order = F.xxhash64(F.lit(turn), "c")
        leaders = placed.groupBy("key").agg(F.min(F.struct(order, "c", "n", "comp")).alias("lead"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        leaders = leaders.filter("low <> high").select("key", F.col("lead.c").alias("c2"), F.col("lead.n").alias("n2"), F.col("lead.comp").alias("comp2"))
        met = placed.join(leaders, "key").filter(f"comp <> comp2 AND {_NEAR}")
        shares = met.groupBy("c", "c2").agg(F.sum("keys").alias("shares"))
        told = written(shares, "shares").join(sketches, "c").join(_second(sketches, "c", "n", *SKETCH), "c2").filter(_ALIKE)
        best = told.groupBy("c").agg(F.max(F.struct("shares", "c2")).alias("best"))
        pairs = written(best.select(F.least("c", "best.c2").alias("a"), F.greatest("c", "best.c2").alias("b")).distinct(), "star-pairs")
        made = _verified(pairs, rows, reps)
        links = made if links is None else links.union(made)
    placed = written(_with_component(postings, links), "placed")
    apart = _apart(placed, sketches)
    pairs = written(apart.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b")).distinct(), "open-pairs")
    return documents, links.union(_verified(pairs, rows, reps))


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Null and empty texts, and texts without a word, have no shingles and link with nothing; a row without an id links with
    nothing and has a null component; repeated rows are rows of one component. An empty table gives no rows.
    """
    documents, links = links_of(docs)
    nodes = components(links).select(F.col("node").alias("c"), "component")
    named = written(nodes, "class-components")
    per_class = documents.filter("n > 0 AND doc_id IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("low"))
    per_class = per_class.join(named, "c", "left").withColumn("component", F.coalesce("component", "c"))
    per_class = written(per_class, "class-lows")
    lowest = per_class.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = written(per_class.join(lowest, "component").select("c", "component_id"), "class-ids")
    out = documents.join(classes, "c", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id; columns and rows without words or id stay."""
    gone = written(similar_documents(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "similar-docs")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
