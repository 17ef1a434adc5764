"""Benchmark decontamination by spaced seeds.

A mask names which of some neighbouring words count; the others are ignored, so a hit survives substituted words. Every
window of every benchmark item and of every document is hashed under the masks for the item's length, equal hashes meet in a join, and each
hit fixes an alignment of a document with an item. Around it the aligned words are compared one by one: an overlap is
verified if some ``WINDOW`` neighbouring words (or the whole of a shorter item) hold at least ``SHARE`` equal ones. Items of
fewer words than ``LEAST_MASKED`` have none to spare: they are looked up whole.

What is found depends on the text alone, so equal texts are treated alike and hits meet their rows by two hashes of the
text. All of it is SQL expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import fresh, small, text_or_empty, written

# 1: the word counts. Every mask begins and ends with a word that counts. Found by enumeration (tests/llm proves it again): any
# 3 of 13 words substituted leave a window that one of LONG_MASKS hits, any quarter of 8 to 12 words, rounded down, one
# of SHORT_MASKS, and any one of 5 to 7 words one of BRIEF_MASKS. A passage cut off by an end of the text counts as substituted there.
LONG_MASKS = ("1111011", "1100010111", "110100111", "11101011", "1100010001011")
SHORT_MASKS = ("111011", "1001111", "1111001", "10101011", "10110101", "11000111", "11011001")
BRIEF_MASKS = ("1111", "10111", "11011", "11101")
WINDOW = 13
SHARE = 0.75
# Fewest words of an item for each family of masks.
FAMILIES = ((5, BRIEF_MASKS), (8, SHORT_MASKS), (WINDOW, LONG_MASKS))
LEAST_MASKED = FAMILIES[0][0]
# A benchmark of more seeds than this (about 64 MB) is joined by a shuffle, not broadcast.
BROADCAST_SEEDS = 2_000_000


def words(text: Column) -> Column:
    """64-bit hashes of the lower-case words (runs of letters and digits); what stands before the first word is none."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _seeds(own: Column, at: Column, masks: tuple[str, ...]) -> list[Column]:
    """The hashes of the window that begins at ``at`` under each mask; null where the mask passes the last word."""
    last = [at + len(mask) <= F.size(own) for mask in masks]
    made = [F.xxhash64(F.lit(mask), *[F.get(own, at + i) for i, counts in enumerate(mask) if counts == "1"]) for mask in masks]
    return [F.when(fits, seed) for fits, seed in zip(last, made, strict=True)]


def _starts(own: Column, masks: tuple[str, ...]) -> Column:
    shortest = min(map(len, masks))
    return F.when(F.size(own) >= shortest, F.sequence(F.lit(0), F.size(own) - shortest))


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", words(text_or_empty("text")).alias("item")).filter(F.size("item") > 0).distinct()
    return items.withColumn("item_key", F.xxhash64("item_id", "item"))


def _keys(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({"h1": F.xxhash64(text), "h2": F.hash(text)})


def hits(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """Distinct (h1, h2, item_key, shift): a seed of the item at position p meets one of the text at p + shift."""
    ends = [least for least, _ in FAMILIES[1:]] + [1 << 30]
    kinds = {masks: items.filter(F.size("item").between(least, end - 1)) for (least, masks), end in zip(FAMILIES, ends, strict=True)}
    kinds = {masks: long for masks, long in kinds.items() if not long.isEmpty()}
    if not kinds:
        return items.selectExpr("0L AS h1", "0 AS h2", "item_key", "0 AS shift").limit(0)
    placed = [long.select("item_key", "item", F.explode(_starts(F.col("item"), masks)).alias("at")).select("item_key", "at", F.explode(F.array(*_seeds(F.col("item"), F.col("at"), masks))).alias("seed")) for masks, long in kinds.items()]
    seeds = reduce(DataFrame.union, placed).filter("seed IS NOT NULL")
    seeds = written(seeds.distinct(), "item-seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    rows = _keys(docs.select(F.col(text).alias("text")).filter("text IS NOT NULL"), "text").select("h1", "h2", words(F.col("text")).alias("own"))
    used = sum(kinds, ())
    placed = rows.select("h1", "h2", "own", F.explode(_starts(F.col("own"), used)).alias("pos"))
    made = placed.select("h1", "h2", "pos", F.explode(F.array(*_seeds(F.col("own"), F.col("pos"), used))).alias("seed"))
    return made.join(seeds, "seed").select("h1", "h2", "item_key", (F.col("pos") - F.col("at")).alias("shift")).distinct()


def _whole_hits(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """Hits of items without a word to spare: their whole sequence of words, by its length."""
    short = items.filter(F.size("item") < LEAST_MASKED).select("item_key", F.size("item").alias("n"), F.xxhash64("item").alias("seed"))
    short = written(short, "short-items")
    if short.isEmpty():
        return short.selectExpr("0L AS h1", "0 AS h2", "item_key", "0 AS shift").limit(0)
    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # fewer than LEAST_MASKED
    rows = _keys(docs.select(F.col(text).alias("text")).filter("text IS NOT NULL"), "text").select("h1", "h2", words(F.col("text")).alias("own"))
    placed = rows.filter(F.size("own") > 0).select("h1", "h2", "own", F.explode(F.sequence(F.lit(0), F.size("own") - 1)).alias("shift"))
    made = placed.select("h1", "h2", "shift", F.explode(F.array(*[F.xxhash64(F.slice("own", F.col("shift") + 1, F.lit(n))) for n in lengths])).alias("seed"))
    return made.join(short, "seed").select("h1", "h2", "item_key", "shift").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Verified overlaps (h1, h2, item_id, start, n_words, n_equal), the best of each text and item.

    ``h1`` and ``h2`` are the hashes of the text, ``start`` the number of words before the overlap. Texts and items that are
    null or without a word have no overlaps; repeated items count once; ties go to the first place.
    """
    items = written(_items(benchmark), "items")
    found = written(hits(docs, items, text).unionByName(_whole_hits(docs, items, text)), "seed-hits")
    keys = found.select("h1", "h2").distinct()
    rows = _keys(docs.select(F.col(text).alias("text")), "text").join(small(written(keys, "hit-texts")), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    rows = rows.select("h1", "h2", words(F.col("text")).alias("own"))
    aligned = found.join(rows, ["h1", "h2"]).join(items, "item_key")
    equal = F.transform("item", lambda w, j: F.when((F.col("shift") + j >= 0) & (F.get("own", F.greatest(F.col("shift") + j, F.lit(0))) == w), 1).otherwise(0))
    window = F.least(F.lit(WINDOW), F.size("item"))
    least = F.ceil(window * SHARE)
    tried = aligned.withColumn("equal", equal).withColumn(
        "good",
        F.filter(
            F.sequence(F.lit(1), F.size("item") - window + 1),
            lambda s: F.aggregate(F.slice("equal", s, window), F.lit(0), lambda a, x: a + x) >= least,
        ),
    )
    verified = tried.filter(F.size("good") > 0).select(
        "h1",
        "h2",
        "item_id",
        (F.col("shift") + F.col("good")[0] - 1).alias("start"),
        (F.element_at("good", -1) - F.col("good")[0] + window).cast("long").alias("n_words"),
        F.aggregate("equal", F.lit(0), lambda a, x: a + x).cast("long").alias("n_equal"),
    )
    best = verified.groupBy("h1", "h2", "item_id").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("before"), "n_words")).alias("best"))
    return written(best.select("h1", "h2", "item_id", (-F.col("best.before")).cast("long").alias("start"), "best.n_words", "best.n_equal"), "overlaps")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, n_equal) of every document with a verified overlap; rows of equal id and text once."""
    keyed = _keys(docs.select("doc_id", "text"), "text").select("doc_id", "h1", "h2")
    return keyed.join(overlaps(docs, benchmark), ["h1", "h2"]).select("doc_id", "item_id", "start", "n_words", "n_equal").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text overlaps an item; columns stay as they are, rows without text stay."""
    bad = overlaps(docs, benchmark, text).select("h1", "h2").distinct()
    bad = small(written(bad, "contaminated"))
    h1, h2 = fresh(docs, "_h1"), fresh(docs, "_h2")
    keyed = docs.withColumns({h1: F.xxhash64(text), h2: F.hash(text)})
    return keyed.join(bad.toDF(h1, h2), [h1, h2], "left_anti").select(*docs.columns)
