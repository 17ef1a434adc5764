"""First matching pattern of each text, found through an inverted index of literal grams.

A text matches a pattern if it contains it as it is or matches it as a regular expression. Either way it must
hold certain literal pieces: the pattern itself, or the literal runs that every match of the expression has. A pattern is
indexed under the rarest gram of such a piece (counted over all texts), texts are cut into grams of the same lengths, of which
those that no pattern has are dropped at once by a map of bits, and an equi join gives the candidates that ``contains`` and ``regexp_like`` decide. Patterns without a literal piece are
counted; they alone are tried on every text, in bundles.

The runs are taken from a pattern conservatively: escapes, classes, groups and repeated or optional characters end a run,
and an expression that this does not understand counts as one without a literal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.operators.dims import is_small, join_spec
from callgauge.session import saved, ship_code

# Powers of two: hashes of a length come from those of half of it.
LENGTHS = (8, 4, 2, 1)
PIECE = 32_768
# Characters hashed at once, and bits (as a power of two) of the map of wanted grams.
PORTION = 500_000
BITS = 22
BUNDLE = 128
GROUP_DEPTH = 4

_FACTORS = {n: np.uint64(f) for n, f in ((2, 0x9E3779B97F4A7C15), (4, 0xC2B2AE3D27D4EB4F), (8, 0xD6E8FEB86659FD93))}
_CUT = "\x00"
_KNOWN_ESCAPES = "dDsSwWbBAzZGhHvVRtnrfae"


def _runs(pattern: Column) -> tuple[Column, Column]:
    """(alternatives, understood): an array of alternatives, each an array of the literal runs all its matches hold."""

    def cut(text: Column, what: str) -> Column:
        return F.regexp_replace(text, F.lit(f"(?s){what}"), F.lit(_CUT))

    plain = cut(pattern, r"\\[^A-Za-z0-9]")
    odd = pattern.contains(_CUT) | pattern.rlike(r"\(\?[A-Za-z-]") | plain.rlike(rf"\\(?![{_KNOWN_ESCAPES}])")
    plain = cut(cut(plain, r"\\[A-Za-z]"), r"\[[^\[\]]*\]")
    odd = odd | plain.rlike(r"[\[\]]")
    for _ in range(GROUP_DEPTH):
        plain = cut(plain, r"\([^()]*\)")
    odd = odd | plain.rlike(r"[()]")
    plain = cut(cut(cut(plain, r".[?*][?+]?"), r".\{[^}]*\}[?+]?"), r"\+[?+]?")
    alternatives = F.transform(F.split(plain, r"\|", -1), lambda a: F.filter(F.split(a, r"[\x00.^${}]+", -1), lambda run: run != ""))
    return alternatives, ~odd


def grams(text: Column, length: int) -> Column:
    """All pieces of ``length`` characters, distinct; one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def required_grams(patterns: DataFrame) -> DataFrame:
    """(priority, alternative, gram): one of an alternative's rows is enough to index it.

    Alternatives are numbered; alternative -1 is the pattern as it is. A pattern without a row for each of its
    alternatives has no literal. Null patterns match nothing and give no rows.
    """
    alternatives, understood = _runs(F.col("pattern"))
    as_it_is = F.array(F.array("pattern"))
    special = F.col("pattern").rlike(r"[\\\[\](){}.*+?^$|]")
    every = F.when(~special, as_it_is).when(understood, F.concat(as_it_is, alternatives)).otherwise(F.concat(as_it_is, F.array(F.array().cast("array<string>"))))
    rows = patterns.where("pattern IS NOT NULL").select("priority", F.posexplode(every).alias("alternative", "runs"))
    # The longest gram that a run can fill.
    by_length = F.array(*[F.lit(n) for n in LENGTHS])

    def of(run: Column) -> Column:
        branch = F.lit(None).cast("array<string>")
        for n in reversed(LENGTHS):
            branch = F.when(F.length(run) >= n, grams(run, n)).otherwise(branch)
        return F.coalesce(branch, F.array().cast("array<string>"))

    cut = rows.withColumn("held", F.array_distinct(F.flatten(F.transform("runs", of)))).withColumn("lengths", by_length)
    return cut.select("priority", "alternative", F.explode_outer("held").alias("gram"))


def _mix(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of ``x``; different numbers stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(codes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of all runs of so many code points), from hashes of half the length."""
    held = _mix(codes.astype(np.uint64) + np.uint64(1))
    for n in (1, 2, 4, 8):
        if n > 1:
            half = n // 2
            held = held[:-half] * _FACTORS[n] + held[half:]
        if len(held) and n in lengths:
            yield n, _mix(held)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit of each gram."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        at = [next((int(h[0]) for n, h in _hashed(_codes(t), [len(t)])), 0) >> (64 - BITS) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int64())], names=["place"])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _bits(wanted: DataFrame) -> np.ndarray:
    """A map of 2 ** BITS bits with those of ``wanted`` (gram) set: what the driver and each task hold, however many grams there are."""
    ship_code(wanted.sparkSession)
    places = wanted.select(F.make_valid_utf8("gram").alias("gram")).mapInArrow(_places, "place long")
    after = F.col("place") + 1  # Spark numbers buckets from 1; one is 4096 bytes
    parts = places.groupBy(F.bitmap_bucket_number(after).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(after)).alias("held"))
    bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for part, held in parts.collect():
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(held, dtype=np.uint8)
    return bits


def _met(pieces: list[str], bits: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, str]]:
    """(number of the piece, gram): the grams of each piece, once, whose bit is set."""
    text = "".join(pieces)
    ends = np.cumsum([len(p) for p in pieces])
    for n, hashes in _hashed(_codes(text), lengths):
        place = hashes >> np.uint64(64 - BITS)
        at = np.flatnonzero((bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
        piece = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[piece]
        at, piece = at[inside], piece[inside]
        order = np.lexsort((hashes[at], piece))
        at, piece = at[order], piece[order]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (piece[1:] != piece[:-1]) | (hashes[at][1:] != hashes[at][:-1])
        yield from ((p, text[i : i + n]) for p, i in zip(piece[first].tolist(), at[first].tolist(), strict=True))


def _text_grams(texts: DataFrame, lengths: list[int], wanted: DataFrame) -> DataFrame:
    """(id, gram) of texts, long ones piece by piece with an overlap; a gram may come once from each piece.

    Grams are hashed in arrays, and only those come out whose bit is set in a map of the ``wanted`` ones: these all, and of others
    those that share a bit. A join decides.
    """
    overlap = max(lengths) - 1
    whole = F.make_valid_utf8("text")
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(PIECE))
    pieces = texts.select("id", whole.alias("text")).select("id", F.explode(F.transform(starts, lambda at: F.substring("text", at, F.lit(PIECE + overlap)))).alias("piece"))
    sent = texts.sparkSession.sparkContext.broadcast(_bits(wanted))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, chars, begin = batch.column(1).to_pylist(), 0, 0
            for end, piece in enumerate(held, 1):
                chars += len(piece)
                if chars < PORTION and end < len(held):
                    continue
                found = list(_met(held[begin:end], sent.value, lengths))
                ids = batch.column(0).slice(begin, end - begin).take(pa.array([p for p, _ in found], type=pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([g for _, g in found], type=pa.string())], names=["id", "gram"])
                begin, chars = end, 0

    return pieces.mapInArrow(cut, f"id {pieces.schema['id'].dataType.simpleString()}, gram string")


def _indexed(texts: DataFrame, needed: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, priority) candidates: the text holds the rarest gram of an alternative of the pattern."""
    known = saved(needed.select("gram").distinct(), "pattern-grams")
    times = join_spec(_text_grams(texts, lengths, known), known, ["gram"], "inner", spread="id").groupBy("gram").agg(F.count("*").alias("times"))
    # A gram that no text holds rules its alternative out: it is the rarest.
    rarity = F.struct(F.coalesce("times", F.lit(0)).alias("times"), -F.length("gram"), "gram")
    rarest = needed.join(times, "gram", "left").groupBy("priority", "alternative").agg(F.min(rarity).alias("least"))
    index = saved(rarest.where("least.times > 0").select("priority", F.col("least.gram").alias("gram")).distinct(), "gram-index")
    return join_spec(_text_grams(texts, lengths, index), index, ["gram"], "inner", spread="id").select("id", "priority").distinct()


def _first_of_rest(texts: DataFrame, rest: DataFrame, count: int) -> DataFrame:
    """(id, priority): the first of the patterns without a literal that a text matches."""
    bundles = -(-count // BUNDLE)
    held = rest.groupBy(F.pmod(F.xxhash64("priority"), F.lit(bundles)).cast("int").alias("bundle")).agg(F.array_sort(F.collect_list(F.struct("priority", "pattern"))).alias("tried"))
    asked = texts.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    kind = rest.schema["priority"].dataType

    def first(best: Column, one: Column) -> Column:
        # Patterns come by priority, so nothing is tried behind a match.
        hit = F.expr("false") if best is None else best.isNull() & (F.contains(F.col("text"), one["pattern"]) | F.regexp_like(F.col("text"), one["pattern"]))
        return F.when(hit, one["priority"]).otherwise(best)

    met = join_spec(asked, held, ["bundle"], "inner", spread="id")
    return met.select("id", F.aggregate("tried", F.lit(None).cast(kind), first).alias("priority")).where("priority IS NOT NULL")


def first_matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, priority) of the first pattern each text matches; texts that match none have no row.

    texts: id, text (an id for each different text); patterns: priority (unique), pattern, and any further columns.
    """
    patterns = patterns.select("priority", "pattern")
    needed = saved(required_grams(patterns), "required-grams")
    blind = saved(needed.where("gram IS NULL").select("priority").distinct(), "blind-patterns")
    sighted = needed.join(blind, "priority", "left_anti")
    lengths = [r[0] for r in sighted.select(F.length("gram").alias("n")).distinct().collect()]  # at most one row for each of LENGTHS
    found = None
    if lengths:
        small = is_small(patterns)
        candidates = _indexed(texts, sighted, sorted(lengths, reverse=True)).join(texts, "id")
        tried = join_spec(candidates, patterns, ["priority"], "inner", small=small, spread="id")
        found = tried.where("contains(text, pattern) OR regexp_like(text, pattern)").select("id", "priority")
    count = blind.count()
    if count:
        rest = _first_of_rest(texts, patterns.join(blind, "priority", "left_semi"), count)
        found = rest if found is None else found.unionByName(rest)
    if found is None:
        return texts.limit(0).join(patterns.limit(0)).select("id", "priority")
    return found.groupBy("id").agg(F.min("priority").alias("priority"))


def replies(prompts: DataFrame, patterns: DataFrame, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with the ``reply`` of the first pattern, by priority, that each contains or matches; NULL where none does.

    Equal prompts are looked up once. Null prompts match nothing; repeated rows stay; empty tables on either side give
    NULL replies or no rows. patterns: priority (unique), pattern, reply.
    """
    key = "_prompt_key"
    keyed = prompts.withColumn(key, F.md5(prompt))
    texts = saved(keyed.where(F.col(prompt).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.first(prompt).alias("text")), "pattern-texts")
    best = saved(first_matches(texts, patterns), "first-matches").join(patterns.select("priority", "reply"), "priority").select(F.col("id").alias(key), "reply")
    return join_spec(keyed, best, [key], "left").drop(key)
