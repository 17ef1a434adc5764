"""License scan: an exact set-similarity join of text blocks with license templates.

All steps are Spark SQL expressions. A text becomes lower-case words; blocks are windows of words that begin every
``step`` words and are two steps long, where a step is the length of the longest template, so each place where a template
could stand lies inside a block. A block matches a template if it holds at least the template's share of its distinct
words.

The words of all templates are ordered by the number of documents that hold them, rarest first, counted over all
documents. With o words needed of a template of t words, a block of b template words can only match if b >= o (length
filter), if its first b - o + 1 words and the template's first t - o + 1 share one (prefix filter), and if behind the
first shared word both hold enough further words (positional filter). Blocks meet templates by an equi join on prefix
words; what is left is counted exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import fresh, text_or_empty
from callgauge.session import literal_table

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 0.8


@dataclass(frozen=True)
class Template:
    """``share`` is the part of the template's distinct words that a block has to hold."""

    label: str
    text: str
    share: float = SHARE


# Phrases whose places are counted, and notices of well-known licenses.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = (
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license", 0.95),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", 0.95),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _plain(text: Column) -> Column:
    """Lower-case words, one blank between them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.trim(F.regexp_replace(F.translate(text, upper, lower), NO_WORD, " "))


def _places(words: Column, plain: Column, phrase: str) -> Column:
    """Word numbers at which the phrase begins; the words are looked through only if the text holds the phrase."""
    parts = phrase.split()
    held = F.concat(F.lit(" "), plain, F.lit(" ")).contains(f" {phrase} ")

    def begins(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], start=1):
            test = test & (F.get(words, i + k) == part)
        return test

    return F.when(held, F.filter(F.sequence(F.lit(0), F.size(words) - 1), begins)).otherwise(F.array().cast("array<int>"))


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


@dataclass(frozen=True)
class _Side:
    """A template as a sorted list of its words, how many a block needs, and its prefix."""

    label: str
    words: list[str]
    least: int

    @property
    def prefix(self) -> list[str]:
        return self.words[: len(self.words) - self.least + 1]


def _ordered(docs: DataFrame, words: str, templates: tuple[Template, ...]) -> list[str]:
    """All template words by the number of rows of ``docs`` that hold them, the rarest first. One row per template word comes back."""
    every = sorted({w for t in templates for w in t.text.split()})
    held = F.array_intersect(_texts(every), F.col(words))
    counts = dict(docs.select(F.explode(held).alias("word")).groupBy("word").count().collect())
    return sorted(every, key=lambda w: (counts.get(w, 0), w))


def _matches(rows: DataFrame, words: str, block: str, templates: tuple[Template, ...]) -> DataFrame:
    """``rows`` once for each block prefix word, with ``block``: null, or (label, share) of a matching template."""
    spark = rows.sparkSession
    order = _ordered(rows, words, templates)
    sides = []
    for t in templates:
        own = set(t.text.split())
        sides.append(_Side(t.label, [w for w in order if w in own], math.ceil(round(t.share * len(own), 9))))
    fewest = min(s.least for s in sides)
    step = max(len(t.text.split()) for t in templates)
    prefixes = sorted({w for s in sides for w in s.prefix})
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(step)), lambda i: F.array_intersect(_texts(order), F.slice(words, i, 2 * step)))

    def possible(b: Column) -> Column:
        return (F.size(b) >= fewest) & F.arrays_overlap(F.slice(b, F.lit(1), F.size(b) - fewest + 1), _texts(prefixes))

    blocks = F.when(F.arrays_overlap(words, _texts(prefixes)), F.filter(blocks, possible))
    held, at, word, found = (fresh(rows, stem) for stem in ("_held", "_at", "_word", "_found"))
    opened = rows.select("*", F.explode_outer(F.array_distinct(blocks)).alias(held))
    # Only words of the longest prefix that any template needs are looked up.
    opened = opened.select("*", F.posexplode_outer(F.slice(held, F.lit(1), F.greatest(F.size(held) - fewest + 1, F.lit(1)))).alias(at, word))
    index = [(w, s.label, i, len(s.words), s.least, " ".join(s.words)) for s in sides for i, w in enumerate(s.prefix)]
    names = {n: fresh(opened, f"_t_{n}") for n in ("label", "place", "size", "least", "words")}
    index = literal_table(spark, index, "word string, label string, place int, size int, least int, words string")
    index = F.broadcast(index.toDF(word, *names.values()))  # one row for each prefix word of a template
    met = opened.join(index, word, "left")
    size, place, least = F.size(held), F.col(names["place"]), F.col(names["least"])
    close = (size >= least) & (F.col(at) <= size - least) & (F.least(F.col(names["size"]) - place, size - F.col(at)) >= least)
    common = F.size(F.array_intersect(F.split(names["words"], " "), F.col(held)))
    met = met.withColumn(found, F.when(close, common))
    hit = F.when(F.col(found) >= least, F.struct(F.col(names["label"]).alias("label"), (F.col(found) / F.col(names["size"])).alias("share")))
    return met.withColumn(block, hit).drop(held, at, word, found, *names.values())


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (all its columns) with ``license``: (n_words, places, base_labels, labels, score).

    ``places`` has the word numbers at which a phrase begins, ascending; ``base_labels`` the labels of the phrases
    that occur, ``labels`` these and the labels of templates that a block matches, both sorted and distinct. ``score`` is 1
    with a base label, else the largest share of a template found in a block, else 0. A null or empty text has no words, no
    places and no labels; repeated rows give repeated rows, an empty table an empty one. ``license`` replaces a column
    of that name; inner columns take names that the table does not hold.
    """
    docs = docs.drop("license")
    row, plain, words, n, places, base, block = (fresh(docs, f"_{stem}") for stem in ("row", "plain", "words", "n", "places", "base", "block"))
    rows = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(plain, _plain(text_or_empty(text)))
    rows = rows.withColumn(words, F.when(F.col(plain) == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ")))
    found = F.array(*[_places(F.col(words), F.col(plain), phrase) for phrase in phrases])
    rows = rows.withColumns({n: F.size(words).cast("long"), places: found})
    labels = _texts(phrases.values())
    held = F.filter(F.transform(labels, lambda label, i: F.when(F.size(F.get(F.col(places), i)) > 0, label)), lambda label: label.isNotNull())
    rows = rows.withColumns({base: F.array_sort(F.array_distinct(held)), places: F.array_sort(F.flatten(places))})
    matched = _matches(rows, words, block, templates)
    # The row number is unique, so one row goes on for each document; the rest of its columns are the same in all its rows.
    kept = [c for c in docs.columns]
    grouped = matched.groupBy(row).agg(
        *[F.first(c).alias(c) for c in (*kept, n, places, base)],
        F.collect_set(F.col(block)["label"]).alias(block),
        F.max(F.col(block)["share"]).alias(plain),
    )
    score = F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.col(plain), F.lit(0.0)))
    every = F.array_sort(F.array_union(base, block))
    result = F.struct(F.col(n).alias("n_words"), F.col(places).alias("places"), F.col(base).alias("base_labels"), every.alias("labels"), score.alias("score"))
    return grouped.select(*kept, result.alias("license"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: number of words and of phrase places, the first and last of them, labels, score."""
    out = scan(docs.select("doc_id", "text"))
    places = F.col("license.places")
    return out.select(
        "doc_id",
        F.col("license.n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.get(places, F.lit(0)).cast("long").alias("first_word"),
        F.get(places, F.size(places) - 1).cast("long").alias("last_word"),
        F.array_join("license.base_labels", ",").alias("base_labels"),
        F.array_join("license.labels", ",").alias("labels"),
        F.col("license.score").alias("score"),
    )


def sql(phrases: dict[str, str] = PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same rows as ``report`` by comparing every block with every template."""
    step = max(len(t.text.split()) for t in templates)
    sides = ", ".join(f"('{t.label}', string_split('{t.text}', ' '), {t.share})" for t in templates)
    parts = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in phrases.items())
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
phrase(label, parts) AS (VALUES {parts}),
template(label, parts, share) AS (VALUES {sides}),
place AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1 : i + len(parts)] = parts)) AS pos FROM w, phrase WHERE list_contains(ws, parts[1])
),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM place GROUP BY doc_id),
block AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(ws), 1), {step}), lambda i: list_sort(list_distinct(ws[i + 1 : i + {2 * step}])))) AS b FROM w),
met AS (SELECT doc_id, label, len(list_intersect(list_distinct(parts), b)) AS c, len(list_distinct(parts)) AS t, share FROM block, template),
hit AS (SELECT doc_id, max(c / t) AS share, list(DISTINCT label) AS labels FROM met WHERE c >= ceil(round(share * t, 9)) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(hit.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(hit.share, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN hit USING (doc_id)
"""
