"""Boilerplate lines by the number of distinct sites they appear on.

Each line's sites go into a HyperLogLog sketch under the line's hash; sketches are merged by aggregation, before and after
the shuffle, so a line on every page costs one sketch per task. Only lines whose estimate is near the threshold get an
exact count of distinct sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import fresh, text_or_empty, written

MIN_SITES = 8
LG_REGISTERS = 8
# Estimates within this share of the threshold are counted exactly; the sketch's standard error is 1.04 / sqrt(2**8) = 6.5 %.
NEAR = 0.25


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def spread_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, texts_once: bool = False) -> DataFrame:
    """Hashes (line) of the non-empty lines that appear on at least ``min_sites`` distinct sites. Null sites do not count.

    With ``texts_once`` equal texts count as one, on one of their sites (drawn by a hash of text and site), so that copies of
    a text do not make its own lines spread.
    """
    own = F.array_distinct(F.transform(F.filter(_lines(text_or_empty(text)), lambda x: F.trim(x) != ""), _key))
    placed = docs.filter(F.col(site).isNotNull())
    if texts_once:
        placed = placed.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), own.alias("own"), F.col(site).cast("string").alias("site"))
        placed = placed.groupBy("h1", "h2").agg(F.min(F.struct(F.xxhash64("h1", "site").alias("draw"), "site", "own")).alias("one"))
        placed = written(placed.select(F.col("one.own").alias("own"), F.col("one.site").alias("site")), "distinct-texts")
    else:
        placed = placed.select(own.alias("own"), F.col(site).cast("string").alias("site"))
    rows = placed.select(F.explode("own").alias("line"), "site")
    sketches = rows.groupBy("line").agg(F.hll_sketch_agg("site", LG_REGISTERS).alias("sketch"), F.count("*").alias("n"))
    estimate = F.when(F.col("n") < min_sites, 0).otherwise(F.hll_sketch_estimate("sketch"))
    rated = sketches.select("line", estimate.alias("sites")).filter(F.col("sites") >= min_sites * (1 - NEAR))
    rated = written(rated, "line-sites")
    sure = rated.filter(F.col("sites") > min_sites * (1 + NEAR)).select("line")
    near = rated.filter(F.col("sites") <= min_sites * (1 + NEAR)).select("line")
    exact = rows.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return written(sure.union(exact.select("line")), "spread-lines")


def clean(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, texts_once: bool = False) -> DataFrame:
    """``docs`` without spread lines in ``text``, plus ``n_lines`` and ``n_removed``.

    What is removed depends on the text alone, so equal texts are treated alike and results meet their rows by two hashes of
    the text. Null texts stay null with no lines, and empty lines are never removed; a text of spread lines alone becomes
    empty (its empty lines stay). An empty table gives no rows; other columns pass.
    """
    docs = docs.drop("n_lines", "n_removed")
    h1, h2, gone = (fresh(docs, c) for c in ("_h1", "_h2", "_gone"))
    spread = spread_lines(docs, text, site, min_sites, texts_once)
    keyed = docs.withColumn(h1, F.xxhash64(text)).withColumn(h2, F.hash(text))
    lines = keyed.filter(F.col(text).isNotNull()).select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), F.explode(F.array_distinct(F.transform(_lines(F.col(text)), _key))).alias("line"))
    found = lines.join(spread, "line").groupBy("h1", "h2").agg(F.collect_set("line").alias("gone"))
    found = written(found, "lines-found").select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("gone").alias(gone))
    # Sets of lines have no size bound, so they are dealt, not broadcast, at every size.
    joined = keyed.join(found.hint("merge"), [h1, h2], "left")
    whole = _lines(F.col(text))
    is_spread = lambda x: (F.trim(x) != "") & F.array_contains(F.col(gone), _key(x))
    kept = F.array_join(F.filter(whole, lambda x: ~is_spread(x)), "\n")
    removed = F.size(F.filter(whole, is_spread))
    some = F.col(gone).isNotNull()
    return (
        joined.withColumn("n_lines", F.when(F.col(text).isNotNull(), F.size(whole)).otherwise(0).cast("long"))
        .withColumn("n_removed", F.when(some, removed).otherwise(0).cast("long"))
        .withColumn(text, F.when(some, kept).otherwise(F.col(text)))
        .drop(h1, h2, gone)
    )


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (text, source, perhaps n_chars) with cleaned texts and the columns they had; a text that changed gets its new length.

    Equal texts count once, so that copies of a document and its near copies stay alike for the stages that follow.
    """
    before = fresh(docs, "_before")
    made = clean(docs.withColumn(before, F.col("text")), texts_once=True)
    if "n_chars" in docs.columns:
        same = F.col("text").eqNullSafe(F.col(before))
        made = made.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return made.select(*docs.columns)


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
s AS (SELECT trim(line) AS line FROM l WHERE trim(line) <> '' AND source IS NOT NULL GROUP BY trim(line) HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.*, s.line IS NOT NULL AS gone FROM l LEFT JOIN s ON trim(l.line) = s.line),
p AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_gone,
      string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY rid)
SELECT d.doc_id, coalesce(p.n_lines, 0) AS n_lines,
  coalesce(n_gone, 0) AS n_removed,
  CASE WHEN n_gone > 0 THEN coalesce(p.kept, '') ELSE d.text END AS text
FROM d LEFT JOIN p ON d.rid = p.rid
"""
