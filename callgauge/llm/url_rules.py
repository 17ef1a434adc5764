"""URL filtering by hand rules and by association rules mined with FP-growth.

Hand rules name a host and the start of a path; the longest that fits decides. Labelled URLs become sets of tokens
(scheme, host with its parent domains, words of the path and the names of query keys) plus a label token. Tokens that stand
in the same rows are mined as one, so that k of them do not make 2^k frequent sets. FP-growth counts the sets in a
distributed way, and the rules ``tokens -> block`` that are confident enough, and more
confident than every rule on a part of their tokens, form an inverted index under their rarest token. URLs meet the
index by a join on that token, so no URL is compared with all rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import fresh, written

BLOCK, ALLOW = "block", "allow"
LABEL = "label:block"
HAND_RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    name = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(name, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def hand_rule(host_name: Column, url_path: Column, rules: Sequence[tuple[str, str, str]] = HAND_RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null. ``rules``: (verdict, host, path start)."""
    fit = F.lit(None)
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_name == name) | host_name.endswith("." + name)) & url_path.startswith(start)
        fit = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(fit)
    return fit


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; numbers in paths count as one token, null or empty URLs have none."""
    name = host(url)
    labels = F.split(name, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    words = F.split(F.translate(path(url), _UPPER, _LOWER), r"[^\p{L}\p{N}]+")
    words = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit("path:"), F.regexp_replace(w, "[0-9]+", "0")))
    keys = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    keys = F.transform(keys, lambda k: F.concat(F.lit("query:"), k))
    scheme = F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)))
    made = F.array_distinct(F.concat(scheme, domains, words, keys))
    return F.when(_rest(url).isNotNull(), made).otherwise(F.array().cast("array<string>"))


def same_rows(listed: DataFrame, min_support: float) -> DataFrame:
    """(token, first) for each token frequent enough: ``first`` is the smallest token that stands in the same rows.

    Row sets are told apart by their size and two sums of 64-bit hashes over the rows' tokens and labels: tokens of the same
    rows always meet, others with negligible chance. At most (mean tokens of a row) / ``min_support`` tokens are frequent.
    """
    key = F.struct(F.array_sort("tokens"), "blocked")
    hashed = listed.select("tokens", F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    # A token that many rows share is summed up in each task first.
    prints = hashed.select(F.explode("tokens").alias("token"), "h", "g").groupBy("token").agg(F.count("*").alias("n"), total("h"), total("g"))
    n_rows = listed.agg((F.count("*") * min_support).alias("least"))
    frequent = prints.crossJoin(F.broadcast(n_rows)).filter(F.col("n") >= F.col("least"))  # one row
    return frequent.groupBy("n", "h", "g").agg(F.min("token").alias("first"), F.collect_list("token").alias("all")).select("first", F.explode("all").alias("token"))


def _merged(listed: DataFrame, same: DataFrame) -> DataFrame:
    """Item sets: the first token of every class a row holds, and the label of blocked rows. Rows without a frequent token keep theirs empty."""
    numbered = listed.withColumn("id", F.monotonically_increasing_id())
    firsts = numbered.select("id", "blocked", F.explode("tokens").alias("token")).join(same, "token", "left")
    items = firsts.groupBy("id", "blocked").agg(F.collect_set("first").alias("firsts"))
    return items.select(F.when(F.col("blocked"), F.array_append("firsts", F.lit(LABEL))).otherwise(F.col("firsts")).alias("items"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, antecedent, members, confidence, support, key) from ``labelled`` (tokens: array, blocked: boolean).

    A rule survives if it holds at ``min_support`` of all rows and ``min_confidence`` of those it fits, and no rule on a
    proper part of its tokens is as confident. A token of ``antecedent`` stands for all ``members`` at its place, tokens of the
    same rows; a URL with any of them has it. ``key`` is a token of the rarest place, one row for each. How many sets
    are frequent depends on the tokens' overlap, not on the number of rows: k tokens whose rows are contained in each other without being
    equal still make 2^k. Rows with null labels count as not blocked; an empty table gives no rules.
    """
    listed = labelled.filter(F.size("tokens") > 0).select(F.array_distinct("tokens").alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    same = written(same_rows(listed, min_support), "url-same")
    rows = written(_merged(listed, same), "url-items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    sets = written(model.freqItemsets, "url-sets")
    all_rows = rows.agg(F.count("*").alias("n_rows"))
    whole = sets.filter(F.array_contains("items", LABEL)).select(
        F.array_sort(F.array_remove("items", LABEL)).alias("antecedent"), F.col("freq").alias("hits")
    )
    fits = sets.filter(~F.array_contains("items", LABEL)).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("n_fits"))
    rated = (
        whole.join(fits, "antecedent")
        .crossJoin(F.broadcast(all_rows))  # one row
        .select("antecedent", (F.col("hits") / F.col("n_fits")).alias("confidence"), (F.col("hits") / F.col("n_rows")).alias("support"))
        .filter(F.col("confidence") >= min_confidence)
    )
    rated = written(rated, "url-rated")
    smaller = rated.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    part_of = rated.select(
        "antecedent", "confidence", F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))).alias("part")
    )
    weaker = part_of.join(smaller, "part").filter(F.col("part_confidence") >= F.col("confidence")).select("antecedent").distinct()
    single = fits.filter(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("token"), "n_fits")
    kept = rated.join(weaker, "antecedent", "left_anti")
    keyed = (
        kept.select("*", F.explode("antecedent").alias("token"))
        .join(single, "token")
        .groupBy("antecedent", "confidence", "support")
        .agg(F.min(F.struct("n_fits", "token")).alias("rarest"))
    )
    members = same.groupBy("first").agg(F.array_sort(F.collect_list("token")).alias("group"))
    grouped = keyed.select("*", F.posexplode("antecedent").alias("place", "token")).join(members, F.col("token") == F.col("first"))
    whole = grouped.groupBy("antecedent", "confidence", "support", "rarest").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "group"))), lambda g: g["group"]).alias("members")
    )
    keys = F.element_at("members", F.array_position("antecedent", F.col("rarest.token")).cast("int"))
    return whole.select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", "members", "confidence", "support", F.explode(keys).alias("key"))


def apply(urls: DataFrame, rules: DataFrame, url: str = "url", out: str = "mined") -> DataFrame:
    """``urls`` with ``out``: array of (confidence, rule_id) of the mined rules that fit, best first; empty if none does."""
    urls = urls.drop(out)
    rid, inner = fresh(urls, "_rid"), "_tokens"
    keyed = urls.withColumn(rid, F.monotonically_increasing_id())
    rows = keyed.select(F.col(rid).alias("rid"), tokens(F.col(url)).alias(inner)).select("rid", inner, F.explode(inner).alias("key"))
    hits = (
        rows.join(rules, "key")
        .filter(F.forall("members", lambda tokens_of: F.arrays_overlap(tokens_of, F.col(inner))))
        .groupBy("rid")
        .agg(F.sort_array(F.collect_set(F.struct("confidence", "rule_id")), asc=False).alias(out))
    )
    none = F.array().cast("array<struct<confidence:double,rule_id:bigint>>")
    return keyed.join(hits.withColumnRenamed("rid", rid), rid, "left").withColumn(out, F.coalesce(out, none)).drop(rid)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = HAND_RULES) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url): the hand rule's verdict, else block if a mined rule fits, else allow.

    The mined rules are learned from the URLs that a hand rule judges. Null URLs and those without ``://`` have an empty host
    and path, fit nothing and are allowed; repeated rows and null ids are kept; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("by_hand", hand_rule(F.col("host"), F.col("path"), rules))
    labelled = rows.filter(F.col("by_hand").isNotNull()).select(tokens(F.col("url")).alias("tokens"), (F.col("by_hand.verdict") == BLOCK).alias("blocked"))
    judged = apply(rows, mine(labelled))
    mined = F.when(F.size("mined") > 0, BLOCK).otherwise(ALLOW)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("by_hand.rule").alias("rule"),
        F.coalesce("by_hand.verdict", mined).alias("verdict"),
        F.get("mined", F.lit(0))["confidence"].alias("confidence"),
    )
