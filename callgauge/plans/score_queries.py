"""Rubric scores, judge statistics and score gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge import fixed
from callgauge.operators import evaluation, gates, generation, intervals, judges, lint, scoring
from callgauge.plans.fixtures import Tables
from callgauge.plans.generation_queries import rows as registry_rows
from callgauge.plans.registry import CTES, query

# ---- SQL of the scores ------------------------------------------------------------

_N10 = "CASE WHEN {0} IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, CAST({0} AS DOUBLE) / 10)) END"


def _n10(c: str) -> str:
    return f"CAST({_N10.format(c)} AS DOUBLE)"


CTES["judge_cases"] = """
SELECT s.*, c.tool_name,
  CASE WHEN s.call_id % 3 = 0 AND kind = 'broken' THEN [expected_taxonomy] WHEN s.call_id % 7 = 0 THEN ['ordering'] ELSE CAST([] AS VARCHAR[]) END AS failures,
  CASE WHEN s.call_id % 4 = 0 THEN 'fault in ' || expected_taxonomy ELSE 'no comment' END AS rationale
FROM judge_scores s JOIN (SELECT call_id, tool_name FROM calls) c USING (call_id)
"""
CTES["call_faults"] = """
SELECT call_id, bool_or(rule_id IN ('missing_required', 'unknown_param', 'malformed_call')) AS name_fault,
  bool_or(rule_id IN ('capability_violation', 'illegal_enum', 'type_mismatch', 'invalid_uri', 'invalid_value', 'unknown_model')) AS value_fault
FROM violations GROUP BY call_id
"""


def _collapsed_sql(name: str, value: str) -> str:
    words = lambda ws: " OR ".join(f"lower(array_to_string(failures, ' ')) LIKE '%{w}%'" for w in ws)
    return (
        f"CASE WHEN {name} ({words(('name', 'missing', 'unknown_param'))}) OR coalesce(name_accuracy <= 2, false) THEN 'name'"
        f" WHEN {value} ({words(('value', 'capab', 'enum'))}) OR coalesce(value_accuracy <= 2, false) THEN 'value' ELSE 'none' END"
    )


_LOWERED = """
SELECT * REPLACE (
  CASE WHEN collapsed = 'name' THEN 0 ELSE completeness END AS completeness,
  CASE WHEN collapsed = 'name' THEN 0 ELSE name_accuracy END AS name_accuracy,
  CASE WHEN collapsed <> 'none' THEN 0 ELSE value_accuracy END AS value_accuracy,
  CASE WHEN collapsed <> 'none' THEN 0 ELSE type_compliance END AS type_compliance,
  CASE WHEN collapsed <> 'none' THEN 0 ELSE format_compliance END AS format_compliance,
  CASE WHEN collapsed <> 'none' THEN least(coalesce(relevancy, 2), 2) ELSE relevancy END AS relevancy,
  CASE WHEN collapsed = 'none' THEN failures ELSE list_append(failures, 'argument_' || collapsed || '_collapse') END AS failures)
FROM {0}
"""
CTES["marked_lint"] = f"""
SELECT j.*, {_collapsed_sql('coalesce(name_fault, false) OR', 'coalesce(value_fault, false) OR')} AS collapsed
FROM judge_cases j LEFT JOIN call_faults f USING (call_id)
"""
CTES["marked_plain"] = f"SELECT *, {_collapsed_sql('', '')} AS collapsed FROM judge_cases"
CTES["collapsed_lint"] = _LOWERED.format("marked_lint")
CTES["collapsed_plain"] = _LOWERED.format("marked_plain")

_SEL = " + ".join(_n10(c) for c in scoring.SELECTION)
_ARG = " + ".join(_n10(c) for c in scoring.ARGUMENTS)
_ORD = " + ".join(_n10(c) for c in scoring.ORDERING)
_THREE = f"({_n10('necessity')} + ({_SEL}) / 3 + ({_ARG}) / 6)"


def _overall(ordered: bool) -> str:
    if not ordered:
        return f"round({_THREE} / 3, 4)"
    return f"round(CASE WHEN multi_call THEN ({_THREE} + ({_ORD}) / 3) / 4 ELSE {_THREE} / 3 END, 4)"


_KEPT = "call_id, transcript_id, tool_name, judge, kind, expected_taxonomy, failures, rationale, collapsed"
for _run in ("lint", "plain"):
    CTES[f"scored_{_run}"] = (
        f"SELECT {_KEPT}, {_overall(False)} AS tc, ({_ARG}) / 6 AS arguments, "
        + ", ".join(f"{_n10(c)} AS {c}" for c in scoring.ARGUMENTS)
        + f" FROM collapsed_{_run}"
    )

# ---- scores ---------------------------------------------------------------------


def scored(t: Tables, use_lint: bool) -> DataFrame:
    """Collapsed and averaged score of each (call, judge)."""
    verdicts = lint.call_verdicts(t.calls_unordered, t.media_spec) if use_lint else None
    done = scoring.tool_calling(scoring.collapse(t.judge_scores, verdicts))
    return done.withColumnRenamed("overall", "tc")


@query(
    "penalty_collapse",
    "SELECT call_id, judge, collapsed, completeness, name_accuracy, value_accuracy, type_compliance, format_compliance,"
    " relevancy, array_to_string(failures, '|') AS failures FROM collapsed_lint",
)
def penalty_collapse(t: Tables) -> DataFrame:
    verdicts = lint.call_verdicts(t.calls_unordered, t.media_spec)
    done = scoring.collapse(t.judge_scores, verdicts)
    return done.select("call_id", "judge", "collapsed", *scoring.ARGUMENTS, F.array_join("failures", "|").alias("failures"))


@query(
    "penalty_collapse_no_lint",
    "SELECT call_id, judge, collapsed, relevancy, array_to_string(failures, '|') AS failures FROM collapsed_plain",
)
def penalty_collapse_no_lint(t: Tables) -> DataFrame:
    done = scoring.collapse(t.judge_scores)
    return done.select("call_id", "judge", "collapsed", "relevancy", F.array_join("failures", "|").alias("failures"))


@query(
    "tc_score",
    f"""
SELECT call_id, judge, {_n10('necessity')} AS usage, round(({_SEL}) / 3, 4) AS selection, round(({_ARG}) / 6, 4) AS arguments,
  round(CASE WHEN multi_call THEN ({_ORD}) / 3 END, 4) AS ordering, {_overall(True)} AS overall
FROM judge_scores
""",
)
def tc_score(t: Tables) -> DataFrame:
    done = scoring.tool_calling(t.judge_scores_ordered, "multi_call")
    return done.selectExpr(
        "call_id", "judge", "usage", "round(selection, 4) AS selection", "round(arguments, 4) AS arguments",
        "round(ordering, 4) AS ordering", "overall",
    )


@query(
    "tc_aggregate",
    "SELECT call_id, judge, round(tc, 3) AS tc_overall, completeness, name_accuracy, value_accuracy, type_compliance,"
    " format_compliance, relevancy FROM scored_lint",
)
def tc_aggregate(t: Tables) -> DataFrame:
    return scored(t, True).select("call_id", "judge", F.round("tc", 3).alias("tc_overall"), *scoring.ARGUMENTS)


CTES["raw_leaves"] = """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'abc' WHEN 4 THEN '15'
  WHEN 5 THEN '-3' WHEN 6 THEN 'true' WHEN 7 THEN ' 2.5 ' ELSE CAST(event_id % 11 AS VARCHAR) END AS raw FROM events
"""
_LEAF = "CASE raw WHEN 'true' THEN 1.0 ELSE TRY_CAST(trim(raw) AS DOUBLE) END"


def _leaf_sql(scale: str) -> str:
    shown = scale.format(_LEAF)
    return (
        f"SELECT event_id, CAST(CASE WHEN raw IS NULL THEN 1.0 WHEN {_LEAF} IS NULL OR isnan({_LEAF}) OR isinf({_LEAF}) THEN 0.0"
        f" ELSE greatest(0.0, least(1.0, {shown})) END AS DOUBLE) AS score FROM raw_leaves"
    )


def _leaves(t: Tables) -> DataFrame:
    return t.read("events").selectExpr(
        "event_id",
        "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'abc' WHEN 4 THEN '15'"
        " WHEN 5 THEN '-3' WHEN 6 THEN 'true' WHEN 7 THEN ' 2.5 ' ELSE CAST(event_id % 11 AS STRING) END AS raw",
    )


@query("norm10", _leaf_sql("({0}) / 10"))
def norm10(t: Tables) -> DataFrame:
    return _leaves(t).selectExpr("event_id", f"{scoring.norm10('raw', text=True)} AS score")


@query("norm3", _leaf_sql("(({0}) - 1) / 2"))
def norm3(t: Tables) -> DataFrame:
    return _leaves(t).selectExpr("event_id", f"{scoring.norm3('raw', text=True)} AS score")


CTES["coherence_raw"] = """
SELECT conv_id, 1.0 + conv_id % 3 AS logical_flow,
  CASE conv_id % 7 WHEN 0 THEN 'bad' WHEN 1 THEN NULL WHEN 2 THEN 'NaN' WHEN 3 THEN '7' WHEN 4 THEN '2.5' WHEN 5 THEN 'true' ELSE '-1' END AS completeness,
  1.0 + count(*) % 3 AS conciseness, CASE WHEN conv_id % 11 = 0 THEN 0.0 ELSE 1.0 END AS topic,
  CASE WHEN count(*) >= 3 AND conv_id % 5 <> 0 THEN CAST((conv_id % 2) / 2.0 AS DOUBLE) END AS retention
FROM conversations GROUP BY conv_id
"""
CTES["coherence_scored"] = """
SELECT conv_id, lf, comp, conc, topic, retention,
  round(CASE WHEN retention IS NULL THEN (lf + comp + conc + topic) / 4 ELSE (lf + comp + conc + topic + retention) / 5 END, 4) AS overall
FROM (SELECT conv_id, CAST((logical_flow - 1) / 2 AS DOUBLE) AS lf,
  CAST(CASE conv_id % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.75 ELSE 0.0 END AS DOUBLE) AS comp,
  CAST((conciseness - 1) / 2 AS DOUBLE) AS conc, CAST(topic AS DOUBLE) AS topic, retention FROM coherence_raw)
"""


@query(
    "coherence_score",
    "SELECT conv_id, lf AS logical_flow, comp AS completeness, conc AS conciseness, topic AS topic_relevance,"
    " retention AS context_retention, overall, round(overall, 3) AS overall_3 FROM coherence_scored",
)
def coherence_score(t: Tables) -> DataFrame:
    return scoring.coherence(t.coherence_raw).drop("retention_na").withColumn("overall_3", F.round("overall", 3))


@query("coherence_pass", f"SELECT conv_id, overall >= {fixed.PASS_COHERENCE} AS passed FROM coherence_scored")
def coherence_pass(t: Tables) -> DataFrame:
    return scoring.coherence(t.coherence_raw).selectExpr("conv_id", f"overall >= {fixed.PASS_COHERENCE} AS passed")


_DEFECTS = [m for names in fixed.MANIFESTATIONS.values() for m in names]
_DEFECT_LIST = ", ".join(f"'{m}'" for m in _DEFECTS)
CTES["defects"] = f"""
SELECT conv_id, unnest(range(conv_id % 6)) AS i, [{_DEFECT_LIST}][(conv_id * 7 + i * 3) % 26 + 1] AS m
FROM (SELECT DISTINCT conv_id FROM conversations)
"""
CTES["convs"] = "SELECT DISTINCT conv_id FROM conversations"


@query(
    "manifestation_score",
    "SELECT c.conv_id, "
    + ", ".join(
        f"CAST(CASE WHEN count(m) FILTER (WHERE m IN ({', '.join(repr(n) for n in names)})) = 0 THEN 3"
        f" WHEN count(m) FILTER (WHERE m IN ({', '.join(repr(n) for n in names)})) <= 2 THEN 2 ELSE 1 END AS INTEGER) AS {group}"
        for group, names in fixed.MANIFESTATIONS.items()
    )
    + " FROM convs c LEFT JOIN defects d ON d.conv_id = c.conv_id GROUP BY c.conv_id",
)
def manifestation_score(t: Tables) -> DataFrame:
    named = (
        t.read("conversations")
        .select("conv_id")
        .distinct()
        .selectExpr(
            "conv_id",
            f"CASE WHEN conv_id % 6 = 0 THEN array() ELSE transform(sequence(0, CAST(conv_id % 6 AS INT) - 1),"
            f" i -> element_at(array({_DEFECT_LIST}), CAST((conv_id * 7 + i * 3) % 26 AS INT) + 1)) END AS manifestations",
        )
    )
    return scoring.manifestation_scores(named).drop("manifestations")


@query(
    "ordering_applicable",
    "SELECT transcript_id, count(*) AS calls, count(*) > 1 AS ordering_applies FROM calls GROUP BY transcript_id",
)
def ordering_applicable(t: Tables) -> DataFrame:
    return t.call_keys.groupBy("transcript_id").agg(
        F.count("*").alias("calls"), F.expr("count(*) > 1").alias("ordering_applies")
    )


# ---- judges ------------------------------------------------------------------------

_LOOSE = (
    "(len(list_filter(failures, lambda f: contains(lower(f), lower(expected_taxonomy)))) > 0 OR contains(lower(rationale), lower(expected_taxonomy)) OR "
    + " OR ".join(
        f"({c} < 0.8 AND (contains('{c}', lower(expected_taxonomy)) OR contains(lower(expected_taxonomy), '{c}')))"
        for c in scoring.ARGUMENTS
    )
    + ")"
)
_STRICT = "len(list_filter(failures, lambda f: contains(f, expected_taxonomy) OR contains(expected_taxonomy, f))) > 0"


@query(
    "discrimination_summary",
    f"""
SELECT judge, round(mc, 3) AS mean_correct, round(mb, 3) AS mean_broken, round(mc - mb, 3) AS gap, hits, broken FROM (
  SELECT judge, coalesce(avg(tc) FILTER (WHERE kind = 'correct'), 0) AS mc, coalesce(avg(tc) FILTER (WHERE kind = 'broken'), 0) AS mb,
    count(*) FILTER (WHERE kind = 'broken' AND {_LOOSE}) AS hits, count(*) FILTER (WHERE kind = 'broken') AS broken
  FROM scored_plain GROUP BY judge)
""",
)
def discrimination_summary(t: Tables) -> DataFrame:
    return judges.discrimination(scored(t, False), ["judge"])


@query(
    "discrimination_verdict",
    f"""
SELECT judge, round(gap, 4) AS gap, min_correct, max_broken, round(min_correct - max_broken, 4) AS separation,
  CASE WHEN gap >= 0.15 AND min_correct > max_broken THEN 'DISCRIMINATES' WHEN gap >= 0.05 THEN 'WEAK/PARTIAL' ELSE 'DOES NOT DISCRIMINATE' END AS verdict
FROM (SELECT judge, avg(tc) FILTER (WHERE kind = 'correct') - avg(tc) FILTER (WHERE kind = 'broken') AS gap,
  min(tc) FILTER (WHERE kind = 'correct') AS min_correct, max(tc) FILTER (WHERE kind = 'broken') AS max_broken FROM scored_plain GROUP BY judge)
""",
)
def discrimination_verdict(t: Tables) -> DataFrame:
    return judges.verdict(scored(t, False), ["judge"])


@query(
    "taxonomy_hits",
    f"SELECT judge, count(*) FILTER (WHERE {_STRICT}) AS hits, count(*) AS broken FROM scored_plain WHERE kind = 'broken' GROUP BY judge",
)
def taxonomy_hits(t: Tables) -> DataFrame:
    broken = scored(t, False).where("kind = 'broken'")
    return broken.groupBy("judge").agg(F.expr(f"count_if({judges.STRICT_HIT})").alias("hits"), F.count("*").alias("broken"))


@query(
    "taxonomy_hits_loose",
    f"SELECT judge, expected_taxonomy, count(*) FILTER (WHERE {_LOOSE}) AS hits, count(*) AS broken"
    " FROM scored_plain WHERE kind = 'broken' GROUP BY judge, expected_taxonomy",
)
def taxonomy_hits_loose(t: Tables) -> DataFrame:
    broken = scored(t, False).where("kind = 'broken'").groupBy("judge", "expected_taxonomy")
    return broken.agg(F.expr(f"count_if({judges.LOOSE_HIT})").alias("hits"), F.count("*").alias("broken"))


@query(
    "false_pass_rate",
    "SELECT judge, count(*) AS broken, count(*) FILTER (WHERE tc >= 0.9) AS passed,"
    " round(CAST(count(*) FILTER (WHERE tc >= 0.9) AS DOUBLE) / count(*), 4) AS rate"
    " FROM scored_plain WHERE kind = 'broken' GROUP BY judge",
)
def false_pass_rate(t: Tables) -> DataFrame:
    broken = scored(t, False).where("kind = 'broken'").groupBy("judge")
    counts = broken.agg(F.count("*").alias("broken"), F.expr(f"count_if(tc >= {fixed.FALSE_PASS})").alias("passed"))
    return counts.withColumn("rate", F.expr("round(passed / broken, 4)"))


CTES["judge_pair"] = """
SELECT a.call_id, a.tc AS tc_a, b.tc AS tc_b FROM scored_plain a JOIN scored_plain b ON a.call_id = b.call_id
WHERE a.judge = 'judge_a' AND b.judge = 'judge_b'
"""


def _pairs(t: Tables) -> DataFrame:
    return judges.pairs(scored(t, False), "judge_a", "judge_b")


@query("judge_pairs", "SELECT call_id, tc_a, tc_b, round(tc_a - tc_b, 4) AS difference FROM judge_pair")
def judge_pairs(t: Tables) -> DataFrame:
    return _pairs(t).withColumn("difference", F.expr("round(tc_a - tc_b, 4)"))


@query("judge_pearson", "SELECT count(*) AS n, round(corr(tc_a, tc_b), 6) AS pearson FROM judge_pair")
def judge_pearson(t: Tables) -> DataFrame:
    return judges.pearson(_pairs(t))


@query(
    "judge_spearman",
    """
SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM (
  SELECT rank() OVER (ORDER BY tc_a) + (count(*) OVER (PARTITION BY tc_a) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY tc_b) + (count(*) OVER (PARTITION BY tc_b) - 1) / 2.0 AS rb FROM judge_pair)
""",
)
def judge_spearman(t: Tables) -> DataFrame:
    return judges.spearman(_pairs(t))


CTES["server_means"] = """
SELECT s.server, avg(p.tc) AS mean_tc, avg(p.tc) FILTER (WHERE judge = 'judge_a') AS mean_a, avg(p.tc) FILTER (WHERE judge = 'judge_b') AS mean_b
FROM scored_plain p JOIN servers s ON s.tool_name = p.tool_name GROUP BY s.server
"""


def _server_means(t: Tables) -> DataFrame:
    """Per-tool sums first, so the join to servers sees one row per tool."""
    sums = scored(t, False).groupBy("tool_name", "judge").agg(F.sum("tc").alias("total"), F.count("tc").alias("n"))
    tools = t.media_spec.checked().tools.select("tool_name", "server")
    mean = lambda cond: f"sum(total) FILTER (WHERE {cond}) / sum(n) FILTER (WHERE {cond})"
    return (
        sums.join(F.broadcast(tools), "tool_name")
        .groupBy("server")
        .agg(
            F.expr("sum(total) / sum(n)").alias("mean_tc"),
            F.expr(mean("judge = 'judge_a'")).alias("mean_a"),
            F.expr(mean("judge = 'judge_b'")).alias("mean_b"),
        )
    )


@query(
    "server_ranking",
    "SELECT server, round(mean_tc, 6) AS mean_tc, CAST(rank() OVER (ORDER BY mean_tc DESC) AS INTEGER) AS place FROM server_means",
)
def server_ranking(t: Tables) -> DataFrame:
    ranked = judges.ranking(_server_means(t).select("server", "mean_tc"), "mean_tc", "place")
    return ranked.selectExpr("server", "round(mean_tc, 6) AS mean_tc", "place")


@query(
    "server_spearman",
    """
SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman
FROM (SELECT rank() OVER (ORDER BY mean_a) AS ra, rank() OVER (ORDER BY mean_b) AS rb FROM server_means)
""",
)
def server_spearman(t: Tables) -> DataFrame:
    means = _server_means(t).selectExpr("round(mean_a, 12) AS tc_a", "round(mean_b, 12) AS tc_b")
    return judges.spearman(means, four_decimals=False)


@query(
    "failure_counts",
    "SELECT judge, failure, count(*) AS n FROM (SELECT judge, unnest(failures) AS failure FROM scored_plain) GROUP BY judge, failure",
)
def failure_counts(t: Tables) -> DataFrame:
    named = scored(t, False).select("judge", F.explode("failures").alias("failure"))
    return named.groupBy("judge", "failure").agg(F.count("*").alias("n"))


CTES["scored_errors"] = "SELECT call_id, judge, CASE WHEN call_id % 101 = 0 AND judge = 'judge_b' THEN NULL ELSE tc END AS tc FROM scored_plain"


@query(
    "score_pivot",
    """
SELECT call_id, coalesce(CAST(CAST(max(tc) FILTER (WHERE judge = 'judge_a') AS DECIMAL(6,4)) AS VARCHAR), 'ERR') AS judge_a,
  coalesce(CAST(CAST(max(tc) FILTER (WHERE judge = 'judge_b') AS DECIMAL(6,4)) AS VARCHAR), 'ERR') AS judge_b
FROM scored_errors GROUP BY call_id
""",
)
def score_pivot(t: Tables) -> DataFrame:
    marked = scored(t, False).selectExpr(
        "call_id", "judge", "CASE WHEN call_id % 101 = 0 AND judge = 'judge_b' THEN NULL ELSE tc END AS tc"
    )
    wide = marked.groupBy("call_id").pivot("judge", ["judge_a", "judge_b"]).agg(F.max("tc"))
    shown = "coalesce(CAST(CAST({0} AS DECIMAL(6,4)) AS STRING), 'ERR') AS {0}"
    return wide.selectExpr("call_id", shown.format("judge_a"), shown.format("judge_b"))


@query(
    "worst_cases",
    """
SELECT server, call_id, judge, tc, CAST(place AS INTEGER) AS place FROM (
  SELECT s.server, p.call_id, p.judge, p.tc, row_number() OVER (PARTITION BY s.server ORDER BY p.tc, p.call_id, p.judge) AS place
  FROM scored_lint p JOIN servers s ON s.tool_name = p.tool_name) WHERE place <= 5
""",
)
def worst_cases(t: Tables) -> DataFrame:
    tools = t.media_spec.checked().tools.select("tool_name", "server")
    rows = scored(t, True).join(F.broadcast(tools), "tool_name").select("server", "call_id", "judge", "tc")
    return judges.worst(rows, "server", ["tc", "call_id", "judge"], 5)


# ---- gates -----------------------------------------------------------------------------


@query(
    "case_pass",
    f"""
SELECT s.call_id, s.judge, s.tc, v.call_id IS NULL AND s.tc >= {fixed.PASS_TOOL_CALLING} AS passed
FROM scored_lint s LEFT JOIN (SELECT DISTINCT call_id FROM violations) v ON v.call_id = s.call_id
""",
)
def case_pass(t: Tables) -> DataFrame:
    verdicts = lint.call_verdicts(t.calls_unordered, t.media_spec)
    done = gates.case_pass(t.judge_scores, verdicts)
    return done.select("call_id", "judge", "tc", "passed")


@query("score_gate", "SELECT call_id, judge, tc FROM scored_lint WHERE tc < 0.85")
def score_gate(t: Tables) -> DataFrame:
    return gates.below_minimum(scored(t, True), "tc").select("call_id", "judge", "tc")


@query(
    "suite_gate",
    """
SELECT judge, round(mean_tc, 4) AS mean_tc, collapsed, mean_tc >= 0.95 AND collapsed = 0 AS passed FROM (
  SELECT judge, avg(tc) AS mean_tc, count(*) FILTER (WHERE arguments <= 0.333) AS collapsed
  FROM scored_lint WHERE kind = 'correct' GROUP BY judge)
""",
)
def suite_gate(t: Tables) -> DataFrame:
    return gates.suite(scored(t, True).where("kind = 'correct'"), ["judge"])


CTES["deltas"] = """
SELECT l.call_id, l.judge, l.tc, p.tc AS tc_base, round(l.tc - p.tc, 4) AS delta
FROM scored_lint l JOIN scored_plain p ON p.call_id = l.call_id AND p.judge = l.judge
"""


def _deltas(t: Tables) -> DataFrame:
    return judges.run_delta(scored(t, True), scored(t, False), ["call_id", "judge"])


@query("run_delta", "SELECT call_id, judge, tc, tc_base, delta FROM deltas")
def run_delta(t: Tables) -> DataFrame:
    return _deltas(t)


@query("regression_gate", "SELECT call_id, judge, tc, tc_base, delta FROM deltas WHERE delta < -0.05")
def regression_gate(t: Tables) -> DataFrame:
    return gates.regressions(_deltas(t))


@query(
    "consensus_gate",
    """
SELECT a.call_id, least(a.tc, b.tc) AS lowest, a.collapsed <> 'none' OR b.collapsed <> 'none' AS collapsed,
  least(a.tc, b.tc) < 0.9 OR a.collapsed <> 'none' OR b.collapsed <> 'none' AS blocked
FROM scored_plain a JOIN scored_plain b ON a.call_id = b.call_id AND a.judge = 'judge_a' AND b.judge = 'judge_b'
""",
)
def consensus_gate(t: Tables) -> DataFrame:
    return gates.consensus(scored(t, False))


# ---- intervals ----------------------------------------------------------------------------

CTES["poisson_draws"] = (
    "SELECT * FROM (VALUES (0, 1::BIGINT, 1::BIGINT, 0::BIGINT), "
    + ", ".join(f"({r}, {a}, {b}, {c})" for r, (a, b, c) in enumerate(intervals.multipliers(), 1))
    + ") d(replicate, a, b, c)"
)
_PART = f"CAST('0x' || substr(md5(CAST(call_id AS VARCHAR)), {{0}}, 8) AS BIGINT) % {intervals.PRIME}"
_DRAW = f"(({_PART.format(1)}) * a % {intervals.PRIME} + ({_PART.format(9)}) * b % {intervals.PRIME} + c) % {intervals.PRIME}"
_TIMES = " + ".join(f"CAST(u >= {t} AS BIGINT)" for t in intervals.thresholds())


def _weighed(table: str, kept: str) -> str:
    return (
        f"SELECT {kept}, replicate, CASE WHEN replicate = 0 THEN 1 ELSE {_TIMES} END AS w"
        f" FROM (SELECT *, {_DRAW} AS u FROM {table}, poisson_draws)"
    )


def _bounds(name: str) -> str:
    end = lambda share: f"round(quantile_cont(CASE WHEN replicate > 0 THEN {name} END, {share}), 6)"
    return f"round(max(CASE WHEN replicate = 0 THEN {name} END), 6) AS {name}, {end(0.025)} AS {name}_low, {end(0.975)} AS {name}_high"


CTES["weighed_scores"] = _weighed("scored_plain", "judge, kind, CAST(round(tc * 10000) AS BIGINT) AS s")
CTES["weighed_pairs"] = _weighed("judge_pair", "CAST(round(tc_a * 10000) AS BIGINT) AS x, CAST(round(tc_b * 10000) AS BIGINT) AS y")


@query(
    "judge_intervals",
    f"""
SELECT judge, {_bounds('gap')}, {_bounds('false_pass')} FROM (
  SELECT judge, replicate,
    CAST(sum(w * s) FILTER (WHERE kind = 'correct') AS DOUBLE) / (nullif(CAST(sum(w) FILTER (WHERE kind = 'correct') AS DOUBLE), 0) * 10000)
    - CAST(sum(w * s) FILTER (WHERE kind = 'broken') AS DOUBLE) / (nullif(CAST(sum(w) FILTER (WHERE kind = 'broken') AS DOUBLE), 0) * 10000) AS gap,
    CAST(coalesce(sum(w) FILTER (WHERE kind = 'broken' AND s >= 9000), 0) AS DOUBLE) / nullif(CAST(sum(w) FILTER (WHERE kind = 'broken') AS DOUBLE), 0) AS false_pass
  FROM weighed_scores GROUP BY judge, replicate)
GROUP BY judge
""",
)
def judge_intervals(t: Tables) -> DataFrame:
    """How sure the gap and the false pass rate of each judge are."""
    return intervals.judge_intervals(scored(t, False), ["judge"], fixed.FALSE_PASS)


@query(
    "agreement_intervals",
    f"""
SELECT {_bounds('pearson')} FROM (
  SELECT replicate, CAST(n * xy - x * y AS DOUBLE) / nullif(sqrt(CAST(n * xx - x * x AS DOUBLE)) * sqrt(CAST(n * yy - y * y AS DOUBLE)), 0) AS pearson
  FROM (SELECT replicate, sum(w) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * y * y) AS yy, sum(w * x * y) AS xy
    FROM weighed_pairs GROUP BY replicate))
""",
)
def agreement_intervals(t: Tables) -> DataFrame:
    """How sure the correlation of the two judges is."""
    return intervals.agreement_intervals(_pairs(t))


_MARKS = ", ".join(f"('{i}', '{b}', {t}::DOUBLE, {a}::DOUBLE)" for i, b, t, a in fixed.INDICATORS)


@query(
    "indicator_gates",
    f"""
SELECT indicator, scope, value, target, alert,
  CASE WHEN value IS NULL THEN 'unknown' WHEN (bound = 'most' AND value > alert) OR (bound = 'least' AND value < alert) THEN 'alert'
    WHEN (bound = 'most' AND value > target) OR (bound = 'least' AND value < target) THEN 'short' ELSE 'met' END AS state
FROM (
  SELECT 'false_pass_rate' AS indicator, judge AS scope, round(CAST(count(*) FILTER (WHERE tc >= 0.9) AS DOUBLE) / count(*), 4) AS value FROM scored_plain WHERE kind = 'broken' GROUP BY judge
  UNION ALL SELECT 'discrimination_gap', judge, round(coalesce(avg(tc) FILTER (WHERE kind = 'correct'), 0) - coalesce(avg(tc) FILTER (WHERE kind = 'broken'), 0), 3) FROM scored_plain GROUP BY judge
  UNION ALL SELECT 'lint_coverage', 'all', round(CAST(count(DISTINCT v.call_id) AS DOUBLE) / count(DISTINCT c.call_id), 4) FROM calls c LEFT JOIN violations v USING (call_id) WHERE c.fault_no < 13
  UNION ALL SELECT 'grounding_ratio', 'all', round(avg(CASE WHEN confidence = 'high' THEN 1.0 ELSE 0.0 END), 4) FROM spec_grounded
  UNION ALL SELECT 'judge_correlation', 'all', round(corr(tc_a, tc_b), 6) FROM judge_pair) i
JOIN (VALUES {_MARKS}) m(indicator, bound, target, alert) USING (indicator)
""",
)
def indicator_gates(t: Tables) -> DataFrame:
    """All indicators of a run in one table, each against its target and alert mark."""
    scores = scored(t, False)
    _, steps = generation.scenarios(registry_rows(t))
    coverage = gates.lint_coverage(t.calls_unordered.where("fault_no < 13"), t.media_spec)
    parts = [
        false_pass_rate(t).selectExpr("'false_pass_rate' AS indicator", "judge AS scope", "rate AS value"),
        judges.discrimination(scores, ["judge"]).selectExpr("'discrimination_gap'", "judge", "gap"),
        coverage.selectExpr("'lint_coverage'", "'all'", "coverage"),
        generation.grounding_ratio(generation.ground(steps, t.spec_seeds)).selectExpr("'grounding_ratio'", "'all'", "ratio"),
        judges.pearson(_pairs(t)).selectExpr("'judge_correlation'", "'all'", "pearson"),
    ]
    values = parts[0]
    for part in parts[1:]:
        values = values.union(part)
    return gates.indicators(values)


@query("agreement_alert", "SELECT round(corr(tc_a, tc_b), 6) AS pearson, corr(tc_a, tc_b) < 0.80 AS alert FROM judge_pair")
def agreement_alert(t: Tables) -> DataFrame:
    return judges.pearson(_pairs(t)).selectExpr("pearson", f"pearson < {fixed.AGREEMENT_ALERT} AS alert")


@query(
    "evaluation_report",
    """
SELECT l.transcript_id, l.total_calls, l.total_violations, l.is_valid, round(s.mean_tc, 8) AS mean_tc, s.min_tc, s.cases
FROM lint_by_transcript l LEFT JOIN (SELECT transcript_id, avg(tc) AS mean_tc, min(tc) AS min_tc, count(*) AS cases
  FROM scored_lint GROUP BY transcript_id) s USING (transcript_id)
""",
)
def evaluation_report(t: Tables) -> DataFrame:
    return evaluation.report(t.calls_unordered, t.media_spec, t.judge_scores)
