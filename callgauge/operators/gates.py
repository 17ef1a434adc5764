"""Pass marks, quarantine and regression gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge import fixed
from callgauge.operators.lint import Spec, call_verdicts, flag_frame, violations
from callgauge.operators.scoring import collapse, tool_calling
from callgauge.session import literal_table


def quarantine(calls: DataFrame, spec: Spec) -> DataFrame:
    """Each call with its violations; a call with any is quarantined."""
    per_call = flag_frame(calls, spec).groupBy("call_id", "transcript_id").agg(F.expr("sum(n_found)").alias("n_violations"))
    return per_call.selectExpr("call_id", "transcript_id", "n_violations > 0 AS quarantined", "n_violations")


def assert_valid(calls: DataFrame, spec: Spec, shown: int = 20) -> None:
    """Raise when any call has a violation, naming the first few of them."""
    found = violations(calls, spec)
    first = found.orderBy("call_id", "phase", "parameter_name").limit(shown).collect()
    if first:
        lines = [f"  - [{v.rule_id}] {v.tool_name}.{v.parameter_name}: {v.message}" for v in first]
        raise AssertionError(f"tool calls failed lint with {found.count()} violation(s):\n" + "\n".join(lines))


def lint_coverage(broken: DataFrame, spec: Spec) -> DataFrame:
    """Share of known-broken calls that have at least one violation."""
    return (
        call_verdicts(broken, spec)
        .agg(F.count("*").alias("broken"), F.expr("count_if(n_violations > 0)").alias("caught"))
        .withColumn("coverage", F.round(F.col("caught") / F.col("broken"), 4))
    )


def below_minimum(scores: DataFrame, score: str, minimum: float = fixed.PASS_TOOL_CALLING) -> DataFrame:
    """The rows under a minimum score; a row without a score counts as 0."""
    return scores.where(F.coalesce(F.col(score), F.lit(0.0)) < minimum)


def assert_minimum(scores: DataFrame, score: str, minimum: float = fixed.PASS_TOOL_CALLING) -> None:
    low = below_minimum(scores, score, minimum).count()
    if low:
        raise AssertionError(f"{low} case(s) score below {minimum:.3f}")


def case_pass(raw_scores: DataFrame, verdicts: DataFrame, ordering: str = "false") -> DataFrame:
    """Score each case with its lint verdict; it passes when lint is clean and the score is high enough."""
    done = tool_calling(collapse(raw_scores, verdicts), ordering).withColumnRenamed("overall", "tc")
    return done.withColumn("passed", F.expr(f"coalesce(n_violations, 0) = 0 AND tc >= {fixed.PASS_TOOL_CALLING}"))


def suite(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean score and number of collapsed cases of a golden suite against both gates."""
    stats = scores.groupBy(*by).agg(
        F.avg("tc").alias("mean"), F.expr(f"count_if(arguments <= {fixed.COLLAPSED_ARGUMENTS})").alias("collapsed")
    )
    return stats.selectExpr(
        *by, "round(mean, 4) AS mean_tc", "collapsed", f"mean >= {fixed.SUITE_MEAN} AND collapsed = 0 AS passed"
    )


def regressions(deltas: DataFrame) -> DataFrame:
    """Cases that lost more than the allowed drop against their baseline."""
    return deltas.where(F.col("delta") < -fixed.MAX_DROP)


def consensus(scores: DataFrame) -> DataFrame:
    """Block a case when any judge scores it under the floor or sees a collapse."""
    per_case = scores.groupBy("call_id").agg(
        F.min("tc").alias("lowest"), F.expr("bool_or(collapsed <> 'none')").alias("collapsed")
    )
    return per_case.withColumn("blocked", F.expr(f"lowest < {fixed.JUDGE_FLOOR} OR collapsed"))


def indicators(values: DataFrame) -> DataFrame:
    """Rows (indicator, scope, value) against target and alert mark; state is met, short, alert or, without a value, unknown.

    "short" misses the target and is not yet an alert. Indicators without a mark are left out.
    """
    marks = literal_table(values.sparkSession, list(fixed.INDICATORS), "indicator string, bound string, target double, alert double")
    held = values.join(F.broadcast(marks), "indicator")  # a fixed handful of rows
    worse = lambda mark: f"IF(bound = 'most', value > {mark}, value < {mark})"
    state = f"CASE WHEN value IS NULL THEN 'unknown' WHEN {worse('alert')} THEN 'alert' WHEN {worse('target')} THEN 'short' ELSE 'met' END"
    return held.selectExpr("indicator", "scope", "value", "target", "alert", f"{state} AS state")
