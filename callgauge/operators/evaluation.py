"""From judge replies to a verdict per case: parse, collapse, average, pass mark; and the same for whole conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge import fixed
from callgauge.operators import gates, lint, scoring
from callgauge.operators.lint import Spec
from callgauge.operators.replies import raw_coherence, raw_scores

RESULT = ("usage", "selection", "arguments", "ordering", "tc", "collapsed", "n_violations", "passed", "rationale")


def evaluate(calls: DataFrame, spec: Spec, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of judge replies (call_id, reply, and any keys).

    Each reply is scored with the lint verdict of its call. A reply without JSON is
    kept in ``rejects`` and not scored. Scoring is a job of its own: it waits for no
    model.
    """
    parsed = raw_scores(replies)
    verdicts = lint.call_verdicts(calls, spec)
    done = gates.case_pass(parsed.where("NOT rejected").drop("rejected"), verdicts, "NOT ordering_na")
    keys = [c for c in replies.columns if c != "reply"]
    results = done.withColumn("n_violations", F.coalesce("n_violations", F.lit(0))).select(*keys, *RESULT)
    return results, parsed.where("rejected").select(*keys)


def report(calls: DataFrame, spec: Spec, raw: DataFrame, ordering: str = "false") -> DataFrame:
    """Per transcript: calls, violations, and the scores of its judged cases, from one lint of the calls.

    raw: call_id, judge and raw scores (see ``scoring.collapse``). A transcript without scores has NULL means.
    """
    verdicts = lint.call_verdicts(calls, spec)
    judged = calls.select("call_id", "transcript_id").join(verdicts, "call_id").join(raw.drop("transcript_id"), "call_id", "left")
    scored = scoring.tool_calling(scoring.collapse(judged), ordering)
    case = F.when(F.col("judge").isNotNull(), F.col("overall"))
    per_call = scored.groupBy("call_id", "transcript_id").agg(
        F.first("n_violations").alias("n_violations"), F.sum(case).alias("total"), F.min(case).alias("low"), F.count(case).alias("n")
    )
    return per_call.groupBy("transcript_id").agg(
        F.count("*").alias("total_calls"),
        F.sum("n_violations").alias("total_violations"),
        F.expr("sum(n_violations) = 0").alias("is_valid"),
        F.expr("round(try_divide(sum(total), sum(n)), 8)").alias("mean_tc"),
        F.min("low").alias("min_tc"),
        F.expr("nullif(sum(n), 0)").alias("cases"),
    )


COHERENCE = ("logical_flow", "completeness", "conciseness", "topic_relevance", "context_retention", "overall", "passed", "rationale")


def evaluate_coherence(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of coherence replies (reply, and any keys); a reply without JSON is rejected and not scored."""
    parsed = raw_coherence(replies)
    keys = [c for c in replies.columns if c != "reply"]
    scored = scoring.coherence(parsed.where("NOT rejected"))
    results = scored.withColumn("passed", F.col("overall") >= fixed.PASS_COHERENCE).select(*keys, *COHERENCE)
    return results, parsed.where("rejected").select(*keys)
