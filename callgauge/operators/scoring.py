"""Rubric scores: normalisation, cascading collapse, averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge import fixed

ARGUMENTS = (
    "completeness",
    "name_accuracy",
    "value_accuracy",
    "type_compliance",
    "format_compliance",
    "relevancy",
)
SELECTION = ("sel_correctness", "sel_specificity", "sel_completeness")
ORDERING = ("sequence_logic", "dependency_handling", "execution_efficiency")


def number(raw: str) -> str:
    """A raw score as double: numeric text is parsed, true counts as 1, other text is NULL."""
    text = f"trim(CAST({raw} AS STRING))"
    return f"CASE lower({text}) WHEN 'true' THEN 1D WHEN 'false' THEN 0D ELSE try_cast({text} AS DOUBLE) END"


def _scaled(raw: str, scale: str, text: bool) -> str:
    value = number(raw) if text else f"CAST({raw} AS DOUBLE)"
    shown = scale.format(f"({value})")
    # NaN is above infinity in this order, so one comparison leaves out both.
    return (
        f"CASE WHEN {raw} IS NULL THEN 1D WHEN abs({value}) < double('infinity')"
        f" THEN greatest(0D, least(1D, {shown})) ELSE 0D END"
    )


def norm10(raw: str, text: bool = False, whole: bool = False) -> str:
    """0-10 to 0-1; a missing score is full, one that is no finite number is 0."""
    if whole:
        return f"CASE WHEN {raw} IS NULL THEN 1D ELSE greatest(0D, least(1D, {raw} / 10)) END"
    return _scaled(raw, "{0} / 10", text)


def norm3(raw: str, text: bool = False) -> str:
    """1-3 to 0-1."""
    return _scaled(raw, "({0} - 1) / 2", text)


def _any_word(words: tuple[str, ...]) -> str:
    hits = " OR ".join(f"contains(lower(f), '{w}')" for w in words)
    return f"exists(failures, f -> {hits})"


def collapse(raw: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Cascading penalties on raw argument sub-scores.

    ``raw`` has call_id, failures array<string> and the six argument columns;
    ``verdicts`` (call_id, name_fault, value_fault, n_violations) comes from the linter
    and may be left out, also where ``raw`` holds its columns already. Adds ``collapsed``: name, value or none.
    """
    if verdicts is None and "name_fault" in raw.columns:
        frame = raw
    elif verdicts is None:
        frame = raw.withColumns({"name_fault": F.lit(False), "value_fault": F.lit(False)})
    else:
        frame = raw.join(verdicts, "call_id", "left")
    frame = frame.withColumn("failures", F.expr("coalesce(failures, array())"))
    frame = frame.withColumn(
        "collapsed",
        F.expr(
            f"CASE WHEN coalesce(name_fault, false) OR {_any_word(fixed.NAME_WORDS)} OR coalesce(name_accuracy <= 2, false)"
            f" THEN 'name' WHEN coalesce(value_fault, false) OR {_any_word(fixed.VALUE_WORDS)}"
            " OR coalesce(value_accuracy <= 2, false) THEN 'value' ELSE 'none' END"
        ),
    )
    by_name = {"completeness", "name_accuracy"}
    lowered = {
        c: F.expr(f"CASE WHEN collapsed = 'name'{'' if c in by_name else ' OR collapsed = ' + repr('value')} THEN 0 ELSE {c} END")
        for c in ARGUMENTS[:-1]
    }
    lowered["relevancy"] = F.expr("CASE WHEN collapsed <> 'none' THEN least(coalesce(relevancy, 2), 2) ELSE relevancy END")
    mark = "concat('argument_', collapsed, '_collapse')"
    lowered["failures"] = F.expr(
        f"CASE WHEN collapsed = 'none' OR array_contains(failures, {mark}) THEN failures"
        f" ELSE concat(failures, array({mark})) END"
    )
    return frame.withColumns(lowered).drop("name_fault", "value_fault")


def tool_calling(raw: DataFrame, ordering: str = "false") -> DataFrame:
    """Scores per row: the sub-scores on 0-1, four dimensions and ``overall``.

    ``ordering`` is the condition under which the ordering dimension counts.
    Overuse is kept but not averaged.
    """
    have = set(raw.columns)
    parts = ("necessity", *SELECTION, *ARGUMENTS)
    whole = {c for c, kind in raw.dtypes if kind in ("int", "bigint", "smallint", "tinyint")}
    scale = lambda c: F.expr(norm10(c, whole=c in whole))
    scaled = {c: scale(c) if c in have else F.lit(1.0) for c in parts}
    scaled["overuse"] = scale("overuse") if "overuse" in have else F.lit(0.0)
    scaled["_ordered"] = F.expr(f"coalesce({ordering}, false)")
    frame = raw.withColumns(scaled)
    frame = frame.withColumns(
        {c: F.expr(f"CASE WHEN _ordered THEN {norm10(c, whole=c in whole)} END") if c in have else F.expr("CASE WHEN _ordered THEN 1D END") for c in ORDERING}
    )
    mean = lambda names: f"({' + '.join(names)}) / {len(names)}"
    frame = frame.withColumns(
        {
            "usage": F.col("necessity"),
            "selection": F.expr(mean(SELECTION)),
            "arguments": F.expr(mean(ARGUMENTS)),
            "ordering": F.expr(mean(ORDERING)),
        }
    )
    overall = "round(CASE WHEN _ordered THEN (usage + selection + arguments + ordering) / 4 ELSE (usage + selection + arguments) / 3 END, 4)"
    return frame.withColumn("overall", F.expr(overall)).drop("_ordered")


def coherence(raw: DataFrame) -> DataFrame:
    """Coherence per row from raw 1-3 scores, given as numbers (NaN: no number) or as text.

    ``retention_na`` tells that context retention does not apply.
    """
    four = ("logical_flow", "completeness", "conciseness", "topic_relevance")
    frame = raw.withColumns(
        {
            **{c: F.expr(norm3(c, text=True)) for c in four},
            "context_retention": F.expr(
                "CASE WHEN NOT coalesce(retention_na, true) AND context_retention IS NOT NULL"
                f" THEN {norm3('context_retention', text=True)} END"
            ),
        }
    )
    total = " + ".join(four)
    return frame.withColumn(
        "overall",
        F.expr(
            f"round(CASE WHEN context_retention IS NULL THEN ({total}) / 4"
            f" ELSE ({total} + context_retention) / 5 END, 4)"
        ),
    )


def manifestation_scores(rows: DataFrame) -> DataFrame:
    """1-3 score per coherence group from named defects: none is 3, one or two 2, more 1."""
    out = {}
    for group, names in fixed.MANIFESTATIONS.items():
        listed = ", ".join(f"'{n}'" for n in names)
        count = f"size(filter(manifestations, m -> m IN ({listed})))"
        out[group] = F.expr(f"CASE WHEN {count} = 0 THEN 3 WHEN {count} <= 2 THEN 2 ELSE 1 END")
    return rows.withColumns(out)
