"""Stage rows (scenarios, mock calls, turns, scores) from JSON, with the aliases they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.functions.variants import kind


def _text(variant: str, key: str, default: str = "''") -> str:
    return f"coalesce(try_variant_get({variant}, '$.{key}', 'string'), {default})"


def _either(variant: str, first: str, second: str, keys: str) -> str:
    """The first key where it is present, else the second."""
    get = lambda k: f"try_variant_get({variant}, '$.{k}', 'variant')"
    return f"CASE WHEN array_contains({keys}, '{first}') THEN {get(first)} ELSE {get(second)} END"


def interpretation_rows(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Interpretations; a lone context text becomes a list of one."""
    v = docs.selectExpr("*", f"parse_json({column}) AS _v").selectExpr(
        "*", "try_variant_get(_v, '$.enterprise_context', 'variant') AS _ctx"
    )
    context = (
        f"CASE {kind('_ctx')} WHEN 'STR' THEN filter(array(CAST(_ctx AS STRING)), c -> c <> '')"
        " WHEN 'ARR' THEN CAST(_ctx AS array<string>) ELSE"
        " CASE WHEN _ctx IS NULL THEN array() ELSE array(to_json(_ctx)) END END"
    )
    kept = [c for c in docs.columns if c != column]
    names = ("tool_name", "what_it_does", "what_it_needs", "why_its_used")
    return v.selectExpr(*kept, *[f"{_text('_v', n)} AS {n}" for n in names], f"{context} AS enterprise_context")


def step_rows(docs: DataFrame, column: str, list_key: str) -> DataFrame:
    """Workflow steps or mock calls under ``list_key`` of each document, in order."""
    v = docs.selectExpr("*", f"try_variant_get(parse_json({column}), '$.{list_key}', 'variant') AS _steps")
    each = docs.sparkSession.tvf.variant_explode(F.col("_steps").outer()).selectExpr("pos AS step_index", "value AS _s")
    kept = [c for c in docs.columns if c != column]
    rows = v.lateralJoin(each).selectExpr(*kept, "step_index", "_s", "json_object_keys(to_json(_s)) AS _k")
    return rows.selectExpr(
        *kept,
        "step_index",
        f"coalesce(try_cast({_either('_s', 'function_name', 'name', '_k')} AS STRING), '') AS tool_name",
        f"CASE WHEN {kind(_either('_s', 'parameters', 'arguments', '_k'))} = 'OBJ'"
        f" THEN to_json({_either('_s', 'parameters', 'arguments', '_k')}) ELSE '{{}}' END AS parameters",
        f"{_text('_s', 'quick_explanation')} AS quick_explanation",
        "to_json(try_variant_get(_s, '$.mock_output', 'variant')) AS mock_output",
        f"{_text('_s', 'confidence', repr('medium'))} AS confidence",
    )


def scenario_rows(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Scenarios of documents ``{tier: {"categories": [{category, scenarios: [..]}]}}``.

    One row per scenario: tier, category, title, prompt, agent_followup, and the
    scenario object itself for its steps.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != column]
    v = docs.selectExpr("*", f"parse_json({column}) AS _doc")
    tier = spark.tvf.variant_explode(F.col("_doc").outer()).selectExpr(
        "key AS tier", "try_variant_get(value, '$.categories', 'variant') AS _cats"
    )
    v = v.lateralJoin(tier)
    category = spark.tvf.variant_explode(F.col("_cats").outer()).selectExpr(
        "pos AS category_pos",
        "coalesce(try_variant_get(value, '$.category', 'string'), 'General') AS category",
        "try_variant_get(value, '$.scenarios', 'variant') AS _list",
    )
    v = v.lateralJoin(category)
    scenario = spark.tvf.variant_explode(F.col("_list").outer()).selectExpr("pos AS scenario_pos", "value AS _s")
    return v.lateralJoin(scenario).selectExpr(
        *kept, "tier", "category", "category_pos", "scenario_pos",
        f"{_text('_s', 'title', repr('Untitled Scenario'))} AS title", f"{_text('_s', 'prompt')} AS prompt",
        f"{_text('_s', 'novelty_reason')} AS novelty_reason", f"{_text('_s', 'agent_followup')} AS agent_followup",
        "to_json(_s) AS scenario",
    )


def turn_rows(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Turns of transcript documents; a missing index is the position plus one."""
    v = docs.selectExpr("*", f"parse_json({column}) AS _v")
    v = v.selectExpr("*", "try_variant_get(_v, '$.turns', 'variant') AS _turns")
    each = docs.sparkSession.tvf.variant_explode(F.col("_turns").outer()).selectExpr("pos AS _pos", "value AS _t")
    kept = [c for c in docs.columns if c != column]
    return v.lateralJoin(each).selectExpr(
        *kept,
        f"{_text('_v', 'scenario_title')} AS scenario_title",
        f"{_text('_v', 'tier', repr('simple'))} AS tier",
        "coalesce(try_variant_get(_t, '$.turn_index', 'int'), _pos + 1) AS turn_index",
        f"{_text('_t', 'user_message')} AS user_message",
        "coalesce(size(try_variant_get(_t, '$.agent_tool_calls', 'array<variant>')), 0) AS n_calls",
        *[f"to_json(coalesce(try_variant_get(_t, '$.{c}', 'variant'), parse_json('[]'))) AS {c}" for c in ("agent_tool_calls", "tool_responses")],
        f"{_text('_t', 'agent_response')} AS agent_response",
    )


def score_rows(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Saved scores; argument sub-scores may be nested under ``arguments``."""
    v = docs.selectExpr("*", f"parse_json({column}) AS _v")
    get = lambda path: f"try_variant_get(_v, '$.{path}', 'double')"
    nested = {"args_completeness": "arguments.completeness"}
    for name in ("name_accuracy", "value_accuracy", "type_compliance", "format_compliance", "relevancy"):
        nested[name] = f"arguments.{name}"
    kept = [c for c in docs.columns if c != column]
    return v.selectExpr(
        *kept,
        f"coalesce({get('necessity')}, 1D) AS necessity",
        f"coalesce({get('overuse_detection')}, 0D) AS overuse_detection",
        *[f"coalesce({get(n)}, 1D) AS {n}" for n in ("correctness", "specificity", "completeness_selection")],
        *[f"{get(n)} AS {n}" for n in ("sequence_logic", "dependency_handling", "execution_efficiency")],
        *[f"coalesce({get(n)}, {get(path)}, 1D) AS {n}" for n, path in nested.items()],
        f"coalesce({get('overall_tool_calling')}, {get('tc_overall')}, 1D) AS overall_tool_calling",
        f"coalesce({get('overall_coherence')}, {get('coh_overall')}, 1D) AS overall_coherence",
        "array_join(coalesce(try_variant_get(_v, '$.failures', 'array<string>'), array()), '|') AS failures",
    )


def turn_calls(turns: DataFrame, keys: list[str]) -> DataFrame:
    """The calls inside the turns of ``turn_rows``, one row each: keys, turn_index, step_index, tool_name, parameters.

    They are what lint, rendering and export work on after a saved transcript is loaded.
    """
    docs = turns.selectExpr(*keys, "turn_index", "concat('{\"calls\":', agent_tool_calls, '}') AS doc")
    return step_rows(docs, "doc", "calls").where("step_index IS NOT NULL").select(*keys, "turn_index", "step_index", "tool_name", "parameters")


def violation_rows(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Saved violations; ``parameter`` and ``category`` are other names of parameter_name and rule_id."""
    v = docs.selectExpr("*", f"parse_json({column}) AS _v")
    first = lambda *keys: ", ".join(f"nullif(try_variant_get(_v, '$.{k}', 'string'), '')" for k in keys)
    kept = [c for c in docs.columns if c != column]
    return v.selectExpr(
        *kept,
        "coalesce(try_variant_get(_v, '$.call_index', 'int'), 0) AS call_index",
        f"{_text('_v', 'tool_name')} AS tool_name",
        f"coalesce({first('parameter_name', 'parameter')}) AS parameter_name",
        f"coalesce({first('rule_id', 'category')}, 'unknown') AS rule_id",
        f"{_text('_v', 'message')} AS message",
        f"{_text('_v', 'severity', repr('ERROR'))} AS severity",
    )
