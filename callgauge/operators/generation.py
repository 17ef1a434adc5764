"""Scenarios, mock outputs and transcripts from a specification, without a model.

Every stage is a table: scenarios and their steps, grounded steps, turns. A
scenario over all tools of a server is one row with many step rows, so no server
is ever gathered into one row.

tools: server, tool_name, tool_pos (order inside the registry), description
params: tool_name, param_pos, param_name, param_type, required, enum array<string>
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.operators.dims import join_spec
from callgauge.operators.ordering import number_slice, with_position
from callgauge.operators.replies import stage_replies
from callgauge.sources.stages import interpretation_rows

# Texts of the offline generator.
START_URI = "gs://mock-bucket/assets/initial.png"
SINGLE_URI = "gs://mock-bucket/assets/image.png"
SINGLE_TEXT = "test prompt for evaluation"
CHAIN_TEXT = "composite test prompt"
CONTEXT_TAGS = ("Media Production", "Enterprise Automation")
SINGLE_FOLLOWUP = "Would you like any modifications?"
CHAIN = {
    "title": "Composite Multi-Tool Chained Pipeline",
    "prompt": "Execute multi-step pipeline with inter-tool dependency passing",
    "novelty": "Chained multi-tool DAG workflow",
    "followup": "Extend pipeline execution",
    "category": "Chained Pipelines",
}
DEFAULT_TIERS = ("simple", "complex")


def tool_rows(tools: DataFrame, params: DataFrame) -> DataFrame:
    """One row per tool with ``args``: its own parameters in order (one specification document)."""
    own = ["server", "tool_name"] if "server" in params.columns else ["tool_name"]
    grouped = params.groupBy(*own).agg(
        F.expr("sort_array(collect_list(struct(param_pos, param_name, param_type, required, enum)))").alias("args")
    )
    empty = "CAST(array() AS array<struct<param_pos:int,param_name:string,param_type:string,required:boolean,enum:array<string>>>)"
    return tools.join(grouped, own, "left").withColumn("args", F.expr(f"coalesce(args, {empty})"))


def _names(condition: str) -> str:
    return f"array_join(transform(filter(args, a -> {condition}), a -> a.param_name), ', ')"


# The texts of offline output (here, in ``interpretations``, ``single_tool``, ``fallback``, ``chain_steps``,
# ``coverage_scenarios`` and ``turns``) are part of the results users compare and stay as they are.
NEEDS_TEXT = (
    "CASE WHEN size(args) = 0 THEN 'No parameters required.' ELSE concat_ws('; ',"
    f" CASE WHEN exists(args, a -> a.required) THEN concat('Required parameters: ', {_names('a.required')}) END,"
    f" CASE WHEN exists(args, a -> NOT a.required) THEN concat('Optional parameters: ', {_names('NOT a.required')}) END) END"
)


def interpretations(rows: DataFrame, tags: tuple[str, ...] = CONTEXT_TAGS) -> DataFrame:
    listed = ", ".join(f"'{t}'" for t in tags)
    return rows.selectExpr(
        "server",
        "tool_name",
        "coalesce(nullif(description, ''), concat('Executes ', tool_name)) AS what_it_does",
        f"{NEEDS_TEXT} AS what_it_needs",
        "concat('Automated tool calling for ', tool_name) AS why_its_used",
        f"array({listed}) AS enterprise_context",
    )


def interpretations_from(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Interpretations of all tools: from the usable replies (server, tool_name, reply), worked out offline for the others."""
    judged = stage_replies(answers.withColumn("stage", F.lit(1))).where("usable")
    docs = judged.selectExpr("server", "tool_name AS _tool", "payload AS doc").dropDuplicates(["server", "_tool"])
    told = interpretation_rows(docs).drop("tool_name").withColumnRenamed("_tool", "tool_name")
    rest = interpretations(rows.join(told.select("server", "tool_name"), ["server", "tool_name"], "left_anti"))
    return rest.withColumn("from_reply", F.lit(False)).unionByName(told.withColumn("from_reply", F.lit(True)))


def _filled(uri: str, other: str) -> str:
    """JSON object of the required arguments; enums come as JSON texts already."""
    value = (
        f"CASE WHEN contains(a.param_name, 'uri') OR contains(a.param_name, 'bucket') THEN {uri}"
        f" WHEN size(a.enum) > 0 THEN a.enum[0] {other} END"
    )
    pair = f"concat('\"', a.param_name, '\":', {value})"
    return f"concat('{{', array_join(transform(filter(args, a -> a.required), a -> {pair}), ','), '}}')"


SINGLE_ARGUMENTS = _filled(
    f"'\"{SINGLE_URI}\"'",
    f"WHEN a.param_type = 'string' THEN '\"{SINGLE_TEXT}\"' WHEN a.param_type IN ('integer', 'number') THEN '1'"
    " WHEN a.param_type = 'boolean' THEN 'true' ELSE '\"val\"'",
)
CHAIN_ARGUMENTS = _filled("concat('\"', in_uri, '\"')", f"ELSE '\"{CHAIN_TEXT}\"'")

SCENARIO = ("server", "scenario_id", "tier", "category", "title", "prompt", "novelty_reason", "agent_followup")
STEP = ("server", "scenario_id", "tier", "step_index", "tool_name", "parameters", "quick_explanation")


def _tiers(rows: DataFrame, tiers: list[str]) -> DataFrame:
    return rows.withColumn("tier", F.explode(F.array(*[F.lit(t) for t in tiers])))


def single_tool(rows: DataFrame, tiers: list[str]) -> DataFrame:
    """One scenario of one step for every tool and tier."""
    return _tiers(rows, tiers).selectExpr(
        "server", "concat_ws('|', server, tier, tool_name) AS scenario_id", "tier",
        "concat('Single Tool ', tier) AS category", "concat('Execute ', tool_name) AS title",
        "concat('Please call ', tool_name, ' with standard parameters') AS prompt",
        "concat('Exercises ', tool_name) AS novelty_reason", f"'{SINGLE_FOLLOWUP}' AS agent_followup",
        "0 AS step_index", "tool_name", f"{SINGLE_ARGUMENTS} AS parameters", "concat('Calls ', tool_name) AS quick_explanation",
    )


def fallback(rows: DataFrame, tiers: list[str]) -> DataFrame:
    """One plain scenario per tool and tier, for a reply that cannot be used."""
    return _tiers(rows, tiers).selectExpr(
        "server", "concat_ws('|', server, tier, 'fallback', tool_name) AS scenario_id", "tier", "'Fallback' AS category",
        "concat('Fallback ', tool_name) AS title", "concat('Execute ', tool_name) AS prompt",
        "'' AS novelty_reason", "'' AS agent_followup", "0 AS step_index", "tool_name", "'{}' AS parameters",
        "'' AS quick_explanation",
    )


def with_server_size(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("server").agg(F.count("*").alias("server_tools"))
    return join_spec(rows, counts, ["server"], "left", spread="tool_name")


def chain_steps(rows: DataFrame, tier: str = "complex") -> DataFrame:
    """Steps of one chained scenario per server: each tool reads what the one before wrote."""
    placed = with_position(rows, ["server"], ["tool_pos"], number_slice("tool_pos"), "step_index")
    linked = placed.withColumn(
        "in_uri",
        F.expr(f"CASE WHEN step_index = 0 THEN '{START_URI}' ELSE concat('gs://mock-bucket/step_', step_index, '_out.mp4') END"),
    )
    return linked.selectExpr(
        "server", f"concat_ws('|', server, '{tier}', 'chain') AS scenario_id", f"'{tier}' AS tier", "step_index", "tool_name",
        f"{CHAIN_ARGUMENTS} AS parameters", "concat('Chained execution step ', step_index + 1) AS quick_explanation",
    )


def chain_scenarios(servers: DataFrame, tier: str = "complex") -> DataFrame:
    return servers.selectExpr(
        "server", f"concat_ws('|', server, '{tier}', 'chain') AS scenario_id", f"'{tier}' AS tier",
        *[f"'{CHAIN[k]}' AS {c}" for k, c in (("category", "category"), ("title", "title"), ("prompt", "prompt"),
                                            ("novelty", "novelty_reason"), ("followup", "agent_followup"))],
    )


def scenarios(rows: DataFrame, tiers: tuple[str, ...] = DEFAULT_TIERS) -> tuple[DataFrame, DataFrame]:
    """(scenarios, steps) of every server and tier.

    The complex tier of a server with several tools is one chain over all of them;
    every other (server, tier) has one scenario per tool.
    """
    plain = [t for t in tiers if t != "complex"]
    made, steps = [], []
    if plain:
        single = single_tool(rows, plain)
        made.append(single.select(*SCENARIO))
        steps.append(single.select(*STEP))
    if "complex" in tiers:
        sized = with_server_size(rows)
        many = sized.where("server_tools > 1")
        lone = single_tool(sized.where("server_tools = 1"), ["complex"])
        servers = rows.groupBy("server").agg(F.count("*").alias("n")).where("n > 1")
        made += [lone.select(*SCENARIO), chain_scenarios(servers)]
        steps += [lone.select(*STEP), chain_steps(many).select(*STEP)]
    return _union(made), _union(steps)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# ---- coverage -------------------------------------------------------------------------


def uncovered(tools: DataFrame, steps: DataFrame) -> DataFrame:
    """Tools that no step uses."""
    used = steps.select("tool_name").distinct()
    return tools.join(used, "tool_name", "left_anti")


def coverage_scenarios(missing: DataFrame) -> DataFrame:
    return missing.selectExpr(
        "server", "concat_ws('|', server, 'coverage', tool_name) AS scenario_id", "'simple' AS tier",
        "'Coverage Fallback' AS category", "concat('Coverage Guarantee for ', tool_name) AS title",
        "concat('Run ', tool_name, ' to fulfill coverage requirement') AS prompt",
        "'' AS novelty_reason", "'' AS agent_followup", "0 AS step_index", "tool_name", "'{}' AS parameters",
        "'' AS quick_explanation",
    )


def coverage(tools: DataFrame, steps: DataFrame) -> DataFrame:
    """Share of each server's tools that a step uses."""
    used = steps.select("tool_name").distinct().withColumn("hit", F.lit(1))
    counted = tools.join(used, "tool_name", "left").groupBy("server").agg(F.count("hit").alias("covered"), F.count("*").alias("tools"))
    return counted.withColumn("share", F.expr("round(covered / tools, 4)"))


# ---- mock outputs and turns ---------------------------------------------------------------


def ground(steps: DataFrame, seeds: DataFrame, low_without_seeds: DataFrame | None = None) -> DataFrame:
    """Mock output of each step: the tool's seed output (high), else a stub (medium).

    ``low_without_seeds`` is an optional table of servers that have no seed at all;
    their steps are low.
    """
    known = join_spec(steps, seeds.select("tool_name", "example_output"), ["tool_name"], "left")
    stub = "concat('{\"status\":\"success\",\"function\":\"', tool_name, '\"}')"
    out = known.withColumn("mock_output", F.expr(f"coalesce(example_output, {stub})"))
    weak = F.lit("medium")
    if low_without_seeds is not None:
        out = join_spec(out, low_without_seeds.select("server").withColumn("_bare", F.lit(True)), ["server"], "left")
        weak = F.when(F.col("_bare"), "low").otherwise("medium")
    out = out.withColumn("confidence", F.when(F.col("example_output").isNotNull(), "high").otherwise(weak))
    return out.drop("example_output", "_bare")


def grounding_ratio(grounded: DataFrame) -> DataFrame:
    return grounded.agg(
        F.expr("count_if(confidence = 'high')").alias("high"),
        F.count("*").alias("steps"),
        F.expr("round(avg(CASE WHEN confidence = 'high' THEN 1D ELSE 0D END), 4)").alias("ratio"),
    )


def turns(made: DataFrame, grounded: DataFrame, usable: bool = True) -> DataFrame:
    """Two-turn transcripts: turn 1 runs the workflow, turn 2 is the follow-up.

    With ``usable=False`` (the reply for the scenario could not be used) turn 2 is
    always there. The calls and responses of turn 1 are the grounded step rows.
    """
    counts = grounded.groupBy("scenario_id").agg(F.count("*").alias("n_calls"))
    joined = made.join(counts, "scenario_id", "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))
    first = "struct(1 AS turn_index, prompt AS user_message, n_calls, concat('Executed ', n_calls, ' tool call(s).') AS agent_response)"
    if usable:
        message, reply, there = "agent_followup", "Follow-up complete.", "agent_followup <> ''"
    else:
        message, reply, there = "coalesce(nullif(agent_followup, ''), 'Follow up')", "Completed follow-up turn.", "true"
    second = f"struct(2 AS turn_index, {message} AS user_message, 0L AS n_calls, '{reply}' AS agent_response)"
    both = f"CASE WHEN {there} THEN array({first}, {second}) ELSE array({first}) END"
    return joined.selectExpr("scenario_id", "title AS scenario_title", "tier", f"inline({both})")


# ---- faults ---------------------------------------------------------------------------------

# Kinds of injected fault and the failure a judge should name.
FAULTS = (
    ("missing_required", "argument_completeness"),
    ("illegal_enum", "argument_value"),
    ("wrong_type", "argument_type"),
    ("unsupported_capability", "argument_value"),
)


def inject_faults(calls: DataFrame, required: str, enum: str, typed: str, flag: str, weak_model: str) -> DataFrame:
    """Four broken variants of each valid call, by rewriting one argument.

    Arguments are JSON objects; the five names say which argument each fault hits.
    """
    # Duplicate keys: the last one wins, so a fault is appended to the object.
    body = "substring(arguments, 1, length(arguments) - 1)"
    added = {
        "missing_required": f'"{required}":null',
        "illegal_enum": f'"{enum}":"not-allowed"',
        "wrong_type": f'"{typed}":"text"',
        "unsupported_capability": f'"{flag}":true,"model":"{weak_model}"',
    }
    variants = ", ".join(
        f"struct('{name}' AS injected_fault, '{taxonomy}' AS expected_taxonomy, '{added[name]}' AS change)" for name, taxonomy in FAULTS
    )
    kept = [c for c in calls.columns if c != "arguments"]
    broken = calls.selectExpr(*kept, "arguments", f"inline(array({variants}))")
    glued = f"concat({body}, CASE WHEN length(arguments) > 2 THEN ',' ELSE '' END, change, '}}')"
    return broken.selectExpr(*kept, "injected_fault", "expected_taxonomy", f"to_json(parse_json({glued})) AS arguments")


# ---- the whole harness -------------------------------------------------------------------------


def harness(tools: DataFrame, params: DataFrame, seeds: DataFrame, tiers: tuple[str, ...] = DEFAULT_TIERS) -> dict[str, DataFrame]:
    """All stages over all servers; a server without tools has no rows in any of them."""
    rows = tool_rows(tools, params)
    made, steps = scenarios(rows, tiers)
    grounded = ground(steps, seeds)
    metadata = tools.groupBy("server").agg(F.count("*").alias("total_tools")).withColumn("tiers", F.lit(",".join(tiers)))
    return {
        "interpretations": interpretations(rows),
        "scenarios": made,
        "mock_steps": grounded,
        "turns": turns(made, grounded),
        "metadata": metadata,
    }
