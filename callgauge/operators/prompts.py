"""Prompt and listing texts.

A text over many rows (a server's summary, a transcript) is one whole text. It is
built from slices of a bounded number of rows, joined in order, so no task sorts
all rows of a huge one; only the finished text is one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.functions.variants import kind
from callgauge.operators.dims import join_spec

SLICE_ROWS = 1000

TOOL_CALLING_PROMPT = """You judge whether an agent called its tools correctly.

Tool specifications:
{tool_specs}

Request of the user:
{user_prompt}

Calls of the agent:
{agent_calls}

Give every sub-score from 0 (failed) to 10 (flawless). A wrong parameter name or a missing required parameter brings all argument sub-scores close to 0. A wrong value brings value, type and format close to 0. Answer with one JSON object: usage {necessity, overuse_detection}, selection {correctness, specificity, completeness}, ordering {not_applicable, sequence_logic, dependency_handling, execution_efficiency}, arguments {completeness, name_accuracy, value_accuracy, type_compliance, format_compliance, relevancy}, failures [..], rationale."""

COHERENCE_PROMPT = """You judge how coherent a conversation of an agent is.

Transcript:
{transcript}

Give 1 (poor), 2 (adequate) or 3 (good) for logical_flow, completeness, conciseness, topic_relevance and context_retention {not_applicable, score}. Answer with one JSON object that also has manifestations [..] and rationale."""

INTERPRETATION_PROMPT = """Explain this tool for use in a company.

{tool_info}

Answer with one JSON object: tool_name, what_it_does, what_it_needs, why_its_used, enterprise_context."""

SCENARIO_PROMPTS = {
    "simple": "Write everyday scenarios with few tool calls for the {n} tools below. Use every tool.\n\n{tool_summary}",
    "complex": "Write advanced scenarios that chain several tools for the {n} tools below. Use every tool.\n\n{tool_summary}",
    "boundary": "Write faulty scenarios (missing required parameters, illegal enum values, wrong types, unsupported model capabilities) for the {n} tools below. Use every tool.\n\n{tool_summary}",
}

MOCK_PROMPT = """Write the tool outputs of this scenario.

Tools:
{tool_summary}

Example outputs:
{seed_outputs}

Title: {title}
Prompt: {prompt}
Workflow:
{workflow}

Answer with one JSON object: mock_workflow [{function_name, parameters, quick_explanation, mock_output, confidence, expected_response}]."""

TURNS_PROMPT = """Turn this scenario into a conversation of two turns. Turn 1 runs the workflow, turn 2 follows up on it.

Scenario: {title}
Prompt: {prompt}
Workflow with outputs:
{mock_workflow}
Follow-up: {followup}

Answer with one JSON object: scenario_title, turns [{turn_index, user_message, agent_tool_calls, tool_responses, agent_response}]."""

# Texts for a missing part.
NO_SEEDS = "No prior reference outputs provided (Grounding: low/synthetic)"
NO_FOLLOWUP = "Continue and expand workflow"
CAPABILITY_HEADER = "\n\nCRITICAL BACKEND MODEL CAPABILITY MATRIX (MUST ENFORCE):\n"


def literal(text: str) -> str:
    """SQL string literal of a text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def fill(template: str, **values: str) -> str:
    """SQL expression of the template with its {names} replaced by expressions, each exactly once."""
    out, rest = [], template
    for name in sorted(values, key=lambda n: template.index("{" + n + "}")):
        before, rest = rest.split("{" + name + "}", 1)
        out += [literal(before), values[name]]
    return f"concat({', '.join([*out, literal(rest)])})"


def _in_order(position: str, text: str, separator: str) -> str:
    return f"array_join(transform(sort_array(collect_list(struct({position} AS at, {text} AS txt))), x -> x.txt), {literal(separator)})"


def joined_text(rows: DataFrame, key: list[str], position: str, text: str, separator: str) -> DataFrame:
    """(key, text, n): the texts of a key joined in the order of a number, and how many they are."""
    sliced = rows.withColumn("_slice", F.expr(f"CAST(floor({position} / {SLICE_ROWS}) AS BIGINT)"))
    parts = sliced.groupBy(*key, "_slice").agg(F.expr(_in_order(position, text, separator)).alias("_part"), F.count("*").alias("_n"))
    return parts.groupBy(*key).agg(F.expr(_in_order("_slice", "_part", separator)).alias("text"), F.sum("_n").alias("n"))


# ---- specifications -----------------------------------------------------------------------

# The layout of a tool in a summary, which prompts and saved texts share.
SHOWN_ENUM = "array_join(transform(a.enum, e -> trim(BOTH '\"' FROM e)), ', ')"
TOOL_BLOCK = (
    "concat('### Tool: `', tool_name, '`\\n- **Description**: ', coalesce(nullif(description, ''), 'No description'), '\\n',"
    " CASE WHEN size(args) = 0 THEN '- **Parameters**: None' ELSE concat('- **Parameters**:\\n', array_join(transform(args, a ->"
    " concat('  - `', a.param_name, '` (', a.param_type, ', ', CASE WHEN a.required THEN 'REQUIRED' ELSE 'optional' END, ')',"
    f" CASE WHEN size(a.enum) > 0 THEN concat(' [Enum: ', {SHOWN_ENUM}, ']') ELSE '' END)), '\\n')) END)"
)
SPEC_JSON = (
    "to_json(named_struct('name', tool_name, 'description', description, 'inputSchema', named_struct('type', 'object', 'properties',"
    " map_from_entries(transform(args, a -> struct(a.param_name, named_struct('type', a.param_type,"
    " 'enum', CASE WHEN size(a.enum) > 0 THEN transform(a.enum, e -> try_parse_json(e)) END)))),"
    " 'required', transform(filter(args, a -> a.required), a -> a.param_name))))"
)


def tool_blocks(rows: DataFrame) -> DataFrame:
    """Markdown block of each tool, from ``tool_rows`` of the generator."""
    return rows.selectExpr("server", "tool_name", "tool_pos", f"{TOOL_BLOCK} AS block")


def spec_listing(rows: DataFrame) -> DataFrame:
    """Inspection listing: required parameters and number of parameters of each tool."""
    return rows.selectExpr(
        "server", "tool_name",
        "array_join(transform(filter(args, a -> a.required), a -> a.param_name), ',') AS required",
        "size(args) AS parameters",
    )


def spec_json(rows: DataFrame) -> DataFrame:
    """Tool rows back to specification JSON."""
    return rows.selectExpr("server", "tool_name", "tool_pos", f"{SPEC_JSON} AS spec")


def spec_text(specs: DataFrame, matrices: DataFrame, enriched: str) -> DataFrame:
    """Specification text, with the server's capability matrix where ``enriched`` holds.

    matrices: server, matrix (JSON text), one row per server.
    """
    joined = join_spec(specs, matrices, ["server"], "left", spread="tool_name")
    shown = f"CASE WHEN {enriched} AND matrix IS NOT NULL THEN concat(spec, {literal(CAPABILITY_HEADER)}, matrix) ELSE spec END"
    return joined.withColumn("text", F.expr(shown)).drop("matrix")


# ---- transcripts ----------------------------------------------------------------------------


def call_lists(calls: DataFrame) -> DataFrame:
    """(transcript_id, text, n): all calls of a transcript as JSON list items in order."""
    named = "to_json(named_struct('name', tool_name))"  # its closing brace comes after the arguments
    shown = "CASE WHEN try_parse_json(arguments) IS NOT NULL THEN arguments ELSE '{}' END"
    item = f"concat(left({named}, length({named}) - 1), ',\"arguments\":', {shown}, '}}')"
    return joined_text(calls.withColumn("item", F.expr(item)), ["transcript_id"], "call_index", "item", ",\n")


def transcript_texts(turns: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(transcript_id, text): a header line, then a numbered block per turn with what the user and the agent said.

    turns: transcript_id, turn_index, user_message (or NULL), tool_calls (text or NULL), agent_response (or NULL).
    titles: transcript_id, title; without them the header names the transcript's id.
    """
    # The labels of a transcript.
    block = (
        "concat('\\nTurn ', turn_index, ':', CASE WHEN user_message IS NOT NULL THEN concat('\\nUSER: ', user_message) ELSE '' END,"
        " CASE WHEN tool_calls <> '' THEN concat('\\nAGENT TOOL CALLS: ', tool_calls) ELSE '' END,"
        " CASE WHEN agent_response <> '' THEN concat('\\nASSISTANT: ', agent_response) ELSE '' END)"
    )
    blocks = turns.selectExpr("transcript_id", "turn_index", f"{block} AS block")
    texts = joined_text(blocks, ["transcript_id"], "turn_index", "block", "\n")
    if titles is None:
        return texts.selectExpr("transcript_id", "concat('Conversation ', transcript_id, '\\n', text) AS text")
    named = texts.join(titles, "transcript_id", "left")
    return named.selectExpr("transcript_id", "concat('Conversation: ', coalesce(title, transcript_id), '\\n', text) AS text")


def call_text(arguments: str) -> str:
    """``k='v', n=1``: arguments as keyword pairs, in the order of the Variant's keys."""
    value = "CASE WHEN {k} = 'STR' THEN concat(\"'\", CAST(e.value AS STRING), \"'\") WHEN {k} = 'BOO' THEN initcap(CAST(e.value AS STRING)) WHEN {k} = 'VOI' THEN 'None' ELSE to_json(e.value) END".format(k=kind("e.value"))
    return f"array_join(transform(map_entries(try_cast(parse_json({arguments}) AS map<string,variant>)), e -> concat(e.key, '=', {value})), ', ')"


# ---- prompts of the stages and of the judges -------------------------------------------------


def interpretation_prompts(specs: DataFrame) -> DataFrame:
    return specs.selectExpr("server", "tool_name", f"{fill(INTERPRETATION_PROMPT, tool_info='spec')} AS prompt")


def scenario_prompts(summaries: DataFrame, tiers: list[str]) -> DataFrame:
    """Scenario prompt per server and tier, with all its tools; an unknown tier is asked as simple.

    summaries: server, text, n (the number of tools in the text).
    """
    joined = summaries.withColumn("tier", F.explode(F.array(*[F.lit(t) for t in tiers])))
    cases = " ".join(
        f"WHEN '{tier}' THEN {fill(text, n='n', tool_summary='text')}" for tier, text in SCENARIO_PROMPTS.items() if tier != "simple"
    )
    return joined.selectExpr("server", "tier", f"CASE tier {cases} ELSE {fill(SCENARIO_PROMPTS['simple'], n='n', tool_summary='text')} END AS prompt")


def workflow_prompts(rows: DataFrame) -> DataFrame:
    """Mock-output and conversation prompts of one-step scenarios.

    rows: title, prompt, tool_name, parameters, mock_output, agent_followup, block,
    example_output.
    """
    seeds = f"coalesce(example_output, {literal(NO_SEEDS)})"
    call = "concat('[{\"function_name\":\"', tool_name, '\",\"parameters\":', parameters, '}]')"
    done = "concat('[{\"function_name\":\"', tool_name, '\",\"mock_output\":', mock_output, '}]')"
    followup = f"coalesce(nullif(agent_followup, ''), {literal(NO_FOLLOWUP)})"
    mock = fill(MOCK_PROMPT, tool_summary="block", seed_outputs=seeds, title="title", prompt="prompt", workflow=call)
    turn = fill(TURNS_PROMPT, title="title", prompt="prompt", mock_workflow=done, followup=followup)
    return rows.selectExpr("*", f"{mock} AS mock_prompt", f"{turn} AS turns_prompt")


def server_texts(specs: DataFrame, matrices: DataFrame) -> DataFrame:
    """(server, text): the specifications of all tools of a server in order, and its capability matrix where there is one.

    specs: server, tool_name, tool_pos, spec; matrices: server, matrix.
    """
    whole = joined_text(specs, ["server"], "tool_pos", "spec", "\n")
    joined = whole.join(matrices, "server", "left")
    return joined.selectExpr("server", f"concat(text, CASE WHEN matrix IS NOT NULL THEN concat({literal(CAPABILITY_HEADER)}, matrix) ELSE '' END) AS text")


def judge_cases(calls: DataFrame, requests: DataFrame, tools: DataFrame, texts: DataFrame) -> DataFrame:
    """(transcript_id, specs, request, calls): one case per transcript, with the text of every server whose tools it calls.

    calls: transcript_id, call_index, tool_name, arguments; requests: transcript_id, request; tools: tool_name, server;
    texts: server, text.
    """
    used = calls.select("transcript_id", "tool_name").distinct().join(tools.select("tool_name", "server"), "tool_name").select("transcript_id", "server").distinct()
    specs = used.join(texts, "server").groupBy("transcript_id").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(server, text))), x -> x.text), '\\n\\n')").alias("specs")
    )
    listed = call_lists(calls).selectExpr("transcript_id", "text AS calls")
    return listed.join(requests, "transcript_id", "left").join(specs, "transcript_id", "left").selectExpr(
        "transcript_id", "coalesce(specs, '') AS specs", "coalesce(request, '') AS request", "calls"
    )


def judge_prompts(cases: DataFrame, judges: list[str]) -> DataFrame:
    """Prompt table for an offline scorer: every case once per judge.

    cases: transcript_id, specs, request, calls.
    """
    filled = fill(TOOL_CALLING_PROMPT, tool_specs="specs", user_prompt="request", agent_calls="calls")
    per_judge = cases.withColumn("judge", F.explode(F.array(*[F.lit(j) for j in judges])))
    return per_judge.selectExpr("transcript_id", "judge", f"{filled} AS prompt")
