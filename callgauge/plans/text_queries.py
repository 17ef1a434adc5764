"""Replies, prompts and listings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.operators import generation as g
from callgauge.operators import evaluation, prompts, replies
from callgauge.operators.ordering import number_slice, with_next
from callgauge.operators.scoring import norm10
from callgauge.plans.fixtures import JUDGES, MEDIA_PARAMS, MEDIA_TOOLS, MODELS, Tables
from callgauge.plans.generation_queries import rows
from callgauge.plans.registry import CTES, query
from callgauge.session import literal_table

IMG_RATIOS = ("1:1", "16:9", "9:16", "4:3")


def _judge_text(t: Tables) -> DataFrame:
    """Judge replies as free text in five layouts."""
    body = "concat('{\"necessity\":', necessity, ',\"name_accuracy\":', name_accuracy, '}')"
    return t.judge_scores.selectExpr("call_id", "judge", f"{body} AS body").selectExpr(
        "call_id",
        "judge",
        "CASE call_id % 5 WHEN 0 THEN body WHEN 1 THEN concat('```json ', body, ' ```') WHEN 2 THEN concat('``` ', body, ' ```')"
        " WHEN 3 THEN concat('Here is my score: ', body, ' Hope this helps.')"
        " ELSE concat(substring(body, 1, length(body) - 1), ',}') END AS reply",
    )


@query("json_extract", "SELECT call_id, judge, necessity, name_accuracy FROM judge_scores")
def json_extract(t: Tables) -> DataFrame:
    found = replies.with_json(_judge_text(t), "reply")
    return found.selectExpr(
        "call_id", "judge", "variant_get(payload, '$.necessity', 'int') AS necessity",
        "variant_get(payload, '$.name_accuracy', 'int') AS name_accuracy",
    )


# A reply of every kind: list, scalar, text, broken, list with a comma, list in prose, object in a list in prose.
_KINDS = (
    ("[1,2]", '{"items":[1,2]}'),
    ("12345", '{"data":12345}'),
    ("true", '{"data":true}'),
    ("no json at all", None),
    ('{"open": "x', None),
    ('["a","b", ]', '{"items":["a","b"]}'),
    ("list: [3,4] end", '{"items":[3,4]}'),
    ('see [{"a":1}] there', '{"a":1}'),
    ('"quoted"', None),
    ("  {\"z\":1}\n", '{"z":1}'),
    ('```json\n{"s":1,}\n```', '{"s":1}'),
    ('only ``` {"t":2}', '{"t":2}'),
)
_sql = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"


@query(
    "json_extract_kinds",
    "SELECT event_id, [" + ", ".join(_sql(b) for _, b in _KINDS) + f"][event_id % {len(_KINDS)} + 1] AS payload FROM events",
)
def json_extract_kinds(t: Tables) -> DataFrame:
    texts = ", ".join(prompts.literal(a) for a, _ in _KINDS)
    named = t.read("events").selectExpr("event_id", f"element_at(array({texts}), CAST(event_id % {len(_KINDS)} AS INT) + 1) AS reply")
    return replies.with_json(named, "reply").selectExpr("event_id", "to_json(payload) AS payload")


@query(
    "reply_text",
    """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'hello ' || event_id WHEN 1 THEN 'pred ' || event_id WHEN 2 THEN 'text ' || event_id WHEN 3 THEN 'ab' || event_id
  WHEN 4 THEN 'plain' ELSE '{"other":' || event_id || '}' END AS text,
  CASE event_id % 6 WHEN 0 THEN 'stop' WHEN 3 THEN 'STOP' END AS finish_reason,
  CASE event_id % 6 WHEN 0 THEN '{"prompt_tokens":' || event_id || '}' WHEN 3 THEN '{"promptTokenCount":' || event_id || '}' END AS usage
FROM events
""",
)
def reply_text(t: Tables) -> DataFrame:
    payload = (
        "CASE event_id % 6 WHEN 0 THEN concat('{\"choices\":[{\"message\":{\"content\":\"hello ', event_id, '\"},\"finish_reason\":\"stop\"}],\"usage\":{\"prompt_tokens\":', event_id, '}}')"
        " WHEN 1 THEN concat('{\"predictions\":[{\"content\":\"pred ', event_id, '\"}]}')"
        " WHEN 2 THEN concat('{\"predictions\":[{\"content\":\"\",\"text\":\"text ', event_id, '\"}]}')"
        " WHEN 3 THEN concat('{\"candidates\":[{\"content\":{\"parts\":[{\"text\":\"a\"},{\"text\":\"b', event_id, '\"}]},\"finishReason\":\"STOP\"}],\"usageMetadata\":{\"promptTokenCount\":', event_id, '}}')"
        " WHEN 4 THEN '{\"predictions\":[\"plain\"]}' ELSE concat('{\"other\":', event_id, '}') END AS payload"
    )
    return replies.reply_text(t.read("events").selectExpr("event_id", payload), "payload").drop("payload")


CTES["usages"] = """
SELECT event_id, user_id, CASE WHEN event_id % 4 = 2 THEN 0 ELSE event_id % 500 END AS p, CASE WHEN event_id % 4 = 2 THEN 0 ELSE event_id % 90 END AS c,
  CASE WHEN event_id % 4 = 1 THEN event_id % 700 END AS total, CASE WHEN event_id % 4 = 3 THEN 7 END AS cached FROM events
"""
CTES["usage_counts"] = """
SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'judge_a' ELSE 'judge_b' END AS judge, p AS prompt_tokens, c AS completion_tokens,
  coalesce(nullif(total, 0), p + c) AS total_tokens, CAST(cached AS BIGINT) AS cached_tokens FROM usages
"""


def _usages(t: Tables) -> DataFrame:
    p, c = "event_id % 500", "event_id % 90"
    usage = (
        f"CASE event_id % 4 WHEN 0 THEN concat('{{\"prompt_tokens\":', {p}, ',\"completion_tokens\":', {c}, '}}')"
        f" WHEN 1 THEN concat('{{\"promptTokenCount\":', {p}, ',\"candidatesTokenCount\":', {c}, ',\"totalTokenCount\":', event_id % 700, '}}')"
        " WHEN 2 THEN '{\"prompt_tokens\":0}'"
        f" ELSE concat('{{\"prompt_tokens\":', {p}, ',\"completion_tokens\":', {c}, ',\"cached_tokens\":7}}') END AS usage"
    )
    judge = "CASE event_id % 2 WHEN 0 THEN 'judge_a' ELSE 'judge_b' END AS judge"
    return replies.token_usage(t.read("events").selectExpr("event_id", judge, usage), "usage").drop("usage")


@query("token_usage", "SELECT event_id, judge, prompt_tokens, completion_tokens, total_tokens, cached_tokens FROM usage_counts")
def token_usage(t: Tables) -> DataFrame:
    return _usages(t)


@query(
    "token_totals",
    "SELECT judge, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,"
    " CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM usage_counts GROUP BY judge",
)
def token_totals(t: Tables) -> DataFrame:
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    return _usages(t).groupBy("judge").agg(*[F.sum(n).alias(n) for n in names])


@query(
    "approx_tokens",
    r"SELECT doc_id, CAST(greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS INTEGER) AS tokens FROM documents",
)
def approx_tokens(t: Tables) -> DataFrame:
    return t.read("documents").selectExpr("doc_id", f"{replies.approx_tokens('text')} AS tokens")


@query(
    "stage_reply_ingest",
    """
SELECT event_id, CAST(event_id % 4 + 1 AS INTEGER) AS stage, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS usable FROM events
""",
)
def stage_reply_ingest(t: Tables) -> DataFrame:
    good = (
        "element_at(array('{\"what_it_does\":\"x\"}', '{\"categories\":[]}', '{\"mock_workflow\":[{}]}', '{\"turns\":[{\"turn_index\":1}]}'),"
        " CAST(event_id % 4 AS INT) + 1)"
    )
    reply = (
        f"CASE event_id % 5 WHEN 0 THEN {good} WHEN 1 THEN concat('Sure:\\n```json\\n', {good}, '\\n```') WHEN 2 THEN '{{\"other\":1}}'"
        " WHEN 3 THEN 'sorry' ELSE '{\"categories\":\"x\",\"mock_workflow\":[],\"turns\":{}}' END AS reply"
    )
    named = t.read("events").selectExpr("event_id", "CAST(event_id % 4 + 1 AS INT) AS stage", reply)
    return replies.stage_replies(named).select("event_id", "stage", "usable")


_REPLY_BODY = """'{"usage":{"necessity":' || necessity || ',"overuse":1},"selection":{"correctness":' || sel_correctness || ',"specificity":' || sel_specificity
  || '},"ordering":{"not_applicable":true},"arguments":{"name_accuracy":' || name_accuracy || ',"relevancy":null},"failures":["ordering"],"rationale":"r"}'"""


@query(
    "judge_reply_scores",
    "SELECT call_id, judge, CAST(necessity AS DOUBLE) AS necessity, 1.0::DOUBLE AS overuse, CAST(sel_correctness AS DOUBLE) AS sel_correctness,"
    " CAST(name_accuracy AS DOUBLE) AS name_accuracy, CAST(NULL AS DOUBLE) AS relevancy, true AS ordering_na, 'ordering' AS failures, false AS rejected FROM judge_scores",
)
def judge_reply_scores(t: Tables) -> DataFrame:
    texts = t.judge_scores.selectExpr("call_id", "judge", f"{_REPLY_BODY} AS reply")
    return replies.raw_scores(texts).selectExpr(
        "call_id", "judge", "necessity", "overuse", "sel_correctness", "name_accuracy", "relevancy", "ordering_na",
        "array_join(failures, '|') AS failures", "rejected",
    )


_LEAVES = (
    ('{"usage":{}}', 1.0, 0.0),
    ('{"usage":{"necessity":null,"overuse_detection":null}}', 1.0, 1.0),
    ('{"usage":{"necessity":"8","overuse_detection":"7"}}', 0.8, 0.7),
    ('{"usage":{"necessity":"bad","overuse_detection":[1]}}', 0.0, 0.0),
    ('{"usage":{"necessity":{"a":1},"overuse":5}}', 0.0, 0.5),
    ('{"usage":{"necessity":true,"overuse_detection":false}}', 0.1, 0.0),
    ('{"usage":{"necessity":"NaN","overuse_detection":12}}', 0.0, 1.0),
    ('{"usage":{"necessity":4.5,"overuse_detection":-3}}', 0.45, 0.0),
)


def _by_call(values) -> str:
    return "CASE call_id % 8 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query(
    "judge_reply_leaves",
    f"SELECT call_id, judge, CAST({_by_call(n for _, n, _ in _LEAVES)} AS DOUBLE) AS necessity, CAST({_by_call(o for _, _, o in _LEAVES)} AS DOUBLE) AS overuse FROM judge_scores",
)
def judge_reply_leaves(t: Tables) -> DataFrame:
    """Leaves that are absent, null, text, lists, objects, booleans, not finite or out of range."""
    texts = t.judge_scores.selectExpr("call_id", "judge", _by_call(f"'{body}'" for body, _, _ in _LEAVES) + " AS reply")
    return replies.raw_scores(texts).selectExpr("call_id", "judge", f"{norm10('necessity')} AS necessity", f"{norm10('overuse')} AS overuse")


_COHERENCE_REPLIES = (
    ('{"logical_flow":3,"completeness":2,"conciseness":1,"topic_relevance":"3","context_retention":{"not_applicable":false,"score":2}}', 0.6),
    ('Reply: {"logical_flow":3,"completeness":3,"context_retention":null,"rationale":"r"}', 1.0),
    ('{"logical_flow":"bad","completeness":[3],"conciseness":null,"topic_relevance":9}', 0.5),
    ('{"logical_flow":2,"completeness":2,"conciseness":2,"topic_relevance":2,"context_retention":{"not_applicable":true,"score":3}}', 0.5),
    ('{"context_retention":{"not_applicable":false,"score":"x"}}', 0.8),
    ("no scores here", None),
)


def _by_conversation(values) -> str:
    return "CASE conv_id % 6 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


CTES["coherence_verdicts"] = f"""
SELECT conv_id, CAST({_by_conversation('NULL' if o is None else o for _, o in _COHERENCE_REPLIES)} AS DOUBLE) AS overall FROM (SELECT DISTINCT conv_id FROM conversations)
"""


@query("evaluate_coherence", "SELECT conv_id, overall, overall >= 0.8 AS passed, overall IS NULL AS rejected FROM coherence_verdicts")
def evaluate_coherence(t: Tables) -> DataFrame:
    """Coherence replies to verdicts; a reply without JSON is rejected."""
    texts = t.read("conversations").select("conv_id").distinct().selectExpr(
        "conv_id", _by_conversation("'" + body + "'" for body, _ in _COHERENCE_REPLIES) + " AS reply"
    )
    results, rejects = evaluation.evaluate_coherence(texts)
    shown = results.select("conv_id", "overall", "passed", F.lit(False).alias("rejected"))
    return shown.unionByName(rejects.withColumn("rejected", F.lit(True)), allowMissingColumns=True)


CTES["reply_cases"] = """
SELECT j.call_id, j.judge, j.necessity, j.sel_correctness, j.sel_specificity, j.name_accuracy, coalesce(f.name_fault, false) AS name_fault,
  coalesce(f.value_fault, false) AS value_fault, coalesce(f.n, 0) AS n_violations
FROM judge_scores j LEFT JOIN (SELECT f.*, v.n FROM call_faults f JOIN (SELECT call_id, count(*) AS n FROM violations GROUP BY call_id) v USING (call_id)) f USING (call_id)
WHERE j.call_id % 10 <> 9
"""
CTES["reply_scored"] = """
SELECT *, CASE WHEN collapsed = 'name' THEN 0.2 / 6 WHEN collapsed = 'value' THEN (1 + name_accuracy / 10.0 + 0.2) / 6 ELSE (5 + name_accuracy / 10.0) / 6 END AS arguments,
  (sel_correctness / 10.0 + sel_specificity / 10.0 + 1) / 3 AS selection
FROM (SELECT *, CASE WHEN name_fault OR name_accuracy <= 2 THEN 'name' WHEN value_fault THEN 'value' ELSE 'none' END AS collapsed FROM reply_cases)
"""


@query(
    "evaluate_replies",
    """
SELECT call_id, judge, collapsed, CAST(n_violations AS BIGINT) AS n_violations, CAST(round(arguments, 4) AS DOUBLE) AS arguments,
  CAST(round((necessity / 10.0 + selection + arguments) / 3, 4) AS DOUBLE) AS tc,
  n_violations = 0 AND round((necessity / 10.0 + selection + arguments) / 3, 4) >= 0.85 AS passed, false AS rejected FROM reply_scored
UNION ALL SELECT call_id, judge, NULL, NULL, NULL, NULL, NULL, true FROM judge_scores WHERE call_id % 10 = 9
""",
)
def evaluate_replies(t: Tables) -> DataFrame:
    """Reply texts to verdicts; every tenth reply holds no JSON and is rejected."""
    texts = t.judge_scores.selectExpr("call_id", "judge", f"CASE WHEN call_id % 10 = 9 THEN 'I cannot say' ELSE {_REPLY_BODY} END AS reply")
    results, rejects = evaluation.evaluate(t.calls_unordered, t.media_spec, texts)
    shown = results.selectExpr("call_id", "judge", "collapsed", "n_violations", "round(arguments, 4) AS arguments", "tc", "passed", "false AS rejected")
    return shown.unionByName(rejects.withColumn("rejected", F.lit(True)), allowMissingColumns=True)


# ---- prompts --------------------------------------------------------------------------


def _duck(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _duck_fill(template: str, **values: str) -> str:
    """DuckDB expression of the template with its {names} replaced by expressions."""
    out, rest = [], template
    for name in sorted(values, key=lambda n: template.index("{" + n + "}")):
        before, rest = rest.split("{" + name + "}", 1)
        out += [_duck(before), values[name]]
    return " || ".join([*out, _duck(rest)])


CTES["spec_json"] = """
SELECT t.server, t.tool_name, t.tool_pos, '{"name":"' || t.tool_name || '","description":"' || t.description || '","inputSchema":{"type":"object","properties":{'
  || coalesce(p.props, '') || '},"required":[' || coalesce(p.req, '') || ']}}' AS spec
FROM spec_tools t LEFT JOIN (SELECT tool_name, string_agg('"' || param_name || '":{"type":"' || param_type || '"' ||
    CASE WHEN enum_values IS NOT NULL THEN ',"enum":["draft","final"]' ELSE '' END || '}', ',' ORDER BY param_pos) AS props,
  string_agg('"' || param_name || '"', ',' ORDER BY param_pos) FILTER (WHERE required) AS req FROM spec_params GROUP BY tool_name) p ON p.tool_name = t.tool_name
"""
CTES["tool_blocks"] = """
SELECT t.server, t.tool_name, t.tool_pos, '### Tool: `' || t.tool_name || '`' || chr(10) || '- **Description**: ' || coalesce(nullif(t.description, ''), 'No description') || chr(10)
  || coalesce('- **Parameters**:' || chr(10) || p.lines, '- **Parameters**: None') AS block
FROM spec_tools t LEFT JOIN (SELECT tool_name, string_agg('  - `' || param_name || '` (' || param_type || ', ' || CASE WHEN required THEN 'REQUIRED' ELSE 'optional' END || ')'
  || CASE WHEN enum_values IS NOT NULL THEN ' [Enum: draft, final]' ELSE '' END, chr(10) ORDER BY param_pos) AS lines FROM spec_params GROUP BY tool_name) p ON p.tool_name = t.tool_name
"""
CTES["server_summaries"] = """
SELECT server, string_agg(block, chr(10) || chr(10) ORDER BY tool_pos) AS text, count(*) AS n FROM tool_blocks GROUP BY server
"""


def _summaries(t: Tables) -> DataFrame:
    return prompts.joined_text(prompts.tool_blocks(rows(t)), ["server"], "tool_pos", "block", "\n\n")


@query("tool_summary", "SELECT server, text, n FROM server_summaries")
def tool_summary(t: Tables) -> DataFrame:
    return _summaries(t)


@query("spec_inspect", "SELECT server, tool_name, coalesce(replace(req, ', ', ','), '') AS required, CAST(params AS INTEGER) AS parameters FROM spec_needs")
def spec_inspect(t: Tables) -> DataFrame:
    return prompts.spec_listing(rows(t))


@query("spec_json", "SELECT server, tool_name, spec FROM spec_json")
def spec_json(t: Tables) -> DataFrame:
    return prompts.spec_json(rows(t)).select("server", "tool_name", "spec")


@query(
    "spec_text",
    f"""
SELECT tool_name, CASE WHEN tool_pos % 2 = 0 AND server LIKE 'Brand%' THEN spec || {_duck(prompts.CAPABILITY_HEADER)} || '{{"m-1":{{"server":"' || server || '"}}}}' ELSE spec END AS text
FROM spec_json
""",
)
def spec_text(t: Tables) -> DataFrame:
    servers = t.spec_tools.where("server LIKE 'Brand%'").select("server").distinct()
    matrices = servers.selectExpr("server", "concat('{\"m-1\":{\"server\":\"', server, '\"}}') AS matrix")
    return prompts.spec_text(prompts.spec_json(rows(t)), matrices, "tool_pos % 2 = 0").select("tool_name", "text")


_TIER_SQL = " ".join(
    f"WHEN '{tier}' THEN {_duck_fill(text, n='s.n', tool_summary='s.text')}" for tier, text in prompts.SCENARIO_PROMPTS.items()
)


@query(
    "stage_prompts",
    f"""
SELECT s.server, t.tier, CASE CASE WHEN t.tier = 'odd' THEN 'simple' ELSE t.tier END {_TIER_SQL} END AS prompt
FROM server_summaries s, (VALUES ('simple'), ('complex'), ('boundary'), ('odd')) t(tier)
UNION ALL SELECT server, 'interpret', {_duck_fill(prompts.INTERPRETATION_PROMPT, tool_info='spec')} FROM spec_json
""",
)
def stage_prompts(t: Tables) -> DataFrame:
    """Stage 1 prompt of every tool, stage 2 prompts of every server; an unknown tier is simple."""
    second = prompts.scenario_prompts(_summaries(t), ["simple", "complex", "boundary", "odd"])
    first = prompts.interpretation_prompts(prompts.spec_json(rows(t)))
    return second.unionByName(first.selectExpr("server", "'interpret' AS tier", "prompt"))


_MOCK_SQL = _duck_fill(
    prompts.MOCK_PROMPT,
    tool_summary="b.block",
    seed_outputs=f"coalesce(e.example_output, {_duck(prompts.NO_SEEDS)})",
    title="'Execute ' || g.tool_name",
    prompt="'Please call ' || g.tool_name || ' with standard parameters'",
    workflow="'[{\"function_name\":\"' || g.tool_name || '\",\"parameters\":' || g.parameters || '}]'",
)
_TURN_SQL = _duck_fill(
    prompts.TURNS_PROMPT,
    title="'Execute ' || g.tool_name",
    prompt="'Please call ' || g.tool_name || ' with standard parameters'",
    mock_workflow="'[{\"function_name\":\"' || g.tool_name || '\",\"mock_output\":' || g.mock_output || '}]'",
    followup="CASE WHEN g.tool_name LIKE '%7' THEN " + _duck(prompts.NO_FOLLOWUP) + " ELSE 'Would you like any modifications?' END",
)


@query(
    "mock_prompts",
    f"""
SELECT g.tool_name, {_MOCK_SQL} AS mock_prompt, {_TURN_SQL} AS turns_prompt
FROM spec_grounded g JOIN tool_blocks b ON b.tool_name = g.tool_name LEFT JOIN spec_seeds e ON e.tool_name = g.tool_name WHERE g.tier = 'simple'
""",
)
def mock_prompts(t: Tables) -> DataFrame:
    """Stage 3 and 4 prompts of the single-tool scenarios."""
    made = g.single_tool(rows(t), ["simple"])
    grounded = g.ground(made.drop("quick_explanation"), t.spec_seeds)
    grounded = grounded.withColumn("agent_followup", F.expr("CASE WHEN tool_name LIKE '%7' THEN '' ELSE agent_followup END"))
    blocks = prompts.tool_blocks(rows(t)).select("tool_name", "block")
    seeded = grounded.join(blocks, "tool_name").join(t.spec_seeds, "tool_name", "left")
    return prompts.workflow_prompts(seeded).select("tool_name", "mock_prompt", "turns_prompt")


def _media_texts() -> list[tuple[str, str]]:
    """Specification text and matrix of each server of the media registry, written out for the SQL."""
    made = {}
    for server, tool in MEDIA_TOOLS:
        props = {}
        for param, type_name in MEDIA_PARAMS:
            enum = {"enum": list(IMG_RATIOS)} if (param, tool) == ("aspect_ratio", "img_generate") else {}
            props[param] = {"type": type_name, **enum}
        required = [p for p, _ in MEDIA_PARAMS if p == "prompt" or (p == "image_uri" and tool == "vid_from_image")]
        schema = {"type": "object", "properties": props, "required": required}
        made.setdefault(server, []).append(json.dumps({"name": tool, "description": "", "inputSchema": schema}, separators=(",", ":")))
    return [(s, "\n".join(specs) + ("" if s == "music" else prompts.CAPABILITY_HEADER + _matrix(s))) for s, specs in made.items()]


def _matrix(server: str) -> str:
    return json.dumps({model: {"audio": audio, "ratios": ratios.split("|")} for model, audio, ratios, _ in MODELS} | {"server": server}, separators=(",", ":"))


_SERVERS_SQL = ", ".join(f"({_duck(server)}, {_duck(text)})" for server, text in _media_texts())
_TOOLS_SQL = ", ".join(f"({_duck(tool)}, {_duck(server)})" for server, tool in MEDIA_TOOLS)
_JUDGE_SQL = _duck_fill(prompts.TOOL_CALLING_PROMPT, tool_specs="coalesce(s.specs, '')", user_prompt="'Work on transcript ' || c.transcript_id", agent_calls="c.calls")


@query(
    "judge_prompts",
    f"""
SELECT c.transcript_id, judge, {_JUDGE_SQL} AS prompt FROM (
  SELECT transcript_id, string_agg('{{"name":"' || tool_name || '","arguments":' || shown || '}}', ',' || chr(10) ORDER BY call_index) AS calls
  FROM (SELECT *, arguments AS shown FROM calls WHERE json_valid(arguments)
    UNION ALL SELECT *, '{{}}' FROM calls WHERE NOT coalesce(json_valid(arguments), false)) GROUP BY ALL) c
LEFT JOIN (SELECT transcript_id, string_agg(text, chr(10) || chr(10) ORDER BY server) AS specs FROM (
    SELECT DISTINCT transcript_id, server FROM calls JOIN (VALUES {_TOOLS_SQL}) t(tool_name, server) USING (tool_name)
  ) JOIN (VALUES {_SERVERS_SQL}) v(server, text) USING (server) GROUP BY ALL) s ON s.transcript_id = c.transcript_id, (VALUES ('judge_a'), ('judge_b')) j(judge)
""",
)
def judge_prompts(t: Tables) -> DataFrame:
    """One prompt per transcript and judge, with the specifications and matrices of the servers it calls."""
    spec = t.media_spec
    placed = spec.tools.withColumn("tool_pos", F.expr("CASE tool_name WHEN 'vid_from_image' THEN 1 ELSE 0 END"))
    specs = prompts.spec_json(g.tool_rows(placed, spec.params.drop("server")))
    matrices = literal_table(t.spark, [(s, _matrix(s)) for s in ("img", "vid", "av")], "server string, matrix string")
    requests = t.calls.select("transcript_id").distinct().selectExpr("transcript_id", "concat('Work on transcript ', transcript_id) AS request")
    cases = prompts.judge_cases(t.calls, requests, spec.tools, prompts.server_texts(specs, matrices))
    return prompts.judge_prompts(cases, [name for name, _ in JUDGES])


CTES["pair_blocks"] = """
SELECT conv_id, turn, chr(10) || 'Turn ' || turn || ':' || CASE WHEN role <> 'assistant' THEN chr(10) || 'USER: ' || text ELSE '' END
  || CASE WHEN role = 'user' AND turn % 3 = 0 THEN chr(10) || 'AGENT TOOL CALLS: look(flag=True, q=''x'')' ELSE '' END
  || CASE WHEN role = 'assistant' THEN chr(10) || 'ASSISTANT: ' || text WHEN role = 'user' AND next_role = 'assistant' THEN chr(10) || 'ASSISTANT: ' || next_text ELSE '' END AS block
FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lag(role) OVER w AS last_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role <> 'assistant' OR last_role IS DISTINCT FROM 'user'
"""
_WHOLE_SQL = "'Conversation ' || conv_id || chr(10) || string_agg(block, chr(10) ORDER BY turn)"


@query("transcript_text", f"SELECT conv_id AS transcript_id, {_WHOLE_SQL} AS text FROM pair_blocks GROUP BY conv_id")
def transcript_text(t: Tables) -> DataFrame:
    """Every row of a conversation: a user row takes the answer after it, other rows are turns of their own."""
    rows_of = t.read("conversations")
    following = with_next(rows_of, ["conv_id"], "turn", number_slice("turn"), ["role", "text"])
    answers = with_next(rows_of.withColumn("turn", -F.col("turn")), ["conv_id"], "turn", number_slice("turn"), ["role"])
    led = answers.where("role = 'assistant' AND next_role = 'user'").selectExpr("conv_id", "-turn AS turn")
    calls = "concat('look(', " + prompts.call_text("'{\"q\":\"x\",\"flag\":true}'") + ", ')')"
    turns = following.join(led, ["conv_id", "turn"], "left_anti").selectExpr(
        "conv_id AS transcript_id", "turn AS turn_index",
        "CASE WHEN role <> 'assistant' THEN text END AS user_message",
        f"CASE WHEN role = 'user' AND turn % 3 = 0 THEN {calls} END AS tool_calls",
        "CASE WHEN role = 'assistant' THEN text WHEN role = 'user' AND next_role = 'assistant' THEN next_text END AS agent_response",
    )
    return prompts.transcript_texts(turns)


@query(
    "coherence_prompts",
    "SELECT conv_id AS transcript_id, " + _duck_fill(prompts.COHERENCE_PROMPT, transcript=_WHOLE_SQL) + " AS prompt FROM pair_blocks GROUP BY conv_id",
)
def coherence_prompts(t: Tables) -> DataFrame:
    return transcript_text(t).selectExpr("transcript_id", f"{prompts.fill(prompts.COHERENCE_PROMPT, transcript='text')} AS prompt")


@query(
    "pattern_replies",
    "SELECT doc_id, CASE WHEN contains(text, 'the') THEN 'has-the' WHEN regexp_matches(text, '[0-9]{3}') THEN 'digits' END AS reply FROM documents",
)
def pattern_replies(t: Tables) -> DataFrame:
    named = t.read("documents").select("doc_id", F.col("text").alias("prompt"))
    return replies.pattern_replies(named, [("the", "has-the"), ("[0-9]{3}", "digits")]).select("doc_id", "reply")


@query(
    "pattern_table_replies",
    "SELECT doc_id, CASE WHEN contains(text, 'the') THEN 'has-the' WHEN regexp_matches(text, '[0-9]{3}') THEN 'digits' END AS reply FROM documents",
)
def pattern_table_replies(t: Tables) -> DataFrame:
    patterns = literal_table(t.spark, [(2, "[0-9]{3}", "digits"), (1, "the", "has-the")], "priority int, pattern string, reply string")
    named = t.read("documents").select("doc_id", F.col("text").alias("prompt"))
    return replies.replies_from_table(named, patterns).select("doc_id", "reply")


CTES["phrase_patterns"] = r"""
SELECT item_id AS priority, item_id % 3 AS form,
  CASE item_id % 3 WHEN 0 THEN phrase WHEN 1 THEN replace(phrase, ' ', '\s+') ELSE '(?:\b|^)' || replace(phrase, ' ', ' (?:[a-z]{2,40} )?') || 'q?' END AS pattern,
  'item-' || item_id AS reply
FROM (SELECT item_id, array_to_string(list_slice(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '), 3, 6), ' ') AS phrase FROM benchmark)
"""


@query(
    "indexed_pattern_replies",
    """
SELECT d.doc_id, min(p.priority) AS priority, arg_min(p.reply, p.priority) AS reply
FROM documents d LEFT JOIN phrase_patterns p ON contains(d.text, p.pattern) OR regexp_matches(d.text, p.pattern)
GROUP BY d.doc_id
""",
)
def indexed_pattern_replies(t: Tables) -> DataFrame:
    """A pattern for each benchmark item: four of its words as they are, with any blanks, or with words in between."""
    words = "array_join(slice(split(regexp_replace(text, '[^A-Za-z ]', ''), ' '), 3, 4), ' ')"
    forms = (
        r"CASE item_id % 3 WHEN 0 THEN phrase WHEN 1 THEN replace(phrase, ' ', '\\s+')"
        r" ELSE concat('(?:\\b|^)', replace(phrase, ' ', ' (?:[a-z]{2,40} )?'), 'q?') END"
    )
    table = t.read("benchmark").selectExpr("item_id AS priority", f"{words} AS phrase", "item_id").selectExpr(
        "priority", f"{forms} AS pattern", "concat('item-', item_id) AS reply"
    )
    named = t.read("documents").select("doc_id", F.col("text").alias("prompt"))
    told = replies.replies_from_table(named, table.withColumn("reply", F.struct("priority", "reply")))
    return told.select("doc_id", "reply.priority", "reply.reply")


@query(
    "ask_judge",
    "SELECT call_id, judge, CASE WHEN call_id % 50 <> 0 THEN CAST(length(reply) AS VARCHAR) END AS reply,"
    " CASE WHEN call_id % 50 = 0 THEN 'ValueError: refused' END AS error FROM judge_text",
)
def ask_judge(t: Tables) -> DataFrame:
    """The pluggable judge; here a function that counts letters and refuses some prompts."""

    def judge(text: str) -> str:
        if text.startswith("REFUSE"):
            raise ValueError("refused")
        return str(len(text))

    texts = _judge_text(t).selectExpr("call_id", "judge", "CASE WHEN call_id % 50 = 0 THEN 'REFUSE' ELSE reply END AS prompt")
    return replies.ask(texts, judge, ["call_id", "judge"])
