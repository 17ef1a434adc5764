"""Scenario generation, coverage, mock outputs and transcripts, over the registry made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.operators import generation as g
from callgauge.operators import lint
from callgauge.plans.fixtures import Tables
from callgauge.plans.registry import CTES, query

CTES["spec_tools"] = """
SELECT CASE WHEN p_partkey % 97 = 0 THEN 'solo_' || p_partkey ELSE p_brand END AS server, 'tool_' || p_partkey AS tool_name,
  p_partkey AS tool_pos, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS description FROM part
"""
CTES["spec_params"] = """
SELECT 'tool_' || p_partkey AS tool_name, q.* EXCLUDE (there) FROM part, LATERAL (
  SELECT * FROM (VALUES (0, 'prompt', 'string', true, CAST(NULL AS VARCHAR), true), (1, 'image_uri', 'string', p_partkey % 3 = 0, NULL, true),
    (2, 'style', 'string', p_partkey % 4 = 0, 'draft|final', p_partkey % 2 = 0), (3, 'count', 'integer', p_partkey % 5 = 0, NULL, p_partkey % 3 <> 1),
    (4, 'hd', 'boolean', p_partkey % 6 = 0, NULL, true), (5, 'tags', 'array', p_partkey % 7 = 0, NULL, p_partkey % 5 <> 2))
  v(param_pos, param_name, param_type, required, enum_values, there)) q
WHERE p_partkey % 13 <> 0 AND there
"""
CTES["spec_needs"] = """
SELECT t.*, n.req, n.opt, coalesce(n.params, 0) AS params, CASE WHEN n.tool_name IS NULL THEN 'No parameters required.'
  ELSE concat_ws('; ', 'Required parameters: ' || n.req, 'Optional parameters: ' || n.opt) END AS needs
FROM spec_tools t LEFT JOIN (SELECT tool_name, count(*) AS params, string_agg(param_name, ', ' ORDER BY param_pos) FILTER (WHERE required) AS req,
  string_agg(param_name, ', ' ORDER BY param_pos) FILTER (WHERE NOT required) AS opt FROM spec_params GROUP BY tool_name) n ON n.tool_name = t.tool_name
"""
CTES["single_args"] = f"""
SELECT tool_name, '{{' || string_agg('"' || param_name || '":' || CASE WHEN param_name LIKE '%uri%' THEN '"{g.SINGLE_URI}"'
  WHEN enum_values IS NOT NULL THEN '"draft"' WHEN param_type = 'string' THEN '"{g.SINGLE_TEXT}"' WHEN param_type = 'integer' THEN '1'
  WHEN param_type = 'boolean' THEN 'true' ELSE '"val"' END, ',' ORDER BY param_pos) || '}}' AS parameters
FROM spec_params WHERE required GROUP BY tool_name
"""
CTES["server_sizes"] = "SELECT server, count(*) AS n FROM spec_tools GROUP BY server"
CTES["chained"] = f"""
SELECT t.server, t.tool_name, t.step_index, CASE WHEN t.step_index = 0 THEN '{g.START_URI}' ELSE 'gs://mock-bucket/step_' || t.step_index || '_out.mp4' END AS in_uri
FROM (SELECT s.server, s.tool_name, CAST(row_number() OVER (PARTITION BY s.server ORDER BY s.tool_pos) - 1 AS INTEGER) AS step_index
  FROM spec_tools s JOIN server_sizes z ON z.server = s.server WHERE z.n > 1) t
"""
CTES["chain_params"] = f"""
SELECT c.tool_name, '{{' || string_agg('"' || p.param_name || '":' || CASE WHEN p.param_name LIKE '%uri%' THEN '"' || c.in_uri || '"'
  WHEN p.enum_values IS NOT NULL THEN '"draft"' ELSE '"{g.CHAIN_TEXT}"' END, ',' ORDER BY p.param_pos) || '}}' AS parameters
FROM chained c JOIN spec_params p ON p.tool_name = c.tool_name WHERE p.required GROUP BY c.tool_name
"""
# Steps of the default tiers: simple for every tool, a chain per server, or a lone complex step.
CTES["spec_steps"] = """
SELECT t.server, t.server || '|simple|' || t.tool_name AS scenario_id, 'simple' AS tier, 0 AS step_index, t.tool_name, coalesce(a.parameters, '{}') AS parameters
FROM spec_tools t LEFT JOIN single_args a ON a.tool_name = t.tool_name
UNION ALL SELECT t.server, t.server || '|complex|' || t.tool_name, 'complex', 0, t.tool_name, coalesce(a.parameters, '{}')
FROM spec_tools t JOIN server_sizes z ON z.server = t.server AND z.n = 1 LEFT JOIN single_args a ON a.tool_name = t.tool_name
UNION ALL SELECT c.server, c.server || '|complex|chain', 'complex', c.step_index, c.tool_name, coalesce(p.parameters, '{}')
FROM chained c LEFT JOIN chain_params p ON p.tool_name = c.tool_name
"""
CTES["spec_scenarios"] = f"""
SELECT DISTINCT scenario_id, server, tier, CASE WHEN scenario_id LIKE '%|chain' THEN '{g.CHAIN["category"]}' ELSE 'Single Tool ' || tier END AS category,
  CASE WHEN scenario_id LIKE '%|chain' THEN '{g.CHAIN["title"]}' ELSE 'Execute ' || tool_name END AS title,
  CASE WHEN scenario_id LIKE '%|chain' THEN '{g.CHAIN["prompt"]}' ELSE 'Please call ' || tool_name || ' with standard parameters' END AS prompt,
  CASE WHEN scenario_id LIKE '%|chain' THEN '{g.CHAIN["followup"]}' ELSE '{g.SINGLE_FOLLOWUP}' END AS agent_followup
FROM spec_steps
"""
CTES["spec_seeds"] = """
SELECT 'tool_' || p_partkey AS tool_name, '{"uri":"gs://b/' || p_partkey || '.png"}' AS example_output FROM part WHERE p_partkey % 2 = 0
"""
CTES["spec_grounded"] = """
SELECT s.*, coalesce(e.example_output, '{"status":"success","function":"' || s.tool_name || '"}') AS mock_output,
  CASE WHEN e.tool_name IS NULL THEN 'medium' ELSE 'high' END AS confidence
FROM spec_steps s LEFT JOIN spec_seeds e ON e.tool_name = s.tool_name
"""


def rows(t: Tables) -> DataFrame:
    return g.tool_rows(t.spec_tools, t.spec_params)


@query("param_needs", "SELECT tool_name, needs FROM spec_needs")
def param_needs(t: Tables) -> DataFrame:
    return rows(t).selectExpr("tool_name", f"{g.NEEDS_TEXT} AS needs")


@query(
    "tool_interpretations",
    "SELECT server, tool_name, coalesce(nullif(description, ''), 'Executes ' || tool_name) AS what_it_does, needs AS what_it_needs,"
    " 'Automated tool calling for ' || tool_name AS why_its_used, 'Media Production|Enterprise Automation' AS enterprise_context FROM spec_needs",
)
def tool_interpretations(t: Tables) -> DataFrame:
    return g.interpretations(rows(t)).withColumn("enterprise_context", F.array_join("enterprise_context", "|"))


@query(
    "interpretation_replies",
    "SELECT n.server, n.tool_name, CASE WHEN p.tool_pos % 3 = 0 THEN 'told ' || p.tool_pos ELSE coalesce(nullif(n.description, ''), 'Executes ' || n.tool_name) END AS what_it_does,"
    " p.tool_pos % 3 = 0 AS from_reply FROM spec_needs n JOIN spec_tools p ON p.tool_name = n.tool_name",
)
def interpretation_replies(t: Tables) -> DataFrame:
    """Stage replies where they can be used, offline interpretations for the other tools."""
    answers = rows(t).selectExpr(
        "server", "tool_name",
        "CASE tool_pos % 3 WHEN 0 THEN concat('Here: {\"what_it_does\":\"told ', tool_pos, '\",\"enterprise_context\":\"c\"}') WHEN 1 THEN 'sorry' ELSE '{\"other\":1}' END AS reply",
    )
    return g.interpretations_from(rows(t), answers).select("server", "tool_name", "what_it_does", "from_reply")


@query(
    "scenarios_simple",
    "SELECT t.server, 'Execute ' || t.tool_name AS title, 'Please call ' || t.tool_name || ' with standard parameters' AS prompt, 'simple' AS tier,"
    " 'Single Tool simple' AS category, t.tool_name, coalesce(a.parameters, '{}') AS parameters FROM spec_tools t LEFT JOIN single_args a ON a.tool_name = t.tool_name",
)
def scenarios_simple(t: Tables) -> DataFrame:
    return g.single_tool(rows(t), ["simple"]).select("server", "title", "prompt", "tier", "category", "tool_name", "parameters")


@query(
    "scenarios_complex",
    "SELECT server, scenario_id, step_index, tool_name, parameters FROM spec_steps WHERE tier = 'complex'",
)
def scenarios_complex(t: Tables) -> DataFrame:
    _, steps = g.scenarios(rows(t), ("complex",))
    return steps.select("server", "scenario_id", "step_index", "tool_name", "parameters")


@query("chained_steps", "SELECT server, tool_name, step_index, in_uri FROM chained")
def chained_steps(t: Tables) -> DataFrame:
    """The start URI or the earlier step's output, read back from the arguments where the tool takes a URI."""
    sized = g.with_server_size(t.spec_tools).where("server_tools > 1")
    uri = F.expr("array(struct(0 AS param_pos, 'in_uri' AS param_name, 'string' AS param_type, true AS required, CAST(NULL AS array<string>) AS enum))")
    steps = g.chain_steps(sized.withColumn("args", uri))
    return steps.selectExpr("server", "tool_name", "step_index", "get_json_object(parameters, '$.in_uri') AS in_uri")


@query(
    "scenarios_fallback",
    "SELECT server, 'Fallback ' || tool_name AS title, 'Execute ' || tool_name AS prompt, tier, tool_name, '{}' AS parameters"
    " FROM spec_tools, (VALUES ('simple'), ('complex'), ('boundary')) v(tier)",
)
def scenarios_fallback(t: Tables) -> DataFrame:
    made = g.fallback(rows(t), ["simple", "complex", "boundary"])
    return made.select("server", "title", "prompt", "tier", "tool_name", "parameters")


@query(
    "scenario_rollup",
    """
SELECT s.tier, s.category, count(*) AS scenarios, CAST(sum(k.n) AS BIGINT) AS steps FROM spec_scenarios s
JOIN (SELECT scenario_id, count(*) AS n FROM spec_steps GROUP BY scenario_id) k ON k.scenario_id = s.scenario_id GROUP BY ROLLUP (s.tier, s.category)
""",
)
def scenario_rollup(t: Tables) -> DataFrame:
    made, steps = g.scenarios(rows(t))
    sizes = steps.groupBy("scenario_id").agg(F.count("*").alias("n"))
    joined = made.select("scenario_id", "tier", "category").join(sizes, "scenario_id", "left")
    return joined.rollup("tier", "category").agg(F.count("*").alias("scenarios"), F.sum("n").alias("steps"))


CTES["thin_steps"] = "SELECT tool_name FROM spec_tools WHERE tool_pos % 3 <> 0"


def _thin_steps(t: Tables) -> DataFrame:
    """Scenarios that leave out every third tool."""
    return g.single_tool(g.tool_rows(t.spec_tools.where("tool_pos % 3 <> 0"), t.spec_params), ["simple"])


@query(
    "uncovered_tools",
    "SELECT server, tool_name FROM spec_tools WHERE tool_name NOT IN (SELECT tool_name FROM thin_steps)",
)
def uncovered_tools(t: Tables) -> DataFrame:
    return g.uncovered(t.spec_tools, _thin_steps(t)).select("server", "tool_name")


@query(
    "coverage_fill",
    """
SELECT tool_name, 'Single Tool simple' AS category, 'Execute ' || tool_name AS title FROM thin_steps
UNION ALL SELECT tool_name, 'Coverage Fallback', 'Coverage Guarantee for ' || tool_name FROM spec_tools WHERE tool_pos % 3 = 0
""",
)
def coverage_fill(t: Tables) -> DataFrame:
    thin = _thin_steps(t)
    filled = thin.unionByName(g.coverage_scenarios(g.uncovered(t.spec_tools, thin)))
    return filled.select("tool_name", "category", "title")


@query(
    "tool_coverage",
    "SELECT server, count(*) FILTER (WHERE tool_pos % 3 <> 0) AS covered, count(*) AS tools,"
    " round(CAST(count(*) FILTER (WHERE tool_pos % 3 <> 0) AS DOUBLE) / count(*), 4) AS share FROM spec_tools GROUP BY server",
)
def tool_coverage(t: Tables) -> DataFrame:
    return g.coverage(t.spec_tools, _thin_steps(t))


@query("mock_grounding", "SELECT scenario_id, step_index, tool_name, mock_output, confidence FROM spec_grounded")
def mock_grounding(t: Tables) -> DataFrame:
    _, steps = g.scenarios(rows(t))
    return g.ground(steps, t.spec_seeds).select("scenario_id", "step_index", "tool_name", "mock_output", "confidence")


@query(
    "mock_grounding_low",
    """
SELECT s.tool_name, CASE WHEN e.tool_name IS NOT NULL THEN 'high' WHEN b.server IS NOT NULL THEN 'low' ELSE 'medium' END AS confidence
FROM spec_tools s LEFT JOIN spec_seeds e ON e.tool_name = s.tool_name
LEFT JOIN (SELECT server FROM spec_tools x LEFT JOIN spec_seeds y ON y.tool_name = x.tool_name GROUP BY server HAVING count(y.tool_name) = 0) b ON b.server = s.server
""",
)
def mock_grounding_low(t: Tables) -> DataFrame:
    steps = g.single_tool(rows(t), ["simple"])
    seeded = t.spec_tools.join(t.spec_seeds.withColumn("seeded", F.lit(1)), "tool_name", "left")
    bare = seeded.groupBy("server").agg(F.count("seeded").alias("n")).where("n = 0")
    return g.ground(steps, t.spec_seeds, bare).select("tool_name", "confidence")


@query(
    "grounding_ratio",
    "SELECT count(*) FILTER (WHERE confidence = 'high') AS high, count(*) AS steps,"
    " round(avg(CASE WHEN confidence = 'high' THEN 1.0 ELSE 0.0 END), 4) AS ratio FROM spec_grounded",
)
def grounding_ratio(t: Tables) -> DataFrame:
    _, steps = g.scenarios(rows(t))
    return g.grounding_ratio(g.ground(steps, t.spec_seeds))


CTES["spec_turns"] = """
SELECT s.scenario_id, s.title AS scenario_title, s.tier, 1 AS turn_index, s.prompt AS user_message, k.n AS n_calls, 'Executed ' || k.n || ' tool call(s).' AS agent_response
FROM spec_scenarios s JOIN (SELECT scenario_id, count(*) AS n FROM spec_steps GROUP BY scenario_id) k ON k.scenario_id = s.scenario_id
UNION ALL SELECT scenario_id, title, tier, 2, agent_followup, 0, 'Follow-up complete.' FROM spec_scenarios
"""


@query("multi_turn_expand", "SELECT * FROM spec_turns")
def multi_turn_expand(t: Tables) -> DataFrame:
    made, steps = g.scenarios(rows(t))
    return g.turns(made, g.ground(steps, t.spec_seeds))


@query(
    "multi_turn_fallback",
    """
SELECT 'Fallback ' || tool_name AS scenario_title, 1 AS turn_index, 'Execute ' || tool_name AS user_message, 'Executed 1 tool call(s).' AS agent_response FROM spec_tools
UNION ALL SELECT 'Fallback ' || tool_name, 2, 'Follow up', 'Completed follow-up turn.' FROM spec_tools
""",
)
def multi_turn_fallback(t: Tables) -> DataFrame:
    made = g.fallback(rows(t), ["simple"])
    turns = g.turns(made.select(*g.SCENARIO), g.ground(made.select(*g.STEP), t.spec_seeds), usable=False)
    return turns.select("scenario_title", "turn_index", "user_message", "agent_response")


@query(
    "harness",
    """
SELECT server, 'interpretations' AS stage, count(*) AS n FROM spec_tools GROUP BY server
UNION ALL SELECT server, 'scenarios', count(*) FROM spec_scenarios GROUP BY server
UNION ALL SELECT server, 'mock_steps', count(*) FROM spec_grounded GROUP BY server
UNION ALL SELECT s.server, 'turns', count(*) FROM spec_turns u JOIN spec_scenarios s ON s.scenario_id = u.scenario_id GROUP BY s.server
""",
)
def harness(t: Tables) -> DataFrame:
    stages = g.harness(t.spec_tools, t.spec_params, t.spec_seeds)
    stages["turns"] = stages["turns"].withColumn("server", F.substring_index("scenario_id", "|", 1))
    counted = [
        stages[name].groupBy("server").agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))
        for name in ("interpretations", "scenarios", "mock_steps", "turns")
    ]
    out = counted[0]
    for frame in counted[1:]:
        out = out.unionByName(frame)
    return out.select("server", "stage", "n")


@query(
    "fault_injection",
    """
SELECT c.call_id, f.injected_fault, f.expected_taxonomy, f.rule_id FROM calls c,
  (VALUES ('missing_required', 'argument_completeness', 'missing_required'), ('missing_required', 'argument_completeness', 'type_mismatch'),
    ('illegal_enum', 'argument_value', 'capability_violation'), ('illegal_enum', 'argument_value', 'illegal_enum'),
    ('wrong_type', 'argument_type', 'type_mismatch'), ('unsupported_capability', 'argument_value', 'capability_violation')) f(injected_fault, expected_taxonomy, rule_id)
WHERE c.fault_no >= 13 AND (f.rule_id <> 'illegal_enum' OR c.tool_name = 'img_generate')
""",
)
def fault_injection(t: Tables) -> DataFrame:
    """Valid calls, four faults each, and the rules the linter then finds."""
    valid = t.calls_unordered.where("fault_no >= 13")
    broken = g.inject_faults(valid, "prompt", "aspect_ratio", "sample_count", "generate_audio", "m-1")
    found = lint.violations(broken, t.media_spec)
    return found.select("call_id", "injected_fault", "expected_taxonomy", "rule_id")
