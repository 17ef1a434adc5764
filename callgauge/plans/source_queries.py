"""Loading specifications, matrices, transcripts and stage files; writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.operators import lint, generation as g
from callgauge.operators import prompts
from callgauge.plans.fixtures import Tables
from callgauge.plans.generation_queries import rows
from callgauge.plans.registry import CTES, query
from callgauge.plans.score_queries import scored
from callgauge.session import scratch_path
from callgauge.sources import sinks, specs, stages, transcripts


def _spec_documents(t: Tables) -> DataFrame:
    """Specification files over the parts: ten tools a folder, some as a bare list, some with two files."""
    each = prompts.spec_json(rows(t)).selectExpr("server", "tool_pos", "concat(server, '/', floor(tool_pos / 10)) AS source", "spec")
    folders = each.groupBy("server", "source").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(tool_pos, spec))), x -> x.spec), ',')").alias("list"),
        F.min("tool_pos").alias("first"),
    )
    main = "CASE WHEN first % 3 = 0 THEN concat('[', list, ',\"note\"]') ELSE concat('{\"tools\":[', list, ']}') END"
    return folders.selectExpr(
        "server",
        "source",
        "inline(CASE WHEN first % 2 = 0 THEN array(struct('tools_list.json' AS file, "
        f"{main} AS doc), struct('tools.json' AS file, '[]' AS doc)) ELSE array(struct('tools.json' AS file, {main} AS doc)) END)",
    )


def _loaded(t: Tables) -> DataFrame:
    return specs.normalize_tools(specs.tool_documents(specs.spec_documents(_spec_documents(t))))


@query("spec_load", "SELECT server, tool_name, description FROM spec_tools")
def spec_load(t: Tables) -> DataFrame:
    return _loaded(t).select("server", "tool_name", "description")


@query(
    "registry_load",
    "SELECT server, count(*) AS tools, count(DISTINCT server || '/' || (tool_pos // 10)) AS folders FROM spec_tools GROUP BY server",
)
def registry_load(t: Tables) -> DataFrame:
    per_folder = _loaded(t).groupBy("server", "source").agg(F.count("*").alias("n"))
    return per_folder.groupBy("server").agg(F.sum("n").alias("tools"), F.count("*").alias("folders"))


@query(
    "param_catalog",
    "SELECT tool_name, param_pos_in AS param_pos, param_name, param_type, required, CASE WHEN enum_values IS NOT NULL THEN '\"draft\"|\"final\"' END AS enum"
    " FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tool_name ORDER BY param_pos) - 1 AS INTEGER) AS param_pos_in FROM spec_params)",
)
def param_catalog(t: Tables) -> DataFrame:
    listed = specs.param_rows(_loaded(t))
    return listed.select("tool_name", "param_pos", "param_name", "param_type", "required", F.array_join("enum", "|").alias("enum"))


@query(
    "registry_union",
    "SELECT server, tool_name FROM spec_tools WHERE server IN ('Brand#1', 'Brand#2', 'Brand#13')",
)
def registry_union(t: Tables) -> DataFrame:
    return specs.only_servers(t.spec_tools, ["Brand#1", "Brand#2", "Brand#13"]).select("server", "tool_name")


@query(
    "registry_override",
    "SELECT tool_name, CASE WHEN tool_pos % 4 = 0 THEN 'new ' || tool_name ELSE description END AS description FROM spec_tools"
    " UNION ALL SELECT 'added_' || tool_pos, 'added' FROM spec_tools WHERE tool_pos % 9 = 0",
)
def registry_override(t: Tables) -> DataFrame:
    passed = t.spec_tools.where("tool_pos % 4 = 0").withColumn("description", F.expr("concat('new ', tool_name)"))
    added = t.spec_tools.where("tool_pos % 9 = 0").selectExpr("server", "concat('added_', tool_pos) AS tool_name", "tool_pos", "'added' AS description")
    return specs.override_tools(t.spec_tools, passed.unionByName(added)).select("tool_name", "description")


@query(
    "tool_normalize",
    """
SELECT 'tool_' || p_partkey AS tool_name, v.param_name, v.param_type, v.listed AND p_partkey % 5 < 3 OR v.flagged AS required
FROM part, (VALUES ('q', 'string', true, false), ('n', 'integer', false, true), ('raw', 'string', false, false)) v(param_name, param_type, listed, flagged)
WHERE p_partkey % 5 <> 4
""",
)
def tool_normalize(t: Tables) -> DataFrame:
    """Five schema layouts: three key names, a bare property map, and none."""
    props = "'{\"q\":{\"type\":\"string\"},\"n\":{\"type\":\"integer\",\"required\":true},\"raw\":\"text\"}'"
    schema = f"concat('{{\"type\":\"object\",\"properties\":', {props}, ',\"required\":[\"q\"]}}')"
    body = (
        f"CASE p_partkey % 5 WHEN 0 THEN concat(',\"inputSchema\":', {schema}) WHEN 1 THEN concat(',\"inputSchema\":{{}},\"input_schema\":', {schema})"
        f" WHEN 2 THEN concat(',\"parameters\":', {schema}) WHEN 3 THEN concat(',\"parameters\":', {props}) ELSE '' END"
    )
    docs = t.read("part").selectExpr(f"concat('{{\"name\":\"tool_', p_partkey, '\"', {body.replace('{{}}', '{}')}, '}}') AS tool".replace("'}}'", "'}'"))
    return specs.param_rows(specs.normalize_tools(docs)).select("tool_name", "param_name", "param_type", "required")


CTES["supplier_caps"] = """
SELECT 'srv_' || s_suppkey AS server, 'm-' || s_nationkey AS model, v.capability,
  CASE v.capability WHEN 'audio' THEN CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE '"true"' END WHEN 'most' THEN CAST(s_suppkey % 9 AS VARCHAR) ELSE '["16:9"]' END AS value
FROM supplier, (VALUES ('audio'), ('most'), ('ratios')) v(capability)
"""


def _matrix_docs(t: Tables) -> DataFrame:
    """One matrix per supplier: models at the top, or under a wrapper."""
    audio = "CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE '\"true\"' END"
    caps = f"concat('{{\"m-', s_nationkey, '\":{{\"audio\":', {audio}, ',\"most\":', s_suppkey % 9, ',\"ratios\":[\"16:9\"]}}}}')"
    doc = f"CASE WHEN s_suppkey % 3 = 0 THEN concat('{{\"models\":', {caps}, ',\"metadata\":{{\"v\":1}}}}') ELSE {caps} END AS doc"
    return t.read("supplier").selectExpr("concat('srv_', s_suppkey) AS server", doc)


@query("capability_long", "SELECT server, model, capability, value FROM supplier_caps")
def capability_long(t: Tables) -> DataFrame:
    return specs.capability_rows(_matrix_docs(t))


@query(
    "capability_overlay",
    "SELECT server, model, capability, CASE WHEN capability = 'most' AND server LIKE '%1' THEN '99' ELSE value END AS value FROM supplier_caps"
    " UNION ALL SELECT server, 'm-new', 'most', '99' FROM supplier_caps WHERE capability = 'most' AND server LIKE '%1'",
)
def capability_overlay(t: Tables) -> DataFrame:
    base = specs.capability_rows(_matrix_docs(t))
    over = base.where("capability = 'most' AND server LIKE '%1'")
    over = over.selectExpr("server", "explode(array(model, 'm-new')) AS model", "capability", "'99' AS value")
    return specs.overlay_capabilities(base, over)


@query(
    "seed_load",
    "SELECT 'tool_' || p_partkey AS tool_name, CASE WHEN p_partkey % 2 = 0 THEN 'high' END AS grounding, '{\"uri\":\"u' || p_partkey || '\"}' AS example_output FROM part",
)
def seed_load(t: Tables) -> DataFrame:
    """Seed files with a note, with the wrapper, and as the bare output."""
    output = "concat('{\"uri\":\"u', p_partkey, '\"}')"
    one = f"CASE WHEN p_partkey % 2 = 0 THEN concat('{{\"grounding\":\"high\",\"example_output\":', {output}, '}}') ELSE {output} END"
    docs = t.read("part").selectExpr(
        "p_brand AS server", f"concat('{{\"_note\":\"shape\",\"tool_', p_partkey, '\":', {one}, '}}') AS doc"
    )
    return specs.seed_rows(docs).drop("server")


@query(
    "transcript_load",
    """
SELECT event_id, 0 AS case_index, CASE event_id % 3 WHEN 2 THEN 'Case-1' ELSE 'L' || event_id END AS label, 0 AS call_index,
  '{"name":"a","x":' || event_id || '}' AS call FROM events
UNION ALL SELECT event_id, 1, 'M' || event_id, NULL, NULL FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 0, 'L' || event_id, 1, '{"name":"b"}' FROM events WHERE event_id % 3 = 1
""",
)
def transcript_load(t: Tables) -> DataFrame:
    """A list of two cases (the second without calls), a lone case, and a lone call in place of the list."""
    call = "concat('{\"name\":\"a\",\"x\":', event_id, '}')"
    doc = (
        f"CASE event_id % 3 WHEN 0 THEN concat('[{{\"label\":\"L', event_id, '\",\"calls\":[', {call}, ']}},{{\"label\":\"M', event_id, '\",\"calls\":[]}}]')"
        f" WHEN 1 THEN concat('{{\"label\":\"L', event_id, '\",\"agent_calls\":[', {call}, ',{{\"name\":\"b\"}}]}}')"
        f" ELSE concat('{{\"calls\":', {call}, '}}') END AS doc"
    )
    cases = transcripts.cases_from_json(t.read("events").selectExpr("event_id", doc))
    return cases.select("event_id", "case_index", "label", "call_index", "call")


@query(
    "transcript_files",
    r"""
SELECT 'L' || event_id AS label, event_type AS prompt, n.call_index, n.call FROM events, LATERAL (SELECT * FROM (VALUES
  (0, '{"name":"a","text":"{' || event_id || '}}"}'), (1, '{"name":"b","text":"\"}]"}')) x(call_index, call)) n
""",
)
def transcript_files(t: Tables) -> DataFrame:
    """Cases written to files and read again by byte ranges; their strings hold brackets and quotes."""
    calls = r"""concat('[{"name":"a","text":"{', event_id, '}}"},{"name":"b","text":"\\"}]"}]')"""
    lines = t.read("events").selectExpr(f"""concat('{{"label":"L', event_id, '","prompt":"', event_type, '","calls":', {calls}, '}}') AS value""")
    path = scratch_path(t.spark, "transcripts")
    lines.write.text(path)
    return transcripts.load_transcripts(t.spark, path).select("label", "prompt", "call_index", "call")


# ---- stage files -----------------------------------------------------------------------


@query(
    "scenario_flatten",
    """
SELECT p_partkey, v.tier, v.category, v.title, v.step_tool, v.parameters FROM part, LATERAL (SELECT * FROM (VALUES
  ('simple', 'General', 'S' || p_partkey, 'a', '{"k":1}'), ('simple', 'Ops', 'Untitled Scenario', 'b', '{}'), ('complex', 'Ops', 'C' || p_partkey, 'c', '{}'),
  ('complex', 'Ops', 'C' || p_partkey, 'd', '{}')) x(tier, category, title, step_tool, parameters)) v
""",
)
def scenario_flatten(t: Tables) -> DataFrame:
    doc = (
        "concat('{\"simple\":{\"categories\":[{\"scenarios\":[{\"title\":\"S', p_partkey, '\",\"agent_workflow\":[{\"function_name\":\"a\",\"parameters\":{\"k\":1}}]}]},"
        "{\"category\":\"Ops\",\"scenarios\":[{\"agent_workflow\":[{\"name\":\"b\",\"arguments\":[1]}]}]}]},"
        "\"complex\":{\"categories\":[{\"category\":\"Ops\",\"scenarios\":[{\"title\":\"C', p_partkey, '\",\"agent_workflow\":[{\"name\":\"c\"},{\"function_name\":\"d\"}]}]}]}}') AS doc"
    )
    scenarios = stages.scenario_rows(t.read("part").selectExpr("p_partkey", doc))
    steps = stages.step_rows(scenarios.select("p_partkey", "tier", "category", "title", "scenario"), "scenario", "agent_workflow")
    return steps.selectExpr("p_partkey", "tier", "category", "title", "tool_name AS step_tool", "parameters")


@query(
    "stage_rows",
    """
SELECT p_partkey, 'interpretation' AS stage, 0 AS pos, CASE p_partkey % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'x|y' ELSE '' END AS value FROM part
UNION ALL SELECT p_partkey, 'mock', 0, 'f:medium' FROM part UNION ALL SELECT p_partkey, 'mock', 1, 'g:high' FROM part
UNION ALL SELECT p_partkey, 'turn', 1, 'u:2' FROM part UNION ALL SELECT p_partkey, 'turn', 7, ':0' FROM part
""",
)
def stage_rows(t: Tables) -> DataFrame:
    part = t.read("part").select("p_partkey")
    context = "CASE p_partkey % 3 WHEN 0 THEN '\"one\"' WHEN 1 THEN '[\"x\",\"y\"]' ELSE '\"\"' END"
    first = stages.interpretation_rows(part.selectExpr("p_partkey", f"concat('{{\"enterprise_context\":', {context}, '}}') AS doc"))
    mock_doc = "'{\"mock_workflow\":[{\"name\":\"f\"},{\"function_name\":\"g\",\"confidence\":\"high\"}]}' AS doc"
    mock = stages.step_rows(part.selectExpr("p_partkey", mock_doc), "doc", "mock_workflow")
    turn_doc = "'{\"turns\":[{\"user_message\":\"u\",\"agent_tool_calls\":[{},{}]},{\"turn_index\":7}]}' AS doc"
    turn = stages.turn_rows(part.selectExpr("p_partkey", turn_doc))
    return (
        first.selectExpr("p_partkey", "'interpretation' AS stage", "0 AS pos", "array_join(enterprise_context, '|') AS value")
        .unionByName(mock.selectExpr("p_partkey", "'mock' AS stage", "step_index AS pos", "concat(tool_name, ':', confidence) AS value"))
        .unionByName(turn.selectExpr("p_partkey", "'turn' AS stage", "turn_index AS pos", "concat(user_message, ':', n_calls) AS value"))
    )


@query(
    "turn_call_rows",
    "SELECT p_partkey, 1 AS turn_index, i AS step_index, CASE i WHEN 0 THEN 'f' ELSE 'g' END AS tool_name, CASE i WHEN 0 THEN '{\"n\":' || p_partkey || '}' ELSE '{}' END AS parameters"
    " FROM part, (VALUES (0), (1)) s(i)",
)
def turn_call_rows(t: Tables) -> DataFrame:
    """Calls of saved turns come back as rows."""
    doc = (
        "concat('{\"turns\":[{\"agent_tool_calls\":[{\"name\":\"f\",\"arguments\":{\"n\":', p_partkey, '}},{\"function_name\":\"g\"}],"
        "\"tool_responses\":[{\"ok\":true}]},{\"turn_index\":7}]}') AS doc"
    )
    return stages.turn_calls(stages.turn_rows(t.read("part").selectExpr("p_partkey", doc)), ["p_partkey"])


@query(
    "violation_ingest",
    "SELECT call_id, rule_id, parameter_name, tool_name, CASE WHEN call_id % 3 = 0 THEN 'ERROR' ELSE severity END AS severity FROM violations",
)
def violation_ingest(t: Tables) -> DataFrame:
    """Saved violations under either set of key names, read back."""
    found = lint.violations(t.calls_unordered, t.media_spec)
    alias = "to_json(named_struct('tool_name', tool_name, 'parameter', parameter_name, 'category', rule_id))"
    plain = "to_json(named_struct('tool_name', tool_name, 'parameter_name', parameter_name, 'rule_id', rule_id, 'severity', severity))"
    saved = found.selectExpr("call_id", f"CASE WHEN call_id % 3 = 0 THEN {alias} ELSE {plain} END AS doc")
    return stages.violation_rows(saved).select("call_id", "rule_id", "parameter_name", "tool_name", "severity")


@query(
    "score_ingest",
    """
SELECT call_id, judge, CAST(name_accuracy AS DOUBLE) / 10 AS name_accuracy, CASE WHEN call_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS relevancy,
  CAST(necessity AS DOUBLE) / 10 AS overall_tool_calling, CASE WHEN call_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS overall_coherence, 0.0::DOUBLE AS overuse_detection, 'a|b' AS failures
FROM judge_scores
""",
)
def score_ingest(t: Tables) -> DataFrame:
    tenth = lambda c: f"CAST({c} / 10 AS DECIMAL(3,1))"
    doc = (
        f"CASE WHEN call_id % 2 = 0 THEN concat('{{\"arguments\":{{\"name_accuracy\":', {tenth('name_accuracy')}, ',\"relevancy\":0.5}},\"tc_overall\":', {tenth('necessity')}, ',\"failures\":[\"a\",\"b\"]}}')"
        f" ELSE concat('{{\"name_accuracy\":', {tenth('name_accuracy')}, ',\"overall_tool_calling\":', {tenth('necessity')}, ',\"coh_overall\":0.25,\"failures\":[\"a\",\"b\"]}}') END AS doc"
    )
    saved = stages.score_rows(t.judge_scores.selectExpr("call_id", "judge", doc))
    return saved.select(
        "call_id", "judge", "name_accuracy", "relevancy", "overall_tool_calling", "overall_coherence", "overuse_detection", "failures"
    )


# ---- sinks ------------------------------------------------------------------------------


@query(
    "results_sink",
    "SELECT s.server, p.judge, count(*) AS n, round(sum(p.tc), 3) AS total FROM scored_plain p JOIN servers s ON s.tool_name = p.tool_name GROUP BY s.server, p.judge",
)
def results_sink(t: Tables) -> DataFrame:
    """Judge results written by server and read back."""
    tools = t.media_spec.checked().tools.select("tool_name", "server")
    rows_out = scored(t, False).join(F.broadcast(tools), "tool_name").selectExpr("server", "false AS enriched", "call_id", "judge", "tc")
    path = scratch_path(t.spark, "results")
    sinks.write_results(rows_out, path)
    back = t.spark.read.parquet(path)
    return back.groupBy("server", "judge").agg(F.count("*").alias("n"), F.round(F.sum("tc"), 3).alias("total"))


@query(
    "harness_export",
    """
SELECT 'interpretations' AS stage, count(*) AS n FROM spec_tools UNION ALL SELECT 'scenarios', count(*) FROM spec_scenarios
UNION ALL SELECT 'mock_steps', count(*) FROM spec_grounded UNION ALL SELECT 'turns', count(*) FROM spec_turns
UNION ALL SELECT 'metadata', count(*) FROM server_sizes
""",
)
def harness_export(t: Tables) -> DataFrame:
    """All stages published together as JSON and read back."""
    made = g.harness(t.spec_tools, t.spec_params, t.spec_seeds)
    root = scratch_path(t.spark, "harness")
    sinks.publish(made, root)
    out = None
    for name, back in sinks.published(t.spark, root).items():
        counted = back.agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out.select("stage", "n")


@query(
    "harness_republished",
    "SELECT tool_name, confidence, count(*) AS steps FROM spec_grounded GROUP BY tool_name, confidence",
)
def harness_republished(t: Tables) -> DataFrame:
    """Steps of the second of two published runs; the first one held no step."""
    made = g.harness(t.spec_tools, t.spec_params, t.spec_seeds)
    root = scratch_path(t.spark, "harness")
    sinks.publish({"mock_steps": made["mock_steps"].where("false")}, root)
    sinks.publish({"mock_steps": made["mock_steps"]}, root)
    return sinks.published(t.spark, root)["mock_steps"].groupBy("tool_name", "confidence").agg(F.count("*").alias("steps"))


@query(
    "result_json",
    "SELECT call_id, judge, '{\"tc\":' || CAST(tc AS VARCHAR) || ',\"kind\":\"' || kind || '\"}' AS result FROM scored_plain",
)
def result_json(t: Tables) -> DataFrame:
    return sinks.result_json(scored(t, False).select("call_id", "judge", "tc", "kind"), ["call_id", "judge"])


CTES["complexity"] = """
SELECT t.server, avg(coalesce(n.params, 0)) AS mean_params, CAST(sum(n.optional) AS DOUBLE) / nullif(sum(n.params), 0) AS optional_share, any_value(q.quality) AS quality
FROM spec_tools t LEFT JOIN (SELECT tool_name, count(*) AS params, count(*) FILTER (WHERE NOT required) AS optional FROM spec_params GROUP BY tool_name) n ON n.tool_name = t.tool_name
JOIN (SELECT s.server, avg(p.tc) AS quality FROM scored_plain p JOIN spec_tools s ON s.tool_pos = p.call_id % (SELECT max(tool_pos) + 1 FROM spec_tools) GROUP BY s.server) q ON q.server = t.server
GROUP BY t.server
"""


@query(
    "schema_complexity",
    "SELECT count(*) AS servers, round(corr(mean_params, quality), 6) AS params_corr, round(corr(optional_share, quality), 6) AS optional_corr FROM complexity",
)
def schema_complexity(t: Tables) -> DataFrame:
    """Parameters per tool and optional share of each server against its mean score."""
    sizes = rows(t).selectExpr("server", "tool_pos", "size(args) AS params", "size(filter(args, a -> NOT a.required)) AS optional")
    shape = sizes.groupBy("server").agg(F.avg("params").alias("mean_params"), F.expr("try_divide(sum(optional), sum(params))").alias("optional_share"))
    # Sums per tool first: the join to servers then sees one row per tool.
    # Calls go round all tools of the registry.
    tools = t.spec_tools.agg((F.max("tool_pos") + 1).alias("n_tools"))
    called = scored(t, False).join(F.broadcast(tools))  # one row
    per_tool = called.groupBy(F.expr("call_id % n_tools").alias("tool_pos")).agg(F.sum("tc").alias("total"), F.count("tc").alias("n"))
    quality = per_tool.join(t.spec_tools.select("tool_pos", "server"), "tool_pos").groupBy("server").agg(F.expr("sum(total) / sum(n)").alias("quality"))
    return shape.join(quality, "server").agg(
        F.count("*").alias("servers"),
        F.round(F.corr("mean_params", "quality"), 6).alias("params_corr"),
        F.round(F.corr("optional_share", "quality"), 6).alias("optional_corr"),
    )
