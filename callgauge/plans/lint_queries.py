"""Lint rules, lint results and lint gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.operators import formats, gates, lint
from callgauge.plans.fixtures import Tables
from callgauge.plans.registry import CTES, query
from callgauge.session import literal_table
from callgauge.sources.transcripts import normalize_calls

COLUMNS = "call_id, transcript_id, tool_name, parameter_name, rule_id, severity"


def media_violations(t: Tables) -> DataFrame:
    return lint.violations(t.calls_unordered, t.media_spec)


def _rule(name: str, view: str, condition: str) -> None:
    @query(name, f"SELECT {COLUMNS} FROM {view}")
    def build(t: Tables) -> DataFrame:
        return media_violations(t).where(condition).select(*COLUMNS.split(", "))


_rule("lint_unknown_tool", "v_unknown_tool", "rule_id = 'unknown_tool'")
_rule("lint_missing_required", "v_missing_required", "rule_id = 'missing_required'")
_rule("lint_unknown_param", "v_unknown_param", "rule_id = 'unknown_param'")
_rule("lint_type_mismatch", "v_type_mismatch", "rule_id = 'type_mismatch'")
_rule("lint_illegal_enum", "v_illegal_enum", "rule_id = 'illegal_enum'")
_rule("lint_invalid_uri", "v_invalid_uri", "rule_id = 'invalid_uri'")
_rule("lint_unknown_model", "v_unknown_model", "rule_id = 'unknown_model'")
_rule("lint_cap_flag", "v_cap_flag", "rule_id = 'capability_violation' AND parameter_name = 'generate_audio'")
_rule("lint_cap_set", "v_cap_set", "rule_id = 'capability_violation' AND parameter_name = 'aspect_ratio'")
_rule("lint_min_value", "v_min_value", "rule_id = 'invalid_value'")


@query("lint_summary", "SELECT transcript_id, total_calls, total_violations, is_valid FROM lint_by_transcript")
def lint_summary(t: Tables) -> DataFrame:
    return lint.summary(t.calls_unordered, t.media_spec)


@query(
    "lint_same_name",
    """
SELECT transcript_id, CAST(count(*) AS BIGINT) AS total_calls, CAST(sum(v) AS BIGINT) AS total_violations, sum(v) = 0 AS is_valid FROM (
  SELECT transcript_id, CASE WHEN call_id % 6 = 5 THEN 1 WHEN (call_id % 2 = 0) = (call_id % 3 = 0) THEN 0 ELSE 2 END AS v FROM calls) GROUP BY transcript_id
""",
)
def lint_same_name(t: Tables) -> DataFrame:
    """Two servers have a tool of one name with other parameters; each call names its server."""
    tools = literal_table(t.spark, [(s, "search", "") for s in ("one", "two")], "server string, tool_name string, description string")
    params = [("one", "search", 0, "query", "string", True, None, False), ("two", "search", 0, "text", "string", True, None, False)]
    params = literal_table(
        t.spark, params,
        "server string, tool_name string, param_pos int, param_name string, param_type string, required boolean, enum array<string>, is_uri boolean",
    )
    spec = lint.Spec(tools, params, t.media_spec.capabilities.limit(0), t.media_spec.rules.limit(0), bounded=True)
    calls = t.call_keys.selectExpr(
        "call_id", "transcript_id", "'search' AS tool_name",
        "CASE WHEN call_id % 6 = 5 THEN 'none' WHEN call_id % 2 = 0 THEN 'one' ELSE 'two' END AS server",
        "CASE WHEN call_id % 3 = 0 THEN '{\"query\":\"x\"}' ELSE '{\"text\":\"x\"}' END AS arguments",
    )
    return lint.summary(calls, spec)


@query(
    "lint_all",
    f"SELECT {COLUMNS}, phase, call_index FROM violations JOIN (SELECT call_id, call_index FROM calls) USING (call_id)",
)
def lint_all(t: Tables) -> DataFrame:
    found = lint.violations(t.calls, t.media_spec)
    return found.select(*COLUMNS.split(", "), "phase", "call_index")


@query(
    "violations_by_rule",
    "SELECT transcript_id, rule_id, count(*) AS n FROM violations GROUP BY transcript_id, rule_id",
)
def violations_by_rule(t: Tables) -> DataFrame:
    return media_violations(t).groupBy("transcript_id", "rule_id").agg(F.count("*").alias("n"))


@query(
    "lint_pass_rate",
    "SELECT count(*) FILTER (WHERE is_valid) AS valid, count(*) AS total FROM lint_by_transcript",
)
def lint_pass_rate(t: Tables) -> DataFrame:
    return lint_summary(t).agg(F.expr("count_if(is_valid)").alias("valid"), F.count("*").alias("total"))


@query(
    "first_violation",
    """
SELECT transcript_id, rule_id AS first_rule, call_id AS first_call_id FROM (
  SELECT v.*, row_number() OVER (PARTITION BY transcript_id ORDER BY call_index, phase, coalesce(parameter_name, ''), rule_id) AS rn
  FROM violations v JOIN (SELECT call_id, call_index FROM calls) USING (call_id)) WHERE rn = 1
""",
)
def first_violation(t: Tables) -> DataFrame:
    # (ts, call_id) orders calls as call_index does, so no window is needed.
    place = F.struct("ts", "call_id", "phase", F.coalesce("parameter_name", F.lit("")), "rule_id")
    return (
        media_violations(t)
        .groupBy("transcript_id")
        .agg(F.min_by(F.struct("rule_id", "call_id"), place).alias("first"))
        .selectExpr("transcript_id", "first.rule_id AS first_rule", "first.call_id AS first_call_id")
    )


@query(
    "violation_messages",
    """
WITH found AS MATERIALIZED (SELECT call_id, rule_id, parameter_name, tool_name FROM violations),
own_args AS MATERIALIZED (SELECT call_id, arg_name, jtype, arg_text FROM args WHERE call_id IN (SELECT call_id FROM found)),
own_models AS MATERIALIZED (SELECT call_id, model FROM call_models WHERE call_id IN (SELECT call_id FROM found))
SELECT v.call_id, v.rule_id, v.parameter_name,
  CASE v.rule_id
    WHEN 'unknown_tool' THEN 'Tool ''' || v.tool_name || ''' is not in the registry'
    WHEN 'missing_required' THEN 'Required parameter ''' || v.parameter_name || ''' is missing or empty'
    WHEN 'unknown_param' THEN 'The tool has no parameter ''' || v.parameter_name || '''; it takes '
      || l.allowed
    WHEN 'type_mismatch' THEN '''' || v.parameter_name || ''' should be ' || p.param_type || ' but is '
      || CASE a.jtype WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'ARRAY' THEN 'list'
              WHEN 'OBJECT' THEN 'dict' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END
    WHEN 'illegal_enum' THEN '''' || a.arg_text || ''' is none of the values [''' || replace(p.enum_values, '|', ''', ''') || ''']'
    WHEN 'invalid_uri' THEN '''' || a.arg_text || ''' is neither a full path nor a bucket or web address'
    WHEN 'unknown_model' THEN 'model ''' || a.arg_text || ''' is not a known model'
    WHEN 'invalid_value' THEN 'sample_count ''' || a.arg_text || ''' is below 1'
    ELSE v.parameter_name || ' ''' || a.arg_text || ''' is not supported on ''' || m.model || '''' END AS message
FROM found v
LEFT JOIN tool_params p ON p.tool_name = v.tool_name AND p.param_name = v.parameter_name
LEFT JOIN own_args a ON a.call_id = v.call_id AND a.arg_name = v.parameter_name
LEFT JOIN own_models m ON m.call_id = v.call_id
LEFT JOIN (SELECT tool_name, '[''' || string_agg(param_name, ''', ''' ORDER BY param_pos) || ''']' AS allowed FROM tool_params GROUP BY tool_name) l ON l.tool_name = v.tool_name
""",
)
def violation_messages(t: Tables) -> DataFrame:
    return media_violations(t).select("call_id", "rule_id", "parameter_name", "message")


# ---- raw call objects ---------------------------------------------------------

CTES["raw_calls"] = """
SELECT event_id AS call_id, user_id * 100 + CAST(day(ts) AS BIGINT) AS transcript_id,
  CASE event_id % 10
    WHEN 0 THEN '{"function_name":"img_generate","parameters":{"prompt":"scene ' || event_id || '"},"id":"c' || event_id || '"}'
    WHEN 1 THEN '{"name":"vid_generate","arguments":{"prompt":"scene ' || event_id || '"},"call_id":"k' || event_id || '"}'
    WHEN 2 THEN '"just text"'
    WHEN 3 THEN '{"function_name":null,"name":"img_generate","arguments":{"prompt":"scene ' || event_id || '"}}'
    WHEN 4 THEN '{"function_name":["x"],"arguments":{}}'
    WHEN 5 THEN '{"name":"","arguments":[1]}'
    WHEN 6 THEN '{"name":"img_generate","arguments":[1]}'
    WHEN 7 THEN '{"function_name":"img_generate","parameters":"text"}'
    WHEN 8 THEN '{"name":"music_generate"}'
    ELSE '{"name":"av_combine","parameters":{},"arguments":{"prompt":"scene ' || event_id || '"}}' END AS call
FROM events
"""
CTES["lint_calls"] = """
SELECT call_id, transcript_id, json_type(CAST(call AS JSON)) = 'OBJECT' AS is_object,
  CASE WHEN list_contains(json_keys(CAST(call AS JSON)), 'function_name') THEN json_extract(call, '$.function_name') ELSE json_extract(call, '$.name') END AS jname,
  CASE WHEN list_contains(json_keys(CAST(call AS JSON)), 'parameters') THEN json_extract(call, '$.parameters') ELSE json_extract(call, '$.arguments') END AS jargs
FROM raw_calls
"""


@query(
    "call_normalize",
    """
SELECT call_id, is_object, CASE WHEN json_type(jname) = 'VARCHAR' THEN json_extract_string(jname, '$') END AS tool_name,
  CASE WHEN is_object THEN CAST(jargs AS VARCHAR) END AS arguments,
  CASE WHEN is_object THEN coalesce(nullif(json_extract_string(call, '$.name'), ''), nullif(json_extract_string(call, '$.function_name'), ''), '') END AS call_name,
  CASE WHEN is_object THEN coalesce(nullif(CAST(json_extract(call, '$.arguments') AS VARCHAR), '{}'), nullif(CAST(json_extract(call, '$.parameters') AS VARCHAR), '{}'), '{}') END AS call_arguments,
  coalesce(json_extract_string(call, '$.call_id'), json_extract_string(call, '$.id')) AS call_ref
FROM lint_calls JOIN raw_calls USING (call_id)
""",
)
def call_normalize(t: Tables) -> DataFrame:
    return normalize_calls(t.raw_calls).drop("transcript_id")


@query(
    "lint_malformed",
    """
SELECT call_id, CASE WHEN json_type(jname) = 'VARCHAR' THEN json_extract_string(jname, '$') END AS tool_name, 'malformed_call' AS rule_id,
  CASE WHEN NOT is_object THEN 'Tool call must be a JSON object' ELSE 'Tool call has no valid ''function_name'' string' END AS message
FROM lint_calls
WHERE NOT is_object OR jname IS NULL OR json_type(jname) <> 'VARCHAR' OR json_extract_string(jname, '$') = ''
""",
)
def lint_malformed(t: Tables) -> DataFrame:
    found = lint.violations(normalize_calls(t.raw_calls), t.media_spec)
    return found.where("rule_id = 'malformed_call'").select("call_id", "tool_name", "rule_id", "message")


@query(
    "lint_args_type",
    """
SELECT call_id, json_extract_string(jname, '$') AS tool_name, 'type_mismatch' AS rule_id,
  'Tool arguments must be a dict, got ' || CASE json_type(jargs) WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' ELSE '?' END AS message
FROM lint_calls
WHERE is_object AND json_type(jname) = 'VARCHAR' AND json_extract_string(jname, '$') IN (SELECT tool_name FROM servers)
  AND jargs IS NOT NULL AND json_type(jargs) <> 'OBJECT'
""",
)
def lint_args_type(t: Tables) -> DataFrame:
    found = lint.violations(normalize_calls(t.raw_calls), t.media_spec)
    whole = found.where("rule_id = 'type_mismatch' AND parameter_name IS NULL")
    return whole.select("call_id", "tool_name", "rule_id", "message")


# ---- the studio registry --------------------------------------------------------

CTES["studio_calls"] = """
SELECT event_id AS call_id, user_id * 100 + CAST(day(ts) AS BIGINT) AS transcript_id,
  ['clip_morph', 'gif_make', 'speech_say', 'song_make'][event_id % 4 + 1] AS tool_name,
  ['m-1', 'm-2', 'm-3'][event_id % 3 + 1] AS model, event_id % 70 AS fps,
  ['LINEAR16', 'MP3', 'OGG_OPUS', 'FLAC', 'WAV'][event_id % 5 + 1] AS encoding, event_id % 6 AS sample_count,
  ['["a","b"]', '["a",1]', '[]', '[null]'][event_id % 4 + 1] AS tags,
  ['gs://b/o.mp4', 'gs://Bad/x', 'b/o', 'gs://b/', 'gs://b-1/a/b', 's3://b/x', 'gs://b_c/.d', '', 'gs://-b/x', 'gs://b.c/d', '/tmp/x'][event_id % 11 + 1] AS out_uri,
  ['ratio', 'aspectRatio', 'image_url', 'aspect_ratioo', 'aspect_ratio', 'aspect_ratio', 'image_uri'][event_id % 7 + 1] AS last_key
FROM events
"""
CTES["v_cap_tool"] = """
SELECT call_id, transcript_id, tool_name, 'model' AS parameter_name, 'capability_violation' AS rule_id, 'CAPABILITY_VIOLATION' AS severity
FROM studio_calls WHERE tool_name = 'clip_morph' AND model = 'm-1'
"""
CTES["v_range"] = """
SELECT call_id, transcript_id, tool_name, 'fps' AS parameter_name, 'capability_violation' AS rule_id, 'CAPABILITY_VIOLATION' AS severity
FROM studio_calls WHERE tool_name = 'gif_make' AND (fps > 60 OR fps < 1)
"""
CTES["v_fixed_set"] = """
SELECT call_id, transcript_id, tool_name, 'encoding' AS parameter_name, 'capability_violation' AS rule_id, 'CAPABILITY_VIOLATION' AS severity
FROM studio_calls WHERE tool_name = 'speech_say' AND encoding NOT IN ('LINEAR16', 'MP3', 'OGG_OPUS')
"""
CTES["v_cap_max"] = """
SELECT call_id, transcript_id, tool_name, 'sample_count' AS parameter_name, 'capability_violation' AS rule_id, 'ERROR' AS severity
FROM studio_calls WHERE tool_name = 'song_make' AND sample_count > CASE model WHEN 'm-1' THEN 4 WHEN 'm-2' THEN 2 ELSE 3 END
"""
CTES["v_studio_min"] = """
SELECT call_id, transcript_id, tool_name, 'sample_count' AS parameter_name, 'invalid_value' AS rule_id, 'ERROR' AS severity
FROM studio_calls WHERE tool_name = 'song_make' AND sample_count < 1
"""


def _studio_rule(name: str, sql: str, condition: str) -> None:
    @query(name, sql)
    def build(t: Tables) -> DataFrame:
        return lint.violations(t.studio_calls, t.studio_spec).where(condition).select(*COLUMNS.split(", "))


_studio_rule("lint_cap_tool", f"SELECT {COLUMNS} FROM v_cap_tool", "phase = 6 AND parameter_name = 'model'")
_studio_rule("lint_range", f"SELECT {COLUMNS} FROM v_range", "phase = 6 AND parameter_name = 'fps'")
_studio_rule("lint_cap_fixed_set", f"SELECT {COLUMNS} FROM v_fixed_set", "phase = 6 AND parameter_name = 'encoding'")
_studio_rule(
    "lint_cap_max",
    f"SELECT {COLUMNS} FROM v_cap_max",
    "rule_id = 'capability_violation' AND parameter_name = 'sample_count'",
)
_studio_rule(
    "lint_capability_rules",
    " UNION ALL ".join(
        f"SELECT {COLUMNS} FROM {v}" for v in ("v_cap_tool", "v_range", "v_fixed_set", "v_cap_max", "v_studio_min")
    ),
    "phase = 6",
)


@query(
    "lint_gcs_uri",
    """
SELECT call_id, transcript_id, tool_name, 'out_uri' AS parameter_name, out_uri AS arg_text
FROM studio_calls WHERE out_uri <> '' AND NOT regexp_matches(out_uri, '^gs://[a-z0-9][-_.a-z0-9]*/.+')
""",
)
def lint_gcs_uri(t: Tables) -> DataFrame:
    return formats.bucket_uri_findings(t.studio_calls, t.studio_spec, ["out_uri"])


@query(
    "lint_item_type",
    """
SELECT call_id, transcript_id, tool_name, 'tags' AS parameter_name FROM studio_calls
WHERE EXISTS (SELECT 1 FROM json_each(CAST(tags AS JSON)) j WHERE j.type <> 'VARCHAR')
""",
)
def lint_item_type(t: Tables) -> DataFrame:
    return formats.item_type_findings(t.studio_calls, t.studio_spec, ["tags"])


@query(
    "lint_alias_hint",
    """
SELECT call_id, transcript_id, tool_name, last_key AS parameter_name,
  CASE last_key WHEN 'image_url' THEN 'image_uri' ELSE 'aspect_ratio' END AS hint, last_key <> 'aspect_ratioo' AS is_alias
FROM studio_calls WHERE last_key NOT IN ('aspect_ratio', 'image_uri')
""",
)
def lint_alias_hint(t: Tables) -> DataFrame:
    return formats.alias_hints(t.studio_calls, t.studio_spec)


# ---- the lookups, as joins --------------------------------------------------------


@query("calls_known_tools", "SELECT call_id, tool_name FROM calls WHERE tool_name IN (SELECT tool_name FROM servers)")
def calls_known_tools(t: Tables) -> DataFrame:
    tools = t.media_spec.checked().tools.select("tool_name")
    return t.call_keys.select("call_id", "tool_name").join(F.broadcast(tools), "tool_name", "left_semi")


@query(
    "args_with_spec",
    """
SELECT a.call_id, a.tool_name, a.arg_name, a.jvalue AS arg_json, p.param_type, coalesce(p.required, false) AS required
FROM args a LEFT JOIN tool_params p ON p.tool_name = a.tool_name AND p.param_name = a.arg_name
""",
)
def args_with_spec(t: Tables) -> DataFrame:
    return (
        lint.argument_frame(t.calls_unordered, t.media_spec)
        .where("arg_name IS NOT NULL AND coalesce(rule_no, 0) = 0")
        .selectExpr(
            "call_id", "tool_name", "arg_name", "to_json(arg) AS arg_json", "param_type",
            "coalesce(param_required, false) AS required",
        )
    )


@query(
    "calls_with_caps",
    """
SELECT m.call_id, m.server, m.model, k.audio, k.ratios, k.max_samples
FROM call_models m LEFT JOIN capabilities k ON k.server = m.server AND k.model = m.model
""",
)
def calls_with_caps(t: Tables) -> DataFrame:
    return (
        lint.argument_frame(t.calls_unordered, t.media_spec)
        .where("known_tool AND coalesce(rule_no, 0) = 0 AND arg_pos = 0")
        .selectExpr(
            "call_id", "spec_server AS server", "model_name AS model",
            "CAST(caps['audio'].text AS BOOLEAN) AS audio",
            "array_join(caps['ratios'].items, '|') AS ratios",
            "CAST(caps['max_samples'].text AS INT) AS max_samples",
        )
    )


# ---- gates ------------------------------------------------------------------------


@query(
    "lint_quarantine",
    """
SELECT c.call_id, c.transcript_id, coalesce(v.n, 0) > 0 AS quarantined, CAST(coalesce(v.n, 0) AS BIGINT) AS n_violations
FROM calls c LEFT JOIN (SELECT call_id, count(*) AS n FROM violations GROUP BY call_id) v USING (call_id)
""",
)
def lint_quarantine(t: Tables) -> DataFrame:
    return gates.quarantine(t.calls_unordered, t.media_spec)


@query(
    "lint_coverage",
    """
SELECT count(DISTINCT c.call_id) AS broken, count(DISTINCT v.call_id) AS caught,
  round(CAST(count(DISTINCT v.call_id) AS DOUBLE) / count(DISTINCT c.call_id), 4) AS coverage
FROM calls c LEFT JOIN violations v USING (call_id) WHERE c.fault_no < 13
""",
)
def lint_coverage(t: Tables) -> DataFrame:
    broken = t.calls_unordered.where("fault_no < 13")
    return gates.lint_coverage(broken, t.media_spec)
