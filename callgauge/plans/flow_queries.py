"""Positions, chains and dataflow checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.operators import alignment, dataflow, formats, lint
from callgauge.operators.ordering import number_slice, with_next, with_position
from callgauge.plans.fixtures import Tables
from callgauge.plans.registry import CTES, query


@query("call_index", "SELECT call_id, transcript_id, call_index FROM calls")
def call_index(t: Tables) -> DataFrame:
    placed = with_position(t.call_keys, ["transcript_id"], ["ts", "call_id"], None, "call_index")
    return placed.select("call_id", "transcript_id", "call_index")


@query(
    "turn_index",
    """
SELECT conv_id, turn, CAST(coalesce(CASE WHEN conv_id % 2 = 0 THEN turn * 10 END, row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS INTEGER) AS turn_index
FROM conversations
""",
)
def turn_index(t: Tables) -> DataFrame:
    turns = t.read("conversations").select("conv_id", "turn")
    placed = with_position(turns, ["conv_id"], ["turn"], number_slice("turn"), "position")
    declared = "CASE WHEN conv_id % 2 = 0 THEN turn * 10 END"
    return placed.selectExpr("conv_id", "turn", f"CAST(coalesce({declared}, position + 1) AS INT) AS turn_index")


@query(
    "turn_pairs",
    """
SELECT conv_id, turn, text AS user_message, next_text AS agent_response FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'
""",
)
def turn_pairs(t: Tables) -> DataFrame:
    turns = with_next(t.read("conversations"), ["conv_id"], "turn", number_slice("turn"), ["role", "text"])
    paired = turns.where("role = 'user' AND next_role = 'assistant'")
    return paired.selectExpr("conv_id", "turn", "text AS user_message", "next_text AS agent_response")


@query(
    "uri_provenance",
    """
SELECT call_id, transcript_id, call_index, consumed_uri AS uri, producer_index, producer_tool_name FROM call_links WHERE consumed_uri IS NOT NULL
""",
)
def uri_provenance(t: Tables) -> DataFrame:
    linked = dataflow.provenance(t.consumed, t.produced, ["tool_name"])
    return linked.select("call_id", "transcript_id", "call_index", "uri", "producer_index", "producer_tool_name")


@query(
    "dangling_uris",
    """
SELECT c.call_id, c.transcript_id, c.call_index, c.consumed_uri AS uri FROM call_io c
WHERE c.consumed_uri IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM call_io p WHERE p.transcript_id = c.transcript_id AND p.produced_uri = c.consumed_uri AND p.call_index < c.call_index)
""",
)
def dangling_uris(t: Tables) -> DataFrame:
    return dataflow.dangling(t.consumed, t.produced).select("call_id", "transcript_id", "call_index", "uri")


@query(
    "setting_mismatch",
    """
SELECT call_id, transcript_id, aspect_ratio, producer_aspect_ratio FROM call_links WHERE producer_aspect_ratio <> aspect_ratio
""",
)
def setting_mismatch(t: Tables) -> DataFrame:
    bad = dataflow.setting_mismatch(t.consumed, t.produced, "aspect_ratio")
    return bad.select("call_id", "transcript_id", "aspect_ratio", "producer_aspect_ratio")


CTES["mix_outputs"] = """
SELECT transcript_id, call_index, 5 + call_id % 3 AS duration, CASE WHEN call_id % 2 = 0 THEN 24000 ELSE 48000 END AS rate FROM calls
"""


@query(
    "duration_mismatch",
    """
SELECT c.transcript_id, c.call_index, least(a.duration, b.duration) AS min_duration, greatest(a.duration, b.duration) AS max_duration,
  least(a.rate, b.rate) AS min_rate, greatest(a.rate, b.rate) AS max_rate
FROM calls c JOIN mix_outputs a ON a.transcript_id = c.transcript_id AND a.call_index = c.call_index - 1
JOIN mix_outputs b ON b.transcript_id = c.transcript_id AND b.call_index = c.call_index - 2
WHERE c.tool_name = 'av_combine' AND (a.duration <> b.duration OR a.rate <> b.rate)
""",
)
def duration_mismatch(t: Tables) -> DataFrame:
    name = "concat('gs://b/', transcript_id, '/', {0}, '.wav') AS uri"
    made = t.call_order.selectExpr(
        "transcript_id", "call_index", name.format("call_index"), "5 + call_id % 3 AS duration",
        "CASE WHEN call_id % 2 = 0 THEN 24000 ELSE 48000 END AS rate",
    )
    # A mixing call reads the outputs of the two calls before it.
    read = t.call_order.where("tool_name = 'av_combine' AND call_index > 0").selectExpr(
        "transcript_id", "call_index", "explode(array(call_index - 1, call_index - 2)) AS from_index"
    )
    read = read.where("from_index >= 0").selectExpr("transcript_id", "call_index", name.format("from_index"))
    return dataflow.input_mismatch(read, made, ["duration", "rate"])


@query(
    "order_violations",
    """
SELECT c.transcript_id, c.call_id, c.tool_name, n.needs_tool, CASE WHEN f.first_at IS NULL THEN 'never' ELSE 'late' END AS state
FROM calls c JOIN tool_needs n ON n.tool_name = c.tool_name
LEFT JOIN (SELECT transcript_id, tool_name, min(call_index) AS first_at FROM calls GROUP BY transcript_id, tool_name) f
  ON f.transcript_id = c.transcript_id AND f.tool_name = n.needs_tool
WHERE f.first_at IS NULL OR f.first_at > c.call_index
""",
)
def order_violations(t: Tables) -> DataFrame:
    return dataflow.order_violations(t.call_keys, t.tool_needs)


@query(
    "local_path_to_cloud",
    """
SELECT call_id, tool_name, out_uri FROM studio_calls
WHERE out_uri <> '' AND (out_uri LIKE '/%' OR out_uri LIKE 'file://%' OR NOT contains(out_uri, '://'))
""",
)
def local_path_to_cloud(t: Tables) -> DataFrame:
    return formats.local_paths(t.studio_calls, t.studio_spec, ["out_uri"]).selectExpr("call_id", "tool_name", "arg_text AS out_uri")


CTES["plain_calls"] = """
SELECT call_id, transcript_id, tool_name, CASE WHEN fault_no = 2 THEN '21:9' ELSE '16:9' END AS aspect_ratio, call_id % 2 AS variant FROM calls
"""


def _plain_calls(t: Tables) -> DataFrame:
    """Calls whose arguments leave out what is unique to a call; key order differs."""
    ratio = "CASE WHEN fault_no = 2 THEN '21:9' ELSE '16:9' END"
    return t.call_keys.selectExpr(
        "call_id", "transcript_id", "tool_name",
        f"CASE WHEN call_id % 3 = 0 THEN concat('{{\"v\":', call_id % 2, ',\"aspect_ratio\":\"', {ratio}, '\"}}')"
        f" ELSE concat('{{\"aspect_ratio\":\"', {ratio}, '\", \"v\": ', call_id % 2, '}}') END AS arguments",
    )


@query(
    "redundant_calls",
    "SELECT transcript_id, tool_name, count(*) AS n, min(call_id) AS first_call FROM plain_calls"
    " GROUP BY transcript_id, tool_name, aspect_ratio, variant HAVING count(*) > 1",
)
def redundant_calls(t: Tables) -> DataFrame:
    return dataflow.redundant_calls(_plain_calls(t)).drop("args_hash")


@query(
    "mock_lookup",
    """
SELECT c.call_id, c.tool_name, m.mock_output, m.mock_output IS NOT NULL AS matched FROM plain_calls c
LEFT JOIN (SELECT tool_name, aspect_ratio, variant, min('{"from":' || call_id || '}') AS mock_output FROM plain_calls
  WHERE call_id % 50 = 1 GROUP BY ALL) m ON m.tool_name = c.tool_name AND m.aspect_ratio = c.aspect_ratio AND m.variant = c.variant
""",
)
def mock_lookup(t: Tables) -> DataFrame:
    calls = _plain_calls(t)
    mocks = calls.where("call_id % 50 = 1").selectExpr("tool_name", "arguments", "concat('{\"from\":', call_id, '}') AS mock_output")
    return dataflow.mock_lookup(calls.drop("transcript_id"), mocks)


@query(
    "parallel_levels",
    """
WITH RECURSIVE edge AS (
  SELECT transcript_id, call_index AS node, producer_index AS parent FROM call_links),
walk AS (
  SELECT transcript_id, node, 0 AS level FROM edge WHERE parent IS NULL
  UNION ALL SELECT e.transcript_id, e.node, w.level + 1 FROM edge e JOIN walk w ON w.transcript_id = e.transcript_id AND w.node = e.parent)
SELECT transcript_id, node AS call_index, level FROM walk
""",
)
def parallel_levels(t: Tables) -> DataFrame:
    linked = dataflow.provenance(t.consumed, t.produced, []).where("producer_index IS NOT NULL")
    edges = linked.selectExpr("transcript_id", "call_index AS node", "producer_index AS parent")
    nodes = t.call_order.selectExpr("transcript_id", "call_index AS node")
    return dataflow.levels(nodes, edges).withColumnRenamed("node", "call_index")


@query(
    "oracle_diff",
    """
SELECT coalesce(e.transcript_id, c.transcript_id) AS transcript_id, coalesce(e.step_index, c.call_index) AS step_index,
  e.tool_name AS expected_tool, c.tool_name AS called_tool,
  CASE WHEN c.tool_name IS NULL THEN 'missing' WHEN e.tool_name IS NULL THEN 'extra' WHEN e.tool_name = c.tool_name THEN 'match' ELSE 'wrong_tool' END AS status
FROM expected_steps e FULL JOIN calls c ON c.transcript_id = e.transcript_id AND c.call_index = e.step_index
""",
)
def oracle_diff(t: Tables) -> DataFrame:
    return dataflow.workflow_diff(t.expected_steps, t.call_order)


@query(
    "workflow_edit_script",
    """
WITH RECURSIVE sides AS (
  SELECT transcript_id, coalesce(x.e, []) AS e, coalesce(y.g, []) AS g
  FROM (SELECT transcript_id, list(tool_name ORDER BY step_index) AS e FROM expected_steps GROUP BY transcript_id) x
  FULL JOIN (SELECT transcript_id, list(tool_name ORDER BY call_index) AS g FROM calls WHERE call_id % 7 <> 3 GROUP BY transcript_id) y USING (transcript_id)),
dp(transcript_id, e, g, i, line, dirs) AS (
  SELECT transcript_id, e, g, 0, range(0, len(g) + 1), [concat('S', repeat('I', len(g)))] FROM sides
  UNION ALL
  SELECT transcript_id, e, g, i + 1, new_line,
    list_append(dirs, concat('D', array_to_string(list_transform(range(1, len(g) + 1), lambda j: CASE
      WHEN new_line[j + 1] = line[j] + CAST(e[i + 1] <> g[j] AS INT) THEN CASE WHEN e[i + 1] = g[j] THEN 'K' ELSE 'R' END
      WHEN new_line[j + 1] = line[j + 1] + 1 THEN 'D' ELSE 'I' END), '')))
  FROM (SELECT *, list_transform(range(0, len(g) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda m: above[m + 1] + j - m))) AS new_line
    FROM (SELECT *, list_transform(range(0, len(g) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(line[j] + CAST(e[i + 1] <> g[j] AS INT), line[j + 1] + 1) END) AS above
      FROM dp WHERE i < len(e)))),
back(transcript_id, e, g, dirs, i, j, n, op) AS (
  SELECT transcript_id, e, g, dirs, len(e), len(g), 0, dirs[len(e) + 1][len(g) + 1] FROM dp WHERE i = len(e)
  UNION ALL
  SELECT transcript_id, e, g, dirs, ni, nj, n + 1, dirs[ni + 1][nj + 1]
  FROM (SELECT *, CASE WHEN op = 'I' THEN i ELSE i - 1 END AS ni, CASE WHEN op = 'D' THEN j ELSE j - 1 END AS nj FROM back WHERE i + j > 0))
SELECT transcript_id, CAST(max(n) OVER (PARTITION BY transcript_id) - n AS INTEGER) AS op_index,
  CASE op WHEN 'K' THEN 'keep' WHEN 'R' THEN 'replace' WHEN 'D' THEN 'delete' ELSE 'insert' END AS op,
  CAST(CASE WHEN op <> 'I' THEN i - 1 END AS INTEGER) AS expected_index, CAST(CASE WHEN op <> 'D' THEN j - 1 END AS INTEGER) AS call_index,
  CASE WHEN op <> 'I' THEN e[i] END AS expected_tool, CASE WHEN op <> 'D' THEN g[j] END AS called_tool
FROM back WHERE i + j > 0
""",
)
def workflow_edit_script(t: Tables) -> DataFrame:
    """Held-out steps aligned with the emitted calls, of which every seventh has got lost, so later steps are out of place."""
    return alignment.workflow_script(t.expected_steps, t.call_order.where("call_id % 7 <> 3"))


@query(
    "tool_set_diff",
    """
SELECT coalesce(e.transcript_id, c.transcript_id) AS transcript_id, coalesce(e.tool_name, c.tool_name) AS tool_name,
  CASE WHEN e.tool_name IS NOT NULL AND c.tool_name IS NOT NULL THEN 'both' WHEN c.tool_name IS NULL THEN 'not_called' ELSE 'not_expected' END AS status
FROM (SELECT DISTINCT transcript_id, tool_name FROM expected_steps) e
FULL JOIN (SELECT DISTINCT transcript_id, tool_name FROM calls) c ON c.transcript_id = e.transcript_id AND c.tool_name = e.tool_name
""",
)
def tool_set_diff(t: Tables) -> DataFrame:
    return dataflow.tool_set_diff(t.expected_steps, t.call_keys)


CTES["chain_args"] = """
SELECT transcript_id, call_index, call_id, call_id % 5 <> 0 AS has_file, call_id % 4 AS reads,
  'gs://b/' || transcript_id || '/' AS prefix FROM calls
"""


@query(
    "uri_grounding",
    """
SELECT c.transcript_id, c.call_index, c.prefix || CASE WHEN c.reads = 3 THEN 'lost' ELSE CAST(c.call_index - 1 AS VARCHAR) END || '.png' AS uri
FROM chain_args c
WHERE c.reads > 0 AND c.call_index > 0 AND NOT (c.transcript_id % 10 = 0)
  AND NOT EXISTS (SELECT 1 FROM chain_args p WHERE p.transcript_id = c.transcript_id AND p.call_index < c.call_index AND NOT p.has_file)
  AND NOT EXISTS (SELECT 1 FROM chain_args p WHERE p.transcript_id = c.transcript_id AND p.call_index = c.call_index - 1 AND p.has_file AND c.reads < 3)
""",
)
def uri_grounding(t: Tables) -> DataFrame:
    """Chains as real arguments: prefix, file name, a URI or a list of URIs to read, and a prompt."""
    file = "CASE WHEN call_id % 5 <> 0 THEN concat(',\"output_filename\":\"', call_index, '.png\"') ELSE '' END"
    read = "concat('\"gs://b/', transcript_id, '/', CASE WHEN call_id % 4 = 3 THEN 'lost' ELSE CAST(call_index - 1 AS STRING) END, '.png\"')"
    reads = (
        f"CASE WHEN call_index = 0 OR call_id % 4 = 0 THEN '' WHEN call_id % 4 = 1 THEN concat(',\"image_uri\":', {read})"
        f" ELSE concat(',\"images\":[', {read}, ']') END"
    )
    bucket = "CASE WHEN call_id % 2 = 0 THEN concat('gs://b/', transcript_id) ELSE concat('b/', transcript_id, '/') END"
    calls = t.call_order.selectExpr(
        "transcript_id", "call_index", f"concat('{{\"bucket\":\"', {bucket}, '\"', {file}, {reads}, '}}') AS arguments"
    )
    # Every tenth transcript has a prompt that names all of its files.
    prompts = (
        t.call_keys.groupBy("transcript_id").agg(F.count("*").alias("n")).selectExpr(
            "transcript_id",
            "CASE WHEN transcript_id % 10 = 0 THEN concat_ws(' ', transform(concat(transform(sequence(0L, n), x -> CAST(x AS STRING)),"
            " array('lost')), x -> concat('gs://b/', transcript_id, '/', x, '.png'))) ELSE 'no files' END AS prompt",
        )
    )
    return dataflow.ungrounded(calls, prompts)
