"""The fixture views as DuckDB SQL, for checking queries (see FIXTURES.md, part B)."""

from callgauge.plans.registry import CTES

CTES["tool_params"] = """
SELECT t.server, t.tool_name, p.param_pos, p.param_name, p.param_type,
       (p.param_name = 'prompt' OR (p.param_name = 'image_uri' AND t.tool_name = 'vid_from_image')) AS required,
       CASE WHEN p.param_name = 'aspect_ratio' AND t.tool_name = 'img_generate'
            THEN '1:1|16:9|9:16|4:3' END AS enum_values
FROM (VALUES ('img','img_generate'), ('vid','vid_generate'), ('vid','vid_from_image'),
             ('music','music_generate'), ('av','av_combine')) AS t(server, tool_name)
CROSS JOIN
     (VALUES (0,'seed','number'), (1,'prompt','string'), (2,'model','string'),
             (3,'aspect_ratio','string'), (4,'generate_audio','boolean'),
             (5,'sample_count','number'), (6,'image_uri','string'),
             (7,'images','array'), (8,'bucket','string')) AS p(param_pos, param_name, param_type)
"""

CTES["capabilities"] = """
SELECT s.server, m.model, m.audio, m.ratios, m.max_samples
FROM (VALUES ('img'), ('vid'), ('music'), ('av')) AS s(server)
CROSS JOIN
     (VALUES ('m-1', false, '16:9', 4), ('m-2', true, '16:9|9:16', 2),
             ('m-3', true, '16:9|9:16|1:1', 3)) AS m(model, audio, ratios, max_samples)
"""

CTES["calls"] = """
SELECT call_id, transcript_id,
       CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY ts, call_id) - 1 AS INT) AS call_index,
       ts, fault_no, tool_name,
       '{"seed":' || CAST(call_id % 100 AS VARCHAR(20))
       || CASE WHEN fault_no = 0 THEN ''
               WHEN fault_no = 10 THEN ',"prompt":""'
               WHEN fault_no = 11 THEN ',"prompt":null'
               ELSE ',"prompt":"scene ' || CAST(call_id AS VARCHAR(20)) || '"' END
       || ',"model":"' || CASE WHEN fault_no = 3 THEN 'm-9-ultra'
                               WHEN fault_no = 4 THEN 'm-1'
                               WHEN call_id % 2 = 0 THEN 'm-2' ELSE 'm-3' END || '"'
       || CASE WHEN fault_no = 1 THEN ',"ratio":"16:9"'
               WHEN fault_no = 2 THEN ',"aspect_ratio":"21:9"'
               ELSE ',"aspect_ratio":"16:9"' END
       || ',"generate_audio":' || CASE WHEN fault_no = 4 THEN 'true' ELSE 'false' END
       || ',"sample_count":' || CASE WHEN fault_no = 5 THEN '"two"' WHEN fault_no = 6 THEN '0'
                                     WHEN fault_no = 12 THEN 'true' ELSE '1' END
       || ',"image_uri":"' || CASE WHEN fault_no = 7 THEN 'in.png'
                                   ELSE 'gs://b/' || CAST(transcript_id AS VARCHAR(20)) || '.png' END || '"'
       || ',"images":' || CASE WHEN fault_no = 9 THEN '"gs://b/x.png"' ELSE '["gs://b/x.png"]' END
       || ',"bucket":"gs://b/out/"}' AS arguments
FROM (
  SELECT event_id AS call_id, user_id * 100 + CAST(day(ts) AS BIGINT) AS transcript_id, ts,
         CAST(event_id % 20 AS INT) AS fault_no,
         CASE WHEN event_id % 20 = 8 THEN 'media_unknown'
              WHEN event_type = 'view' THEN 'img_generate'
              WHEN event_type = 'click' THEN 'vid_generate'
              WHEN event_type = 'purchase' THEN 'vid_from_image'
              WHEN event_type = 'signup' THEN 'music_generate'
              ELSE 'av_combine' END AS tool_name
  FROM events) e
"""

CTES["judge_scores"] = """
SELECT c.call_id, c.transcript_id, c.fault_no, j.judge,
       CASE WHEN c.fault_no >= 13 THEN 'correct' ELSE 'broken' END AS kind,
       CASE WHEN c.fault_no IN (0, 10, 11) THEN 'argument_completeness'
            WHEN c.fault_no = 1 THEN 'argument_name'
            WHEN c.fault_no IN (5, 9, 12) THEN 'argument_type'
            WHEN c.fault_no = 8 THEN 'selection'
            WHEN c.fault_no >= 13 THEN 'none' ELSE 'argument_value' END AS expected_taxonomy,
       c.call_index > 0 AS multi_call,
       CAST(CASE WHEN c.fault_no >= 13 THEN 8 + (c.call_id * 3 + j.k) % 3 ELSE (c.call_id * 7 + j.k) % 11 END AS INT) AS necessity,
       CAST(CASE WHEN c.fault_no >= 13 THEN 8 + (c.call_id * 5 + j.k) % 3 ELSE (c.call_id * 3 + j.k) % 11 END AS INT) AS sel_correctness,
       CAST(CASE WHEN c.fault_no >= 13 THEN 8 + (c.call_id + j.k) % 3 ELSE (c.call_id * 5 + j.k) % 11 END AS INT) AS sel_specificity,
       CAST(CASE WHEN c.fault_no >= 13 THEN 9 ELSE (c.call_id * 9 + j.k) % 11 END AS INT) AS sel_completeness,
       CAST((c.call_id + j.k) % 11 AS INT) AS sequence_logic,
       CAST((c.call_id * 2 + j.k) % 11 AS INT) AS dependency_handling,
       CAST((c.call_id * 4 + j.k) % 11 AS INT) AS execution_efficiency,
       CAST(CASE WHEN c.call_id % 89 = 0 THEN 15 WHEN c.fault_no >= 13 THEN 10 ELSE (c.call_id * 6 + j.k) % 11 END AS INT) AS completeness,
       CAST(CASE WHEN c.fault_no >= 13 THEN 10 ELSE (c.call_id * 8 + j.k) % 11 END AS INT) AS name_accuracy,
       CAST(CASE WHEN c.fault_no >= 13 THEN 9 ELSE (c.call_id * 10 + j.k) % 11 END AS INT) AS value_accuracy,
       CAST(CASE WHEN c.fault_no >= 13 THEN 10 ELSE (c.call_id * 2 + 3 * j.k) % 11 END AS INT) AS type_compliance,
       CAST(CASE WHEN c.fault_no >= 13 THEN 10 ELSE (c.call_id * 3 + 5 * j.k) % 11 END AS INT) AS format_compliance,
       CAST(CASE WHEN c.call_id % 97 = 0 THEN NULL WHEN c.fault_no >= 13 THEN 10 ELSE (c.call_id + 7 * j.k) % 11 END AS INT) AS relevancy
FROM calls c CROSS JOIN (VALUES ('judge_a', 1), ('judge_b', 4)) AS j(judge, k)
"""

CTES["judge_text"] = """
SELECT call_id, judge,
       CASE WHEN call_id % 5 = 0 THEN body
            WHEN call_id % 5 = 1 THEN '```json ' || body || ' ```'
            WHEN call_id % 5 = 2 THEN '``` ' || body || ' ```'
            WHEN call_id % 5 = 3 THEN 'Here is my score: ' || body || ' Hope this helps.'
            ELSE substring(body, 1, length(body) - 1) || ',}' END AS reply
FROM (SELECT call_id, judge,
             '{"necessity":' || CAST(necessity AS VARCHAR(20)) || ',"name_accuracy":'
             || CAST(name_accuracy AS VARCHAR(20)) || '}' AS body
      FROM judge_scores) b
"""

CTES["seed_outputs"] = """
SELECT * FROM (VALUES ('img_generate', '{"uri":"gs://b/1.png"}'),
                      ('vid_generate', '{"uri":"gs://b/1.mp4"}')) AS s(tool_name, example_output)
"""

CTES["call_io"] = """
SELECT call_id, transcript_id, call_index, tool_name, fault_no,
       'gs://b/' || CAST(transcript_id AS VARCHAR(20)) || '/' || CAST(call_index - CASE WHEN fault_no = 3 AND call_index > 1 THEN 2 ELSE 0 END AS VARCHAR(20)) || '.png' AS produced_uri,
       CASE WHEN fault_no = 7 THEN 'gs://b/none.png'
            WHEN fault_no = 9 THEN 'gs://b/' || CAST(transcript_id AS VARCHAR(20)) || '/' || CAST(call_index + 1 AS VARCHAR(20)) || '.png'
            WHEN call_index > 0 THEN 'gs://b/' || CAST(transcript_id AS VARCHAR(20)) || '/' || CAST(call_index - 1 AS VARCHAR(20)) || '.png'
       END AS consumed_uri,
       CASE WHEN fault_no = 2 THEN '21:9' ELSE '16:9' END AS aspect_ratio
FROM calls
"""

CTES["call_links"] = """
SELECT c.*, p.call_index AS producer_index, p.tool_name AS producer_tool_name, p.aspect_ratio AS producer_aspect_ratio
FROM call_io c
LEFT JOIN (SELECT r.call_id, max(w.call_index) AS last_index FROM call_io r
  JOIN call_io w ON w.transcript_id = r.transcript_id AND w.produced_uri = r.consumed_uri AND w.call_index < r.call_index GROUP BY r.call_id) m
  ON m.call_id = c.call_id
LEFT JOIN call_io p ON p.transcript_id = c.transcript_id AND p.call_index = m.last_index
"""

CTES["tool_needs"] = """
SELECT * FROM (VALUES ('av_combine', 'vid_generate'), ('av_combine', 'music_generate'),
                      ('vid_from_image', 'img_generate')) AS n(tool_name, needs_tool)
"""

CTES["expected_steps"] = """
SELECT transcript_id, call_index AS step_index,
       CASE WHEN tool_name = 'media_unknown' THEN 'img_generate' ELSE tool_name END AS tool_name
FROM calls WHERE fault_no <> 19
UNION ALL
SELECT transcript_id, CAST(max(call_index) + 1 AS INT) AS step_index, 'av_combine' AS tool_name
FROM calls WHERE transcript_id % 5 = 0 GROUP BY transcript_id
"""

# One row per argument of a call to a known tool.
CTES["args"] = """
SELECT c.call_id, c.transcript_id, c.tool_name, j.key AS arg_name, j.type AS jtype,
       CAST(j.value AS VARCHAR) AS jvalue, json_extract_string(c.arguments, '$."' || j.key || '"') AS arg_text
FROM calls c, json_each(CAST(c.arguments AS JSON)) j
"""

CTES["servers"] = "SELECT DISTINCT server, tool_name FROM tool_params"

CTES["call_models"] = """
SELECT c.call_id, c.transcript_id, c.tool_name, s.server, json_extract_string(c.arguments, '$.model') AS model
FROM calls c JOIN servers s ON s.tool_name = c.tool_name
"""

CTES["v_unknown_tool"] = """
SELECT call_id, transcript_id, tool_name, CAST(NULL AS VARCHAR) AS parameter_name, 'unknown_tool' AS rule_id,
       'ERROR' AS severity, 0 AS phase
FROM calls WHERE tool_name NOT IN (SELECT tool_name FROM servers)
"""
CTES["v_missing_required"] = """
SELECT c.call_id, c.transcript_id, c.tool_name, p.param_name AS parameter_name, 'missing_required' AS rule_id,
       'ERROR' AS severity, 1 AS phase
FROM calls c JOIN tool_params p ON p.tool_name = c.tool_name AND p.required
LEFT JOIN args a ON a.call_id = c.call_id AND a.arg_name = p.param_name
WHERE a.arg_name IS NULL OR a.jtype = 'NULL' OR a.jvalue = '""'
"""
CTES["v_unknown_param"] = """
SELECT a.call_id, a.transcript_id, a.tool_name, a.arg_name AS parameter_name, 'unknown_param' AS rule_id,
       'ERROR' AS severity, 2 AS phase
FROM args a JOIN servers s ON s.tool_name = a.tool_name
WHERE NOT EXISTS (SELECT 1 FROM tool_params p WHERE p.tool_name = a.tool_name AND p.param_name = a.arg_name)
"""
CTES["v_type_mismatch"] = """
SELECT a.call_id, a.transcript_id, a.tool_name, a.arg_name AS parameter_name, 'type_mismatch' AS rule_id,
       'ERROR' AS severity, 3 AS phase
FROM args a JOIN tool_params p ON p.tool_name = a.tool_name AND p.param_name = a.arg_name
WHERE (p.param_type = 'string' AND a.jtype <> 'VARCHAR')
   OR (p.param_type IN ('integer', 'number') AND a.jtype NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))
   OR (p.param_type = 'boolean' AND a.jtype <> 'BOOLEAN')
   OR (p.param_type = 'array' AND a.jtype <> 'ARRAY')
   OR (p.param_type = 'object' AND a.jtype <> 'OBJECT')
"""
CTES["v_illegal_enum"] = """
SELECT a.call_id, a.transcript_id, a.tool_name, a.arg_name AS parameter_name, 'illegal_enum' AS rule_id,
       'ERROR' AS severity, 4 AS phase
FROM args a JOIN tool_params p ON p.tool_name = a.tool_name AND p.param_name = a.arg_name
WHERE p.enum_values IS NOT NULL AND NOT list_contains(string_split(p.enum_values, '|'), a.arg_text)
"""
CTES["v_invalid_uri"] = """
SELECT call_id, transcript_id, tool_name, arg_name AS parameter_name, 'invalid_uri' AS rule_id,
       'ERROR' AS severity, 5 AS phase
FROM args WHERE arg_name = 'image_uri' AND tool_name IN (SELECT tool_name FROM servers) AND jtype = 'VARCHAR'
  AND NOT (arg_text LIKE 'gs://%' OR arg_text LIKE '/%' OR arg_text LIKE 'file://%' OR arg_text LIKE 's3://%'
           OR arg_text LIKE 'http://%' OR arg_text LIKE 'https://%')
"""
CTES["v_unknown_model"] = """
SELECT call_id, transcript_id, tool_name, 'model' AS parameter_name, 'unknown_model' AS rule_id,
       'ERROR' AS severity, 6 AS phase
FROM call_models m
WHERE model <> '' AND NOT EXISTS (SELECT 1 FROM capabilities k WHERE k.server = m.server AND k.model = m.model)
"""
CTES["v_cap_flag"] = """
SELECT a.call_id, a.transcript_id, a.tool_name, a.arg_name AS parameter_name, 'capability_violation' AS rule_id,
       'CAPABILITY_VIOLATION' AS severity, 6 AS phase
FROM args a JOIN call_models m ON m.call_id = a.call_id
JOIN capabilities k ON k.server = m.server AND k.model = m.model
WHERE a.arg_name = 'generate_audio' AND a.jvalue = 'true' AND NOT k.audio
"""
CTES["v_cap_set"] = """
SELECT a.call_id, a.transcript_id, a.tool_name, a.arg_name AS parameter_name, 'capability_violation' AS rule_id,
       'CAPABILITY_VIOLATION' AS severity, 6 AS phase
FROM args a JOIN call_models m ON m.call_id = a.call_id
JOIN capabilities k ON k.server = m.server AND k.model = m.model
WHERE a.arg_name = 'aspect_ratio' AND a.arg_text <> '' AND NOT list_contains(string_split(k.ratios, '|'), a.arg_text)
"""
CTES["v_min_value"] = """
SELECT a.call_id, a.transcript_id, a.tool_name, a.arg_name AS parameter_name, 'invalid_value' AS rule_id,
       'ERROR' AS severity, 6 AS phase
FROM args a JOIN servers s ON s.tool_name = a.tool_name
WHERE a.arg_name = 'sample_count' AND a.jtype IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(a.jvalue AS DOUBLE) < 1
"""
CTES["violations"] = """
SELECT * FROM v_unknown_tool UNION ALL SELECT * FROM v_missing_required UNION ALL SELECT * FROM v_unknown_param
UNION ALL SELECT * FROM v_type_mismatch UNION ALL SELECT * FROM v_illegal_enum UNION ALL SELECT * FROM v_invalid_uri
UNION ALL SELECT * FROM v_unknown_model UNION ALL SELECT * FROM v_cap_flag UNION ALL SELECT * FROM v_cap_set
UNION ALL SELECT * FROM v_min_value
"""
CTES["lint_by_transcript"] = """
SELECT c.transcript_id, c.total_calls, CAST(coalesce(v.n, 0) AS BIGINT) AS total_violations,
       coalesce(v.n, 0) = 0 AS is_valid
FROM (SELECT transcript_id, count(*) AS total_calls FROM calls GROUP BY transcript_id) c
LEFT JOIN (SELECT transcript_id, count(*) AS n FROM violations GROUP BY transcript_id) v USING (transcript_id)
"""
