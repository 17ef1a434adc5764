from __future__ import annotations

import json
import random

import pytest

from callgauge.operators import generation as g
from callgauge.operators import lint
from callgauge.sources import sinks, specs, transcripts

SPEC = {"tools": [
    {"name": "draw", "description": "Draws", "inputSchema": {"type": "object", "properties": {
        "prompt": {"type": "string"}, "image_uri": {"type": "string"}, "size": {"type": "integer", "minimum": 1, "maximum": 4},
        "style": {"type": "string", "enum": ["a", "b"]}, "any": {}}, "required": ["prompt"]}},
    "not a tool",
    {"name": "bare", "parameters": {"q": {"type": "string", "required": True}}},
    {"name": "none"},
]}


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "tools_list.json").write_text(json.dumps(SPEC, indent=1))
    (tmp_path / "one" / "tools.json").write_text("[]")
    (tmp_path / "one" / "capabilities.json").write_text(json.dumps({"models": {"m": {"big": True}}}))
    (tmp_path / "two" / "tools.json").write_text(json.dumps([{"name": "sing"}]))
    return str(tmp_path)


def test_registry_folder(spark, root):
    spec = specs.load_spec(spark, root, lint.empty_rules(spark))
    assert {(r.server, r.tool_name) for r in spec.tools.collect()} == {("one", "draw"), ("one", "bare"), ("one", "none"), ("two", "sing")}
    params = {(r.tool_name, r.param_name): r for r in spec.params.collect()}
    assert [params[("draw", n)].param_pos for n in ("prompt", "image_uri", "size", "style", "any")] == [0, 1, 2, 3, 4]
    assert params[("draw", "prompt")].required and params[("bare", "q")].required and not params[("draw", "size")].required
    assert params[("draw", "style")].enum == ['"a"', '"b"'] and params[("draw", "any")].param_type == "string"
    assert params[("draw", "image_uri")].is_uri
    assert [tuple(r) for r in spec.capabilities.collect()] == [("one", "m", "big", "true")]
    calls = spark.createDataFrame([(1, 1, "draw", '{"prompt":"x","size":9}'), (2, 1, "draw", '{"prompt":"x","size":2,"style":"b"}')],
                                  "call_id bigint, transcript_id bigint, tool_name string, arguments string")
    assert [(r.call_id, r.rule_id) for r in lint.violations(calls, spec).collect()] == [(1, "invalid_value")]


def test_missing_root_and_broken_file(spark, root, tmp_path):
    assert specs.read_documents(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "two" / "tools.json").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED"):
        specs.load_spec(spark, root, lint.empty_rules(spark)).tools.collect()


def test_transcript_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"label": "a", "kind": "correct", "calls": [{"name": "x"}, {"name": "y"}]}], indent=1))
    rows = transcripts.load_transcripts(spark, str(tmp_path / "t.json")).orderBy("call_index").collect()
    assert [(r.label, r.kind, r.call_index, r.call) for r in rows] == [("a", "correct", 0, '{"name":"x"}'), ("a", "correct", 1, '{"name":"y"}')]


def test_split_files_equal_whole_ones(spark, tmp_path):
    draw = random.Random(4)
    signs = ["}", "{", "[", "]", '"', "\\", ",", " ", "a", "é", "😀", "\n"]
    text = lambda: "".join(draw.choice(signs) for _ in range(draw.randint(0, 12)))

    def case():
        calls = [{"name": text(), "arguments": {text(): [text(), {"x": {}}]}} for _ in range(draw.randint(0, 3))]
        return draw.choice([{"label": text(), "calls": calls}, {"prompt": text(), "agent_calls": {"name": text()}}, {}])

    odd = lambda: draw.choice([1, "}", "]", None, [], [[{"a": "]"}]], ["}"], True])
    values = [[case() for _ in range(n)] for n in (0, 1, 2, 40)]
    values += [[case() if draw.random() < 0.5 else odd() for _ in range(30)] for _ in range(3)] + [["a}b"], ["a}b}c", 1], [5], case(), {"calls": {"name": "}"}}, {"a": {}, "b": 1}]
    for n, value in enumerate(values):
        (tmp_path / f"{n}.json").write_text(draw.choice(["", " \n"]) + json.dumps(value, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5) + draw.choice(["", "\n", " "]))
    (tmp_path / "blank.json").write_text(" \n")
    whole = spark.read.text(str(tmp_path), wholetext=True).where("trim(value) <> '\n'").selectExpr("_metadata.file_path AS file", "value AS doc")
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    want = order(transcripts.cases_from_json(whole).collect())
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("40b", "333b", usual):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert order(transcripts.load_transcripts(spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert len(want) > 150


@pytest.mark.parametrize("text", ('[{"a": 1}', '[{"a": 1}, {"b', '{"a": "}', "{broken"))
def test_files_cut_off_are_an_error(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED"):
        transcripts.load_transcripts(spark, str(tmp_path)).collect()


def test_generated_calls_are_valid_and_cover_every_tool(spark, root):
    spec = specs.load_spec(spark, root, lint.empty_rules(spark))
    tools = spec.tools.selectExpr("*", "crc32(tool_name) AS tool_pos")
    rows = g.tool_rows(tools, spec.params)
    made, steps = g.scenarios(rows)
    calls = steps.selectExpr("xxhash64(scenario_id, step_index) AS call_id", "1L AS transcript_id", "tool_name", "parameters AS arguments")
    assert lint.violations(calls, spec).count() == 0
    assert g.uncovered(tools, steps).count() == 0
    partial = steps.where("tool_name <> 'draw'")
    filled = partial.unionByName(g.coverage_scenarios(g.uncovered(tools, partial)).select(*g.STEP))
    assert g.uncovered(tools, filled).count() == 0


def test_only_whole_runs_are_published(spark, tmp_path):
    root = str(tmp_path / "harness")
    with pytest.raises(ValueError):
        sinks.published(spark, root)
    one = spark.createDataFrame([(1, "a", [2]), (2, None, [])], "id bigint, text string, list array<int>")
    sinks.publish({"steps": one, "turns": one.where("false")}, root)
    assert sinks.published_counts(spark, root) == {"steps": 2, "turns": 0}
    broken = one.selectExpr("id", "text", "IF(id = 2, array(CAST(raise_error('lost') AS INT)), list) AS list")
    with pytest.raises(Exception, match="lost"):
        sinks.publish({"steps": one.limit(1), "turns": broken}, root)
    assert sinks.published_counts(spark, root) == {"steps": 2, "turns": 0}
    back = sinks.published(spark, root)
    assert sorted(back["steps"].collect()) == sorted(one.collect()) and back["turns"].count() == 0
    assert back["steps"].dtypes == one.dtypes
    held = back["steps"]
    sinks.publish({"steps": one.where("id = 1")}, root, fmt="parquet")
    assert [r.id for r in sinks.published(spark, root)["steps"].collect()] == [1]
    assert held.count() == 2  # who still reads the run before is not disturbed


def test_cuts_inside_a_byte_range_change_nothing(spark, tmp_path, monkeypatch):
    """Strings with braces and quotes, lists and JSON lines, with sums carried over cuts of three pieces."""
    monkeypatch.setattr(transcripts, "CUT_PIECES", 3)
    case = lambda i: '{"label":"L%d","calls":[{"name":"a","x":"{%d}}"},{"name":"b","x":"\\"}]"}]}' % (i, i)
    (tmp_path / "list.json").write_text("[" + ",\n".join(case(i) for i in range(40)) + "]\n")
    (tmp_path / "lines.json").write_text("\n".join(case(i) for i in range(100, 120)))
    got = transcripts.load_transcripts(spark, str(tmp_path)).select("label", "case_index", "call_index").collect()
    want = [(f"L{i}", i % 100, c) for i in [*range(40), *range(100, 120)] for c in (0, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
