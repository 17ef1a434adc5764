from __future__ import annotations

import pytest

from callgauge.operators import formats, gates, lint
from callgauge.sources.transcripts import cases_from_json, normalize_calls
from tests import registry

OK = {"prompt": "p", "model": "clip-3", "aspect_ratio": "9:16", "generate_audio": True}
# (tool, arguments, expected [(rule, parameter)])
CASES = [
    ("clip_text", OK, []),
    ("clip_text", {**OK, "model": "clip-2", "aspect_ratio": "16:9"}, [("capability_violation", "generate_audio")]),
    ("clip_text", {**OK, "aspect_ratio": "21:9"}, [("capability_violation", "aspect_ratio")]),
    ("clip_text", {**OK, "model": "clip-2", "generate_audio": False, "aspect_ratio": "9:16"}, [("capability_violation", "aspect_ratio")]),
    ("clip_text", {**OK, "model": "clip-9"}, [("unknown_model", "model")]),
    ("clip_text", {k: v for k, v in OK.items() if k != "prompt"}, [("missing_required", "prompt")]),
    ("clip_text", {**OK, "prompt": ""}, [("missing_required", "prompt")]),
    ("clip_text", {**OK, "prompt": None}, [("missing_required", "prompt"), ("type_mismatch", "prompt")]),
    ("clip_text", {"prompt": "p", "ratio": "16:9", "gcs_bucket": "b"}, [("unknown_param", "gcs_bucket"), ("unknown_param", "ratio")]),
    ("clip_text", {"prompt": "p", "model": "", "generate_audio": True}, []),
    ("clip_text", {"prompt": "p", "generate_audio": True, "aspect_ratio": "21:9"}, []),
    ("clip_image", {"image_uri": "in.png"}, [("invalid_uri", "image_uri")]),
    ("clip_image", {"image_uri": "/a/b.png"}, []),
    ("clip_image", {"image_uri": 5}, [("type_mismatch", "image_uri")]),
    ("clip_morph", {"prompt": "p", "model": "clip-2"}, [("capability_violation", "model")]),
    ("clip_morph", {"prompt": "p", "model": "clip-3"}, []),
    ("pic_make", {"prompt": "p", "model": "pic-1", "image_size": "4K"}, [("capability_violation", "image_size")]),
    ("pic_make", {"prompt": "p", "model": "pic-1", "aspect_ratio": "1:8"}, [("capability_violation", "aspect_ratio")]),
    ("pic_make", {"prompt": "p", "model": "pic-2", "image_size": "2K", "images": "gs://b/x"}, [("type_mismatch", "images")]),
    ("song_make", {"prompt": "p", "model_id": "song-clip", "sample_count": -5}, [("invalid_value", "sample_count")]),
    ("song_make", {"prompt": "p", "model_id": "song-clip", "sample_count": 5}, [("capability_violation", "sample_count")]),
    ("song_make", {"prompt": "p", "sample_count": 0.5}, [("invalid_value", "sample_count")]),
    ("song_make", {"prompt": "p", "sample_count": True}, [("type_mismatch", "sample_count")]),
    ("song_make", {"prompt": "p", "model": "song-clip"}, [("unknown_param", "model")]),
    ("song_make", {"prompt": "p", "model_id": ["x"]}, [("type_mismatch", "model_id"), ("unknown_model", "model_id")]),
    ("kinds", {"text": "t", "level": 1, "mode": "a", "tags": [1, "x"], "meta": {"z": 1}, "on": False, "odd": 7, "size": 1.5}, []),
    ("kinds", {"level": 1.0}, []),
    ("kinds", {"level": 3}, [("illegal_enum", "level")]),
    ("kinds", {"level": True}, [("type_mismatch", "level")]),
    ("kinds", {"mode": ["a"]}, [("illegal_enum", "mode"), ("type_mismatch", "mode")]),
    ("kinds", {"tags": {}, "meta": [], "on": "true", "size": "1"}, [("type_mismatch", "meta"), ("type_mismatch", "on"), ("type_mismatch", "size"), ("type_mismatch", "tags")]),
    ("kinds", {"a.b c": 1}, [("unknown_param", "a.b c")]),
    ("kinds", None, []),
    ("kinds", "{}", []),
    ("clip_text", "{}", [("missing_required", "prompt")]),
    ("clip_text", None, [("missing_required", "prompt")]),
    ("clip_text", "[1]", [("type_mismatch", None)]),
    ("clip_text", "null", [("type_mismatch", None)]),
    ("clip_text", "{bad", [("malformed_call", None)]),
    ("clip_text", '{"prompt":"a","prompt":""}', [("missing_required", "prompt")]),
    ("nobody", OK, [("unknown_tool", None)]),
    ("", OK, [("malformed_call", None)]),
    (None, OK, [("malformed_call", None)]),
]


@pytest.fixture(scope="module")
def found(spark):
    calls = registry.calls(spark, [(t, a) for t, a, _ in CASES])
    out: dict[int, list] = {i: [] for i in range(len(CASES))}
    for row in lint.violations(calls, registry.spec(spark)).collect():
        out[row.call_id].append((row.rule_id, row.parameter_name))
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{i}-{c[0]}" for i, c in enumerate(CASES)])
def test_rule(found, i):
    assert sorted(found[i], key=str) == sorted(CASES[i][2], key=str)


def test_large_registry_gives_the_same(spark, found):
    """The salted joins of a registry that may not be broadcast."""
    calls = registry.calls(spark, [(t, a) for t, a, _ in CASES])
    rows = lint.violations(calls, registry.spec(spark, bounded=False)).collect()
    assert sorted((r.call_id, r.rule_id, str(r.parameter_name)) for r in rows) == sorted(
        (i, rule, str(p)) for i, made in found.items() for rule, p in made
    )


def test_size_is_counted(spark):
    assert registry.spec(spark, bounded=None).checked().bounded is True


def test_summary_keeps_transcripts_without_calls(spark):
    calls = registry.calls(spark, [("clip_text", OK), ("nobody", OK)])
    transcripts = spark.createDataFrame([(1,), (2,)], "transcript_id bigint")
    rows = {r.transcript_id: r for r in lint.summary(calls, registry.spec(spark), transcripts).collect()}
    assert (rows[1].total_calls, rows[1].total_violations, rows[1].is_valid) == (2, 1, False)
    assert (rows[2].total_calls, rows[2].total_violations, rows[2].is_valid) == (0, 0, True)


def test_assert_valid(spark):
    gates.assert_valid(registry.calls(spark, [("clip_text", OK)]), registry.spec(spark))
    with pytest.raises(AssertionError, match="unknown_tool"):
        gates.assert_valid(registry.calls(spark, [("nobody", OK)]), registry.spec(spark))


def test_alias_hint(spark):
    calls = registry.calls(spark, [("clip_text", {"prompt": "p", "ratio": 1, "modle": 2})])
    hints = {r.parameter_name: (r.hint, r.is_alias) for r in formats.alias_hints(calls, registry.spec(spark)).collect()}
    assert hints == {"ratio": ("aspect_ratio", True), "modle": ("model", False)}


def test_lone_call_and_lone_case(spark):
    docs = spark.createDataFrame([(1, '{"calls": {"name": "x"}}'), (2, '[{"agent_calls": [{"name": "y"}, 5]}]')], "id bigint, doc string")
    rows = sorted((r.id, r.label, r.call_index, r.call) for r in cases_from_json(docs).collect())
    assert rows == [(1, "Case-1", 0, '{"name":"x"}'), (2, "Case-1", 0, '{"name":"y"}'), (2, "Case-1", 1, "5")]


def test_call_aliases(spark):
    raw = spark.createDataFrame([(1, '{"function_name": null, "name": "n"}'), (2, '{"name": "n", "parameters": {"a": 1}}'), (3, "7")], "call_id bigint, call string")
    rows = {r.call_id: r for r in normalize_calls(raw).collect()}
    assert rows[1].tool_name is None and rows[1].call_name == "n"
    assert rows[2].tool_name == "n" and rows[2].arguments == '{"a":1}'
    assert rows[3].is_object is False


def test_tools_of_one_name(spark):
    columns = "server string, tool_name string, param_pos int, param_name string, param_type string, required boolean, enum array<string>, is_uri boolean"
    tools = spark.createDataFrame([("a", "search", ""), ("b", "search", "")], "server string, tool_name string, description string")
    params = spark.createDataFrame([("a", "search", 0, "query", "string", True, None, False), ("b", "search", 0, "text", "string", True, None, False)], columns)
    plain = registry.spec(spark)
    spec = lint.Spec(tools, params, plain.capabilities, plain.rules, bounded=True)
    calls = registry.calls(spark, [("search", {"text": "x"}), ("search", {"query": "x"})])
    row = lint.summary(calls, spec).collect()
    # Without a server the last one's tool counts, and each call is judged once.
    assert [(r.total_calls, r.total_violations) for r in row] == [(2, 2)]
    named = calls.selectExpr("*", "CASE call_id WHEN 0 THEN 'b' ELSE 'a' END AS server")
    assert [(r.total_calls, r.total_violations) for r in lint.summary(named, spec).collect()] == [(2, 0)]
