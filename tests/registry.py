"""A small media registry, typed by hand, for rule-by-rule tests."""

from __future__ import annotations

import json

from callgauge.operators.lint import RULE_COLUMNS, Spec
from callgauge.session import literal_table

TOOLS = {
    "clip_text": ("clip", {"prompt": "string!", "model": "string", "aspect_ratio": "string", "generate_audio": "boolean", "bucket": "string"}),
    "clip_image": ("clip", {"image_uri": "string!", "prompt": "string", "model": "string", "bucket": "string"}),
    "clip_morph": ("clip", {"prompt": "string!", "model": "string"}),
    "pic_make": ("pic", {"prompt": "string!", "model": "string", "aspect_ratio": "string", "image_size": "string", "images": "array", "gcs_bucket_uri": "string"}),
    "song_make": ("song", {"prompt": "string!", "model_id": "string", "sample_count": "integer", "output_gcs_bucket": "string"}),
    "kinds": ("misc", {"text": "string", "level": "integer", "mode": "string", "tags": "array", "meta": "object", "on": "boolean", "odd": "stringish", "size": "number"}),
}
ENUMS = {("kinds", "mode"): ['"a"', '"b"'], ("kinds", "level"): ["1", "2"]}
CAPS = [
    ("clip", "clip-2", "audio", '"false"'), ("clip", "clip-2", "ratios", '"[]string{\\"16:9\\""'), ("clip", "clip-2", "morph", "false"),
    ("clip", "clip-3", "audio", '"true"'), ("clip", "clip-3", "ratios", '["16:9","9:16"]'), ("clip", "clip-3", "morph", "true"),
    ("pic", "pic-1", "sizes", "[]"), ("pic", "pic-1", "ratios", '["1:1","16:9"]'),
    ("pic", "pic-2", "sizes", '["1K","2K"]'), ("pic", "pic-2", "ratios", '["1:1","16:9","1:8"]'),
    ("song", "song-clip", "most", "3"),
]
CAP = ("capability_violation", "CAPABILITY_VIOLATION", "is not supported")
RULES = [
    ("clip_.*|pic_make", "model", "known_model", None, None, None, None, "unknown_model", "ERROR", "is unknown"),
    ("song_make", "model_id", "known_model", None, None, None, None, "unknown_model", "ERROR", "is unknown"),
    ("clip_.*", "generate_audio", "flag", "audio", None, None, None, *CAP),
    ("clip_.*|pic_make", "aspect_ratio", "model_set", "ratios", None, None, None, *CAP),
    ("clip_morph", "model", "tool_flag", "morph", None, None, None, *CAP),
    ("pic_make", "image_size", "model_set", "sizes", None, None, None, *CAP),
    ("song_make", "sample_count", "range", None, 1.0, None, None, "invalid_value", "ERROR", "is below 1"),
    ("song_make", "sample_count", "model_max", "most", None, None, None, "capability_violation", "ERROR", "is above the maximum"),
]


def spec(spark, bounded=True) -> Spec:
    params = []
    for tool, (server, fields) in TOOLS.items():
        for pos, (name, kind) in enumerate(fields.items()):
            required = kind.endswith("!")
            is_uri = name.endswith("_uri") and "bucket" not in name
            params.append((server, tool, pos, name, kind.rstrip("!"), required, ENUMS.get((tool, name)), is_uri))
    columns = "server string, tool_name string, param_pos int, param_name string, param_type string, required boolean, enum array<string>, is_uri boolean"
    return Spec(
        literal_table(spark, [(s, t, "") for t, (s, _) in TOOLS.items()], "server string, tool_name string, description string"),
        literal_table(spark, params, columns),
        literal_table(spark, CAPS, "server string, model string, capability string, value string"),
        literal_table(spark, RULES, RULE_COLUMNS),
        bounded,
    )


def calls(spark, rows):
    """rows: (tool, arguments as dict, JSON text or None)."""
    made = [(i, 1, tool, a if a is None or isinstance(a, str) else json.dumps(a)) for i, (tool, a) in enumerate(rows)]
    return spark.createDataFrame(made, "call_id bigint, transcript_id bigint, tool_name string, arguments string")
