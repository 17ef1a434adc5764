"""Rule names, thresholds, word lists and formats of the evaluation contract."""

# Severities.
ERROR = "ERROR"
CAPABILITY = "CAPABILITY_VIOLATION"

# Lint rules that mean a wrong or missing argument name.
NAME_RULES = ("missing_required", "unknown_param", "malformed_call")

# Lint rules that mean a wrong argument value.
VALUE_RULES = (
    "capability_violation",
    "illegal_enum",
    "type_mismatch",
    "invalid_uri",
    "invalid_value",
    "unknown_model",
)

# Words in a judge's failure text that mean the same two things.
NAME_WORDS = ("name", "missing", "unknown_param")
VALUE_WORDS = ("value", "capab", "enum")

# The prefixes that make a URI absolute.
URI_PREFIXES = ("gs://", "/", "file://", "s3://", "http://", "https://")

# The documented bucket URI form.
BUCKET_URI = r"^gs://[a-z0-9][-_.a-z0-9]*/.+"

# Pass marks and gates.
PASS_TOOL_CALLING = 0.85
PASS_COHERENCE = 0.80
FALSE_PASS = 0.900
SUITE_MEAN = 0.950
COLLAPSED_ARGUMENTS = 0.333
MAX_DROP = 0.050
JUDGE_FLOOR = 0.900
AGREEMENT_ALERT = 0.80
GAP_STRONG = 0.15
GAP_WEAK = 0.05
LOW_SUBSCORE = 0.8

# Indicators with their target and alert mark; a "least" indicator alerts below its mark, a "most" one above it.
INDICATORS = (
    ("false_pass_rate", "most", 0.0, 0.0),
    ("discrimination_gap", "least", 0.200, 0.180),
    ("lint_coverage", "least", 1.0, 1.0),
    ("grounding_ratio", "least", 0.80, 0.75),
    ("judge_correlation", "least", 0.85, 0.80),
)

# Aliases agents make up, and the key that was meant.
PARAM_ALIASES = (
    ("ratio", "aspect_ratio"),
    ("aspectRatio", "aspect_ratio"),
    ("dimensions", "aspect_ratio"),
    ("image_url", "image_uri"),
    ("input_image", "image_uri"),
    ("source_image", "image_uri"),
    ("gcs_bucket", "bucket"),
    ("gcs_bucket_uri", "bucket"),
    ("output_bucket", "bucket"),
    ("image_uris", "images"),
    ("input_images", "images"),
    ("image", "images"),
    ("modelId", "model_id"),
    ("engine", "model_id"),
    ("output_gcs_bucket", "bucket"),
)

# The 26 named coherence defects in their five groups.
MANIFESTATIONS = {
    "logical_flow": ("topic_shift", "non_sequitur", "poor_transitions", "breaks_causality", "temporal_confusion"),
    "completeness": (
        "cuts_off",
        "partial_answer",
        "too_shallow",
        "ignores_constraints",
        "missing_key_info",
        "no_actionable_advice",
    ),
    "conciseness": (
        "repeats_directly",
        "rephrases_same_point",
        "too_much_fluff",
        "over_explains",
        "excessive_caution",
    ),
    "topic_relevance": (
        "complete_topic_shift",
        "misses_main_point",
        "too_generic",
        "hallucination",
        "wrong_question",
    ),
    "context_retention": (
        "asks_again",
        "forgets_preferences",
        "pronoun_confusion",
        "contradicts_self",
        "loses_thread",
        "ignores_corrections",
    ),
}
