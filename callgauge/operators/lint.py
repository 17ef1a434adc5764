"""The lint plan: every rule on one pass over the calls.

A call's argument text is parsed once. The Variant is exploded to one row per
argument; each row meets its parameter row and its model row (broadcast), and the
rules are flags on that row. Findings about the whole call (unknown tool, absent
required arguments, ...) sit on the call's head row: its first argument row, or
the single empty row of a call without arguments. Nothing is shuffled before the
caller's own aggregation, and only rows with a finding build messages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge import fixed
from callgauge.functions.variants import NUMBER, comparable, key_path, kind, kind_of_json, kinds_of_type, python_type, quoted_list
from callgauge.operators.dims import is_small, join_spec

RULE_COLUMNS = (
    "tool_pattern string, param_name string, check string, capability string, min_value double, "
    "max_value double, allowed array<string>, rule_id string, severity string, phrase string"
)

# Checks a capability rule may ask for.
#   known_model  the value must be a model of the server's matrix
#   flag         the value is true, so the model must have the flag
#   tool_flag    the tool itself needs the model to have the flag
#   model_set    the value must be in the model's list
#   model_max    the value may not exceed the model's number
#   range        the value must lie in [min_value, max_value]; either may be open
#   fixed_set    the value must be in ``allowed``

# Texts of values that count as not given.
FALSY = "('', '0', 'false', '[]', '{}')"


@dataclass(frozen=True)
class Spec:
    """Specification tables of one registry.

    tools: server, tool_name, description
    params: server, tool_name, param_pos, param_name, param_type, required,
        enum array<string> (JSON texts), is_uri boolean, and where the schema has
        bounds, minimum and maximum (double)
    capabilities: server, model, capability, value (JSON text)
    rules: see RULE_COLUMNS
    """

    tools: DataFrame
    params: DataFrame
    capabilities: DataFrame
    rules: DataFrame
    bounded: bool | None = None

    def checked(self) -> Spec:
        """Decide once, by counting, whether the registry may be broadcast.

        A small one is kept in one partition, so that its own joins and groupings
        need no shuffle.
        """
        small = self.bounded
        if small is None:
            small = all(is_small(table) for table in (self.params, self.capabilities, self.tools, self.rules)) and is_small(self._attached())
        if not small:
            return Spec(self.tools, self.params, self.capabilities, self.rules, False)
        # Each is at most BROADCAST_ROWS rows, so one partition is enough for it.
        one = (self.tools, self.params, self.capabilities, self.rules)
        return Spec(*[table.coalesce(1) for table in one], bounded=True)

    def _attached(self) -> DataFrame:
        """Parameters times the rules on their name: what the broadcast of ``param_dim`` grows with."""
        return self.params.select("param_name").join(self.rules.select("param_name"), "param_name")


def tool_dim(spec: Spec) -> DataFrame:
    """One row per (server, tool): its parameter names, its required ones and its model parameter."""
    own = ["server", "tool_name"]
    listed = spec.params.groupBy(*own).agg(
        F.expr("sort_array(collect_list(struct(param_pos, param_name, required)))").alias("ps")
    )
    model_param = (
        spec.params.select(*own, "param_name")
        .join(spec.rules.where("check = 'known_model'").select("tool_pattern", "param_name"), "param_name")
        .where("tool_name rlike concat('^(', tool_pattern, ')$')")
        .groupBy(*own)
        .agg(F.min("param_name").alias("model_param"))
    )
    return (
        spec.tools.dropDuplicates(own)
        .join(listed, own, "left")
        .join(model_param, own, "left")
        .selectExpr(
            "tool_name",
            "server AS spec_server",
            "transform(coalesce(ps, array()), p -> p.param_name) AS spec_params",
            "transform(filter(coalesce(ps, array()), p -> p.required),"
            " p -> p.param_name) AS spec_required",
            "model_param",
            "true AS known_tool",
        )
    )


def only_by_name(tools: DataFrame) -> DataFrame:
    """One row per tool name, for calls that do not say their server: of servers with a tool of one name, the last wins."""
    return tools.groupBy("tool_name").agg(F.max_by(F.struct(*[c for c in tools.columns if c != "tool_name"]), "spec_server").alias("_t")).select("tool_name", "_t.*")


def param_dim(spec: Spec) -> DataFrame:
    """One row per (server, tool, parameter, capability rule); ``rule_no`` 0 is there for every parameter."""
    own = ["server", "tool_name", "param_name"]
    attached = (
        spec.params.select(*own)
        .join(spec.rules, "param_name")
        .where("tool_name rlike concat('^(', tool_pattern, ')$')")
        .groupBy(*own)
        .agg(
            F.expr(
                "collect_list(struct(check, capability, min_value, max_value, allowed, rule_id, severity, phrase))"
            ).alias("rules")
        )
    )
    ptype = "lower(coalesce(nullif(param_type, ''), 'string'))"
    rules = "rules"
    if "minimum" in spec.params.columns:
        # Bounds of the schema are one more rule of their own parameter.
        rules = (
            "concat(coalesce(rules, array()), CASE WHEN minimum IS NOT NULL OR maximum IS NOT NULL THEN array(struct('range' AS check,"
            " CAST(NULL AS STRING) AS capability, minimum AS min_value, maximum AS max_value, CAST(NULL AS array<string>) AS allowed,"
            f" 'invalid_value' AS rule_id, '{fixed.ERROR}' AS severity, 'is out of range' AS phrase)) ELSE array() END)"
        )
    return (
        spec.params.dropDuplicates(own)
        .join(attached, own, "left")
        .selectExpr(
            "server AS spec_server",
            "tool_name",
            "param_name AS arg_name",
            f"{ptype} AS param_type",
            f"{kinds_of_type(ptype)} AS param_kinds",
            "required AS param_required",
            f"CASE WHEN size(enum) > 0 THEN transform(enum, e -> {comparable('parse_json(e)', kind('parse_json(e)'))}) END AS enum_values",
            "transform(enum, e -> CAST(parse_json(e) AS STRING)) AS enum_shown",
            "is_uri AS param_is_uri",
            f"posexplode_outer({rules}) AS (rule_no, rule)",
        )
        .withColumn("rule_no", F.expr("coalesce(rule_no, 0)"))
    )


def model_dim(spec: Spec) -> DataFrame:
    """One row per (server, model): capability name to its text and its list.

    A matrix may hold a list as text cut from source code; its ratio items count.
    """
    items = r"coalesce(from_json(value, 'array<string>'), regexp_extract_all(value, '(\\d+:\\d+)', 1))"
    return spec.capabilities.groupBy(F.col("server").alias("spec_server"), F.col("model").alias("model_name")).agg(
        F.expr(
            "map_from_entries(collect_list(struct(capability,"
            f""" struct(trim(both '"' FROM value) AS text, {items} AS items))))"""
        ).alias("caps")
    )


# Names of model parameters that are read with a constant path, which Spark parses once.
MODEL_PARAMS = ("model", "model_id")


def _as_text(value: str) -> str:
    """Strings are read directly, the rest as JSON text."""
    return f"CASE {kind(value)} WHEN 'STR' THEN CAST({value} AS STRING) WHEN 'VOI' THEN NULL ELSE to_json({value}) END"


def _model_value() -> str:
    """The model argument of the call, NULL without one."""
    at = "try_variant_get(_args, {0}, 'variant')"
    known = " ".join(f"WHEN '{name}' THEN " + at.format(f"'$.{name}'") for name in MODEL_PARAMS)
    return f"CASE model_param {known} ELSE {at.format(key_path('model_param'))} END"


def argument_frame(calls: DataFrame, spec: Spec) -> DataFrame:
    """One row per argument (and capability rule) with its tool, parameter and model rows.

    A call without arguments keeps one empty row. What concerns the whole call
    (its model, its absent required parameters) is worked out before the explode,
    so that the parsed arguments are not copied to every row.
    """
    spec = spec.checked()
    if "is_object" not in calls.columns:
        calls = calls.withColumn("is_object", F.lit(True))
    # A call that names its server is judged by that server's tool, any other by the one tool of its name.
    if "server" in calls.columns:
        tools, on = tool_dim(spec).withColumn("server", F.col("spec_server")), ["tool_name", "server"]
    else:
        tools, on = only_by_name(tool_dim(spec)), ["tool_name"]
    frame = join_spec(calls, tools, on, "left", small=spec.bounded, spread="call_id")
    frame = frame.selectExpr("*", "try_parse_json(coalesce(arguments, '{}')) AS _args")
    # The kind of a whole object needs no look at its fields; the full type is worked out for the others alone.
    frame = frame.selectExpr(
        "*",
        "CASE WHEN startswith(ltrim(' \t\n\r', coalesce(arguments, '{}')), '{') AND _args IS NOT NULL THEN 'OBJECT' ELSE schema_of_variant(_args) END AS _full",
    )
    kept = [c for c in frame.columns if c not in ("_args", "_full", "arguments", "spec_required", "model_param")]
    frame = frame.selectExpr(
        *kept,
        "left(_full, 3) AS args_kind",
        "CASE WHEN _full NOT LIKE 'OBJECT%' THEN _full END AS args_type",
        "CASE WHEN _full LIKE 'OBJECT%' THEN _args END AS _args",
        "CASE WHEN _full LIKE 'OBJECT%' AND size(spec_required) > 0"
        f" THEN filter(spec_required, p -> try_variant_get(_args, {key_path('p')}, 'variant') IS NULL) END AS absent",
        f"{_model_value()} AS _model",
    )
    frame = frame.withColumn("_text", F.expr(_as_text("_model")))
    # None, "", 0 and false mean that no model is given.
    frame = frame.selectExpr(
        *kept,
        "CASE WHEN NOT is_object THEN 'not_object' WHEN coalesce(tool_name, '') = '' THEN 'no_name'"
        " WHEN known_tool IS NULL THEN 'unknown_tool' WHEN args_kind IS NULL THEN 'not_json'"
        " WHEN args_kind <> 'OBJ' THEN 'not_dict' ELSE 'open' END AS call_state",
        "args_type",
        # Only an open call is judged by its absent parameters.
        "CASE WHEN known_tool AND is_object AND size(absent) > 0 THEN absent END AS absent",
        "_args",
        f"CASE WHEN _text NOT IN {FALSY} THEN _text END AS model_name",
    )
    frame = join_spec(
        frame, model_dim(spec), ["spec_server", "model_name"], "left", small=spec.bounded, spread="call_id"
    )
    explode = calls.sparkSession.tvf.variant_explode_outer(F.col("_args").outer()).selectExpr(
        "coalesce(pos, 0) AS arg_pos", "key AS arg_name", "value AS arg"
    )
    frame = frame.lateralJoin(explode).drop("_args")
    return join_spec(frame, param_dim(spec), ["spec_server", "tool_name", "arg_name"], "left", small=spec.bounded, spread="call_id")


# One flag per rule. ``head`` marks one row per call, ``base`` one row per argument.
_FLAGS = {
    "f_call": "head AND NOT is_open",
    "f_empty": "open_arg AND param_required AND (arg_kind = 'VOI' OR arg_text = '')",
    "f_unknown": "base AND is_open AND arg_name IS NOT NULL AND param_type IS NULL",
    "f_type": "open_arg AND NOT array_contains(param_kinds, arg_kind)",
    "f_enum": f"open_arg AND enum_values IS NOT NULL AND NOT array_contains(enum_values, {comparable('arg', 'arg_kind')})",
    "f_uri": "open_arg AND param_is_uri AND arg_kind = 'STR' AND NOT ("
    + " OR ".join(f"startswith(arg_text, '{p}')" for p in fixed.URI_PREFIXES)
    + ")",
    "f_rule": "is_open AND rule IS NOT NULL AND CASE rule.check"
    " WHEN 'known_model' THEN model_name IS NOT NULL AND caps IS NULL"
    " WHEN 'flag' THEN caps IS NOT NULL AND arg_kind = 'BOO' AND arg_text = 'true' AND cap_text <> 'true'"
    " WHEN 'tool_flag' THEN caps IS NOT NULL AND cap_text <> 'true'"
    f" WHEN 'model_set' THEN caps IS NOT NULL AND arg_text NOT IN {FALSY}"
    "  AND NOT array_contains(coalesce(caps[rule.capability].items, array()), arg_text)"
    " WHEN 'model_max' THEN arg_number > try_cast(cap_text AS DOUBLE)"
    " WHEN 'range' THEN arg_number < rule.min_value OR arg_number > rule.max_value"
    f" WHEN 'fixed_set' THEN arg_text NOT IN {FALSY} AND NOT array_contains(rule.allowed, arg_text) END",
}
# Flags that are NULL where a JSON null or an unbounded rule is compared.
_NULLABLE = ("f_empty", "f_type", "f_enum", "f_uri", "f_rule")
_COUNT = " + ".join(f"CAST({flag} AS INT)" for flag in _FLAGS) + " + n_absent"


def flag_frame(calls: DataFrame, spec: Spec) -> DataFrame:
    """Argument rows with one boolean per rule and ``n_found``, the findings on the row.

    ``calls`` has call_id, transcript_id, tool_name, arguments (JSON text) and
    any other columns, which pass through. ``is_object`` may tell that a call was
    no JSON object at all.
    """
    frame = argument_frame(calls, spec)
    frame = frame.selectExpr(
        "*",
        f"{kind_of_json('to_json(arg)')} AS arg_kind",
        "coalesce(rule_no, 0) = 0 AS base",
        "call_state = 'open' AS is_open",
    )
    frame = frame.selectExpr(
        "*",
        # Text of strings, and of anything a capability rule looks at; a cast of a
        # Variant number is slow, its JSON text is not.
        "CASE WHEN arg_kind = 'STR' THEN CAST(arg AS STRING) WHEN arg_kind = 'VOI' THEN NULL"
        " WHEN rule IS NOT NULL THEN to_json(arg) END AS arg_text",
        "base AND arg_pos = 0 AS head",
        "base AND is_open AND param_type IS NOT NULL AS open_arg",
        "coalesce(lower(caps[rule.capability].text), '') AS cap_text",
    )
    frame = frame.selectExpr(
        "*", f"CASE WHEN rule IS NOT NULL AND arg_kind IN {NUMBER} THEN try_cast(arg_text AS DOUBLE) END AS arg_number"
    )
    frame = frame.selectExpr(
        "*",
        *[f"coalesce({condition}, false) AS {flag}" if flag in _NULLABLE else f"{condition} AS {flag}" for flag, condition in _FLAGS.items()],
        "CASE WHEN head AND absent IS NOT NULL THEN size(absent) ELSE 0 END AS n_absent",
    )
    return frame.selectExpr("*", f"{_COUNT} AS n_found")


_MISSING = "concat(\"Required parameter '\", {0}, \"' is missing or empty\")"
_CALL_RULE = "CASE call_state WHEN 'unknown_tool' THEN 'unknown_tool' WHEN 'not_dict' THEN 'type_mismatch' ELSE 'malformed_call' END"
_CALL_TEXT = (
    "CASE call_state WHEN 'not_object' THEN 'Tool call must be a JSON object'"
    " WHEN 'no_name' THEN \"Tool call has no valid 'function_name' string\""
    " WHEN 'unknown_tool' THEN concat(\"Tool '\", tool_name, \"' is not in the registry\")"
    " WHEN 'not_json' THEN 'Tool arguments are not valid JSON'"
    f" ELSE concat('Tool arguments must be a dict, got ', {python_type('args_type')}) END"
)
_RULE_TEXT = (
    "concat_ws(' ', arg_name, concat(\"'\", coalesce(arg_text, to_json(arg)), \"'\"), rule.phrase,"
    " CASE WHEN rule.check IN ('flag', 'model_set', 'model_max') THEN concat(\"on '\", model_name, \"'\") END)"
)
# For each flag the rule id and the message of its finding; the place in this list is the finding's phase.
_FINDINGS = {
    "f_call": (_CALL_RULE, _CALL_TEXT),
    "f_empty": ("'missing_required'", _MISSING.format("arg_name")),
    "f_unknown": ("'unknown_param'", f"concat(\"The tool has no parameter '\", arg_name, \"'; it takes \", {quoted_list('spec_params')})"),
    "f_type": ("'type_mismatch'", f"concat(\"'\", arg_name, \"' should be \", param_type, ' but is ', {python_type('schema_of_variant(arg)')})"),
    "f_enum": ("'illegal_enum'", f"concat(\"'\", coalesce(arg_text, to_json(arg)), \"' is none of the values \", {quoted_list('enum_shown')})"),
    "f_uri": ("'invalid_uri'", "concat(\"'\", arg_text, \"' is neither a full path nor a bucket or web address\")"),
    "f_rule": ("rule.rule_id", _RULE_TEXT),
}
_CODES = {flag: code for code, flag in enumerate(_FINDINGS)}
_ABSENT = len(_FINDINGS)
_FOUND = (
    f"CASE WHEN {' OR '.join(_FLAGS)} OR n_absent > 0 THEN concat(array("
    + ", ".join(f"CASE WHEN {flag} THEN struct({code} AS _code, CAST(NULL AS STRING) AS _absent) END" for flag, code in _CODES.items())
    + f"), CASE WHEN n_absent > 0 THEN transform(absent, a -> struct({_ABSENT} AS _code, a AS _absent)) ELSE array() END) END"
)


def violations(calls: DataFrame, spec: Spec) -> DataFrame:
    """One row per violation, with every column of ``calls`` but the argument text.

    The flags of a row become a list of codes; a finding's texts are put together behind the generator, for findings alone,
    which also keeps the generated methods small.
    """
    kept = [c for c in calls.columns if c not in ("arguments", "is_object")]
    of = lambda values, absent: "CASE _code " + " ".join(f"WHEN {_CODES[f]} THEN {v}" for f, v in values.items()) + f" ELSE {absent} END"
    rules = of({flag: rule for flag, (rule, _) in _FINDINGS.items()}, "'missing_required'")
    texts = of({flag: text for flag, (_, text) in _FINDINGS.items()}, _MISSING.format("_absent"))
    # The outer form with a filter behind it: a filter before it would be pushed below
    # the flags and work every one of them out twice.
    found = flag_frame(calls, spec).selectExpr("*", f"inline_outer({_FOUND})").where("_code IS NOT NULL")
    return found.selectExpr(
        *kept,
        f"{rules} AS rule_id",
        f"CASE _code WHEN {_CODES['f_call']} THEN NULL WHEN {_ABSENT} THEN _absent ELSE arg_name END AS parameter_name",
        f"CASE WHEN _code = {_CODES['f_rule']} THEN rule.severity ELSE '{fixed.ERROR}' END AS severity",
        f"CASE _code WHEN {_ABSENT} THEN {_CODES['f_empty']} ELSE _code END AS phase",
        f"{texts} AS message",
    )


def summary(calls: DataFrame, spec: Spec, transcripts: DataFrame | None = None) -> DataFrame:
    """Per transcript: calls, violations and whether it is valid; one shuffle of partial sums."""
    out = (
        flag_frame(calls, spec)
        .groupBy("transcript_id")
        .agg(F.expr("count_if(head)").alias("total_calls"), F.expr("sum(n_found)").alias("total_violations"))
    )
    if transcripts is not None:
        # A transcript without calls is valid.
        out = transcripts.select("transcript_id").distinct().join(out, "transcript_id", "left").fillna(0)
    return out.withColumn("is_valid", F.expr("total_violations = 0"))


_named = lambda rules: "(f_rule AND rule.rule_id IN (" + ", ".join(f"'{r}'" for r in rules) + "))"
_NAME_FAULT = _named(fixed.NAME_RULES) + " OR f_empty OR f_unknown OR n_absent > 0 OR (f_call AND call_state IN ('not_object', 'no_name', 'not_json'))"
_VALUE_FAULT = _named(fixed.VALUE_RULES) + " OR f_type OR f_enum OR f_uri OR (f_call AND call_state = 'not_dict')"


def call_verdicts(calls: DataFrame, spec: Spec) -> DataFrame:
    """Per call: violations, and the two rule families that collapse a score."""
    return (
        flag_frame(calls, spec)
        .groupBy("call_id")
        .agg(
            F.expr("sum(n_found)").alias("n_violations"),
            F.expr(f"bool_or({_NAME_FAULT})").alias("name_fault"),
            F.expr(f"bool_or({_VALUE_FAULT})").alias("value_fault"),
        )
    )


def empty_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RULE_COLUMNS).coalesce(1)
