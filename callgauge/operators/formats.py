"""Documented lint rules beyond the base set: bucket URIs, item types, alias hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge import fixed
from callgauge.operators.dims import join_spec
from callgauge.operators.lint import Spec, flag_frame
from callgauge.session import literal_table


def bucket_uri_findings(calls: DataFrame, spec: Spec, params: list[str]) -> DataFrame:
    """Bucket URI arguments that do not have the documented form; an empty text is not checked."""
    named = flag_frame(calls, spec).where(F.col("open_arg") & F.col("arg_name").isin(*params))
    bad = named.where((F.col("arg_kind") == "STR") & (F.col("arg_text") != "") & ~F.col("arg_text").rlike(fixed.BUCKET_URI))
    return bad.select("call_id", "transcript_id", "tool_name", F.col("arg_name").alias("parameter_name"), "arg_text")


def item_type_findings(calls: DataFrame, spec: Spec, params: list[str]) -> DataFrame:
    """Array arguments whose items are not all strings."""
    named = flag_frame(calls, spec).where(F.col("open_arg") & F.col("arg_name").isin(*params))
    bad = named.where("arg_kind <> 'ARR' OR (to_json(arg) <> '[]' AND schema_of_variant(arg) <> 'ARRAY<STRING>')")
    return bad.select("call_id", "transcript_id", "tool_name", F.col("arg_name").alias("parameter_name"))


def alias_hints(calls: DataFrame, spec: Spec, aliases: tuple = fixed.PARAM_ALIASES) -> DataFrame:
    """For each unknown argument, the key that was meant: a known alias, else the nearest name."""
    table = literal_table(calls.sparkSession, list(aliases), "arg_name string, alias_of string")
    unknown = flag_frame(calls, spec).where("f_unknown")
    hinted = join_spec(unknown, table, ["arg_name"], "left", small=True)
    nearest = "array_min(transform(spec_params, p -> struct(levenshtein(p, arg_name) AS d, p AS name))).name"
    return hinted.selectExpr(
        "call_id",
        "transcript_id",
        "tool_name",
        "arg_name AS parameter_name",
        f"CASE WHEN array_contains(spec_params, alias_of) THEN alias_of ELSE {nearest} END AS hint",
        "coalesce(array_contains(spec_params, alias_of), false) AS is_alias",
    )


def local_paths(calls: DataFrame, spec: Spec, params: list[str]) -> DataFrame:
    """Local paths given to parameters that only take cloud URIs."""
    named = flag_frame(calls, spec).where(F.col("open_arg") & F.col("arg_name").isin(*params))
    local = "startswith(arg_text, '/') OR startswith(arg_text, 'file://') OR NOT contains(arg_text, '://')"
    bad = named.where(f"arg_kind = 'STR' AND arg_text <> '' AND ({local})")
    return bad.select("call_id", "transcript_id", "tool_name", F.col("arg_name").alias("parameter_name"), "arg_text")
