"""Model replies: text out of provider payloads, JSON out of text, token counts, ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.functions.variants import kind
from callgauge.operators import patterns
from callgauge.session import ship_code

# What counts as a fence and as a trailing comma in a reply.
_BLANKS = r"' \t\r\n'"
_FENCE = r"'(?s)```(?:json)?\\s*(.*?)\\s*```'"
_COMMA = r"',\\s*([\\]}])', '$1'"


def with_json(rows: DataFrame, text: str, out: str = "payload") -> DataFrame:
    """Add ``out``: the JSON object found in free text, as a Variant; NULL when there is none.

    Tried in turn: the first code fence or the whole text, the outermost braces,
    the same without trailing commas, the outermost brackets, the same again. A
    list becomes {"items": ..}, a number or boolean {"data": ..}.
    """
    trimmed = f"trim(BOTH {_BLANKS} FROM {text})"
    cleaned = (
        f"CASE WHEN {text} RLIKE {_FENCE} THEN trim(BOTH {_BLANKS} FROM regexp_extract({text}, {_FENCE}, 1))"
        f" WHEN contains({text}, '```') THEN trim(BOTH {_BLANKS} FROM replace(replace({text}, '```json', ''), '```', ''))"
        f" ELSE {trimmed} END"
    )
    kept = rows.columns

    def outer(left: str, right: str) -> str:
        end = f"length(_c) - locate('{right}', reverse(_c)) + 1"
        there = f"locate('{left}', _c) > 0 AND locate('{right}', _c) > 0 AND {end} > locate('{left}', _c)"
        return f"CASE WHEN {there} THEN substring(_c, locate('{left}', _c), {end} - locate('{left}', _c) + 1) END"

    wrap = lambda v, key: f"parse_json(concat('{{\"{key}\":', to_json({v}), '}}'))"
    frame = rows.selectExpr("*", f"{cleaned} AS _c").selectExpr("*", "try_parse_json(_c) AS _whole")
    frame = frame.selectExpr("*", f"{kind('_whole')} AS _k")
    direct = "coalesce(_k IN ('OBJ', 'ARR', 'BIG', 'DEC', 'DOU', 'FLO', 'BOO'), false)"
    # The searches only run on texts that are no JSON by themselves.
    frame = frame.selectExpr(
        "*",
        f"CASE WHEN NOT {direct} THEN {outer('{', '}')} END AS _braces",
        f"CASE WHEN NOT {direct} THEN {outer('[', ']')} END AS _brackets",
    )
    frame = frame.selectExpr(
        "*", f"coalesce(try_parse_json(_braces), try_parse_json(regexp_replace(_braces, {_COMMA}))) AS _object"
    )
    frame = frame.selectExpr(
        "*",
        "CASE WHEN _object IS NULL THEN"
        f" coalesce(try_parse_json(_brackets), try_parse_json(regexp_replace(_brackets, {_COMMA}))) END AS _list",
    )
    found = (
        f"CASE WHEN _k = 'OBJ' THEN _whole WHEN _k = 'ARR' THEN {wrap('_whole', 'items')}"
        f" WHEN {direct} THEN {wrap('_whole', 'data')} WHEN _object IS NOT NULL THEN _object"
        f" WHEN _list IS NOT NULL THEN {wrap('_list', 'items')} END"
    )
    # The generator keeps a later filter on the payload from being pushed below the
    # whole search, which would repeat it.
    return frame.selectExpr(*kept, f"{found} AS {out}").selectExpr(*kept, f"inline_outer(array(struct({out})))")


def reply_text(rows: DataFrame, payload: str, out: str = "text") -> DataFrame:
    """Text, finish reason and usage JSON of a provider reply in any of three layouts."""
    kept = rows.columns
    v = rows.selectExpr("*", f"try_parse_json({payload}) AS _p").selectExpr(
        "*",
        *[
            f"try_variant_get(_p, '$.{k}[0]', 'variant') AS _{k}" for k in ("choices", "predictions", "candidates")
        ],
    )
    prediction = (
        f"CASE WHEN {kind('_predictions')} = 'OBJ' THEN coalesce(nullif(try_variant_get(_predictions, '$.content', 'string'), ''),"
        " nullif(try_variant_get(_predictions, '$.text', 'string'), ''), to_json(_predictions))"
        " ELSE CAST(_predictions AS STRING) END"
    )
    parts = (
        "array_join(transform(coalesce(try_variant_get(_candidates, '$.content.parts', 'array<variant>'), array()),"
        " p -> coalesce(try_variant_get(p, '$.text', 'string'), '')), '')"
    )
    return v.selectExpr(
        *kept,
        f"CASE WHEN _choices IS NOT NULL THEN coalesce(try_variant_get(_choices, '$.message.content', 'string'), '')"
        f" WHEN _predictions IS NOT NULL THEN {prediction} WHEN _candidates IS NOT NULL THEN {parts}"
        f" ELSE {payload} END AS {out}",
        "coalesce(try_variant_get(_choices, '$.finish_reason', 'string'),"
        " try_variant_get(_candidates, '$.finishReason', 'string')) AS finish_reason",
        "CASE WHEN _choices IS NOT NULL THEN to_json(try_variant_get(_p, '$.usage', 'variant'))"
        " WHEN _candidates IS NOT NULL THEN to_json(try_variant_get(_p, '$.usageMetadata', 'variant')) END AS usage",
    )


def token_usage(rows: DataFrame, usage: str) -> DataFrame:
    """Token counts from either naming style; 0 counts as missing and the total defaults to the sum."""
    kept = rows.columns
    n = lambda *names: ", ".join(f"nullif(try_variant_get(_u, '$.{k}', 'bigint'), 0)" for k in names)
    counted = rows.selectExpr("*", f"try_parse_json({usage}) AS _u").selectExpr(
        *kept,
        f"coalesce({n('prompt_tokens', 'promptTokenCount')}, 0) AS prompt_tokens",
        f"coalesce({n('completion_tokens', 'candidatesTokenCount')}, 0) AS completion_tokens",
        f"coalesce({n('total_tokens', 'totalTokenCount')}) AS _total",
        # The first style's 0 falls through to the second style, whose 0 is kept.
        "coalesce(nullif(try_variant_get(_u, '$.cached_tokens', 'bigint'), 0),"
        " try_variant_get(_u, '$.cachedContentTokenCount', 'bigint')) AS cached_tokens",
    )
    total = "coalesce(_total, prompt_tokens + completion_tokens) AS total_tokens"
    return counted.selectExpr(*kept, "prompt_tokens", "completion_tokens", total, "cached_tokens")


def approx_tokens(text: str) -> str:
    """Number of blank-separated words, at least 1."""
    return f"greatest(1, size(filter(split({text}, '\\\\s+'), w -> w <> '')))"


# The key each stage's reply must have.
USABLE = {
    1: "try_variant_get(payload, '$.what_it_does', 'variant') IS NOT NULL",
    2: f"{kind('''try_variant_get(payload, '$.categories', 'variant')''')} = 'ARR'",
    3: "size(try_variant_get(payload, '$.mock_workflow', 'array<variant>')) > 0",
    4: "size(try_variant_get(payload, '$.turns', 'array<variant>')) > 0",
}


def stage_replies(replies: DataFrame) -> DataFrame:
    """Whether each stage reply can be used; the others take the stage's fallback.

    replies: stage and reply (text), and any keys. Adds payload (JSON text) and usable.
    """
    found = with_json(replies, "reply")
    checks = " ".join(f"WHEN {stage} THEN {test}" for stage, test in USABLE.items())
    return found.selectExpr(
        *replies.columns, f"coalesce(CASE stage {checks} END, false) AS usable", "to_json(payload) AS payload"
    )


def _score(value: str) -> str:
    """A score leaf as a number: NULL where it is absent or null, NaN where it is no number (text, list, object).

    Numbers in text and booleans count as numbers.
    """
    shown = f"to_json({value})"
    number = f"coalesce(try_cast(trim(BOTH '\"' FROM {shown}) AS DOUBLE), CASE {shown} WHEN 'true' THEN 1D WHEN 'false' THEN 0D END, double('NaN'))"
    return f"CASE WHEN {value} IS NOT NULL AND NOT is_variant_null({value}) THEN {number} END"


def _at(path: str, of: str = "variant") -> str:
    return f"try_variant_get(payload, '$.{path}', '{of}')"


def raw_scores(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Judge replies as raw score columns; rows whose text holds no JSON have NULL in ``payload``."""
    found = with_json(replies, text)
    leaf = lambda path, name: f"{_score(_at(path))} AS {name}"
    arguments = ("completeness", "name_accuracy", "value_accuracy", "type_compliance", "format_compliance", "relevancy")
    ordering = ("sequence_logic", "dependency_handling", "execution_efficiency")
    return found.selectExpr(
        *[c for c in replies.columns if c != text],
        leaf("usage.necessity", "necessity"),
        # An absent overuse is 0, a null one is missing.
        f"CASE WHEN {_at('usage.overuse_detection')} IS NOT NULL THEN {_score(_at('usage.overuse_detection'))}"
        f" WHEN {_at('usage.overuse')} IS NOT NULL THEN {_score(_at('usage.overuse'))} ELSE 0D END AS overuse",
        *[leaf(f"selection.{c}", f"sel_{c}") for c in ("correctness", "specificity", "completeness")],
        "coalesce(try_variant_get(payload, '$.ordering.not_applicable', 'boolean'), true) AS ordering_na",
        *[leaf(f"ordering.{c}", c) for c in ordering],
        *[leaf(f"arguments.{c}", c) for c in arguments],
        "coalesce(try_variant_get(payload, '$.failures', 'array<string>'), array()) AS failures",
        "coalesce(try_variant_get(payload, '$.rationale', 'string'), '') AS rationale",
        "payload IS NULL AS rejected",
    )


def raw_coherence(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Coherence replies as raw score columns (see ``raw_scores``); ``retention_na`` is true unless the reply says otherwise."""
    found = with_json(replies, text)
    four = ("logical_flow", "completeness", "conciseness", "topic_relevance")
    return found.selectExpr(
        *[c for c in replies.columns if c != text],
        *[f"{_score(_at(c))} AS {c}" for c in four],
        f"coalesce({_at('context_retention.not_applicable', 'boolean')}, true) AS retention_na",
        f"{_score(_at('context_retention.score'))} AS context_retention",
        f"coalesce({_at('manifestations', 'array<string>')}, array()) AS manifestations",
        f"coalesce({_at('rationale', 'string')}, '') AS rationale",
        "payload IS NULL AS rejected",
    )


# ---- judges ---------------------------------------------------------------------------


def ask(prompts: DataFrame, judge: Callable[[str], str], keys: list[str], prompt: str = "prompt") -> DataFrame:
    """Send each prompt to the caller's judge function, batch by batch on the executors.

    A failing call becomes a row with its error instead of failing the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, errors = [], []
            for text in batch[prompt]:
                try:
                    replies.append(judge(text))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001
                    replies.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield batch[keys].assign(reply=replies, error=errors)

    ship_code(prompts.sparkSession)
    types = dict(prompts.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", reply string, error string"
    return prompts.select(*keys, prompt).mapInPandas(run, schema)


def pattern_replies(prompts: DataFrame, cases: list[tuple[str, str]], prompt: str = "prompt") -> DataFrame:
    """Reply of the first pattern the prompt contains or matches; the list is short and fixed."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    branches = " ".join(
        f"WHEN contains({prompt}, {quote(p)}) OR {prompt} RLIKE {quote(p)} THEN {quote(r)}" for p, r in cases
    )
    return prompts.withColumn("reply", F.expr(f"CASE {branches} END"))


def replies_from_table(prompts: DataFrame, table: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Reply of the first pattern, by priority, that a prompt contains or matches; NULL where none does.

    table: priority (unique), pattern, reply, of any size (see ``patterns``).
    """
    return patterns.replies(prompts, table, prompt)
