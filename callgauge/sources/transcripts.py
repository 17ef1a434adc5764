"""Transcripts and emitted calls from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgauge.functions.variants import kind
from callgauge.operators.ordering import number_slice
from callgauge.session import saved

_FALSY_ARGS = "('{}', '[]', 'null', '\"\"', '0', 'false')"


def normalize_calls(calls: DataFrame, column: str = "call") -> DataFrame:
    """Name and arguments of raw call objects, read the way the linter reads them.

    A present ``function_name`` (or ``parameters``) wins even when it is null.
    Adds is_object, tool_name (NULL unless a string), arguments (JSON text, NULL
    when the call has none), and call_name / call_arguments / call_ref: the values
    of the forgiving reader, which takes the first alias that is not empty.
    """
    v = calls.selectExpr("*", f"try_parse_json({column}) AS _v")
    v = v.selectExpr("*", f"coalesce({kind('_v')} = 'OBJ', false) AS is_object")
    v = v.selectExpr(
        "*",
        f"CASE WHEN is_object THEN json_object_keys({column}) ELSE array() END AS _keys",
        *[
            f"CASE WHEN is_object THEN try_variant_get(_v, '$.{key}', 'variant') END AS _{key}"
            for key in ("function_name", "name", "parameters", "arguments", "call_id", "id")
        ],
    )
    v = v.selectExpr(
        "*",
        "CASE WHEN array_contains(_keys, 'function_name') THEN _function_name ELSE _name END AS _lint_name",
        "CASE WHEN array_contains(_keys, 'parameters') THEN _parameters ELSE _arguments END AS _lint_args",
    )

    def first(*names: str) -> str:
        texts = [f"nullif(try_cast(_{n} AS STRING), '')" for n in names]
        return f"coalesce({', '.join(texts)})"

    def first_args(*names: str) -> str:
        texts = [f"CASE WHEN to_json(_{n}) NOT IN {_FALSY_ARGS} THEN to_json(_{n}) END" for n in names]
        return f"coalesce({', '.join(texts)}, '{{}}')"

    kept = [c for c in calls.columns if c != column]
    return v.selectExpr(
        *kept,
        "is_object",
        f"CASE WHEN {kind('_lint_name')} = 'STR' THEN CAST(_lint_name AS STRING) END AS tool_name",
        "to_json(_lint_args) AS arguments",
        f"CASE WHEN is_object THEN coalesce({first('name', 'function_name')}, '') END AS call_name",
        f"CASE WHEN is_object THEN {first_args('arguments', 'parameters')} END AS call_arguments",
        f"{first('call_id', 'id')} AS call_ref",
    )


CASE_FIELDS = ("label", "kind", "prompt", "injected_fault", "expected_taxonomy")


def cases_from_json(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Cases from transcript documents: a list of cases, or one lone case.

    One row per (document, case, call); a case without calls keeps one row with
    NULL call. ``calls`` and ``agent_calls`` are the same key; a lone call object
    in place of the list counts as one call.
    """
    v = docs.selectExpr("*", f"parse_json({column}) AS _doc")
    wrapped = v.selectExpr(
        "*", f"CASE WHEN {kind('_doc')} = 'ARR' THEN _doc ELSE parse_json(concat('[', {column}, ']')) END AS _list"
    )
    case = docs.sparkSession.tvf.variant_explode(F.col("_list").outer()).selectExpr("pos AS case_index", "value AS _case")
    kept = [c for c in docs.columns if c != column]
    return _calls_of(wrapped.lateralJoin(case).select(*kept, "case_index", "_case"), kept)


def _calls_of(cases: DataFrame, kept: list[str]) -> DataFrame:
    """One row per call of each case, a Variant ``_case`` at ``case_index``."""
    spark = cases.sparkSession
    cases = cases.selectExpr(
        *kept,
        "case_index",
        "coalesce(try_variant_get(_case, '$.label', 'string'), concat('Case-', case_index + 1)) AS label",
        *[f"try_variant_get(_case, '$.{f}', 'string') AS {f}" for f in CASE_FIELDS[1:]],
        "coalesce(try_variant_get(_case, '$.calls', 'variant'),"
        " try_variant_get(_case, '$.agent_calls', 'variant')) AS _calls",
    )
    cases = cases.selectExpr(
        "*",
        f"CASE WHEN {kind('_calls')} = 'OBJ' THEN parse_json(concat('[', to_json(_calls), ']'))"
        f" WHEN {kind('_calls')} = 'ARR' THEN _calls END AS _call_list",
    )
    call = spark.tvf.variant_explode_outer(F.col("_call_list").outer()).selectExpr(
        "pos AS call_index", "to_json(value) AS call"
    )
    return cases.lateralJoin(call).select(*kept, "case_index", *CASE_FIELDS, "call_index", "call")


# A byte range of a file is cut into so many pieces for the sums inside it, so a task never sorts a whole range.
CUT_PIECES = 65_536
PLACE = ["file", "block", "cut"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut behind every closing brace: (file, block, cut, at, text, depth, inside, list, tail), read by byte ranges.

    ``depth`` and ``inside`` tell how many brackets are open behind a piece and whether a string is; ``tail`` marks what
    follows the last brace. A range starts behind a brace, so only the quotes and brackets before it have to be known, and
    these are sums: first of quotes, then of the brackets outside strings, in each cut of ``CUT_PIECES`` pieces of a range
    and over the cuts of a file. The pieces are saved before, so every sum sees the same cuts.
    """
    raw = spark.read.text(path, lineSep="}").selectExpr(
        "_metadata.file_path AS file", "_metadata.file_block_start AS block", "monotonically_increasing_id() AS at", "value AS text"
    )
    # Behind a brace no escape is open, and in JSON a backslash escapes only inside strings.
    raw = raw.selectExpr("*", r"""regexp_replace(text, r'\\.', '') AS plain""")
    raw = raw.selectExpr("*", r"""length(plain) - length(replace(plain, '"', '')) AS quotes""", f"at div {CUT_PIECES}L AS cut")
    raw = saved(raw, "raw-pieces")
    ranges = saved(raw.groupBy(*PLACE).agg(F.sum("quotes").alias("quotes")), "range-quotes")
    in_file = Window.partitionBy("file").orderBy("block", "cut").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(*PLACE, F.coalesce(F.sum("quotes").over(in_file), F.lit(0)).alias("quotes_before"))
    in_range = Window.partitionBy(*PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = raw.withColumn("seen", F.coalesce(F.sum("quotes").over(in_range), F.lit(0))).join(before, PLACE)
    placed = placed.selectExpr("*", "(quotes_before + seen) % 2 = 1 AS starts_inside", "(quotes_before + seen + quotes) % 2 = 1 AS inside")
    # A string open at either end is closed there, then all strings go.
    bare = r"""regexp_replace(concat(if(starts_inside, '"', ''), plain, if(inside, '"', '')), '(?s)"[^"]*"', '')"""
    placed = placed.selectExpr(*PLACE, "at", "text", "inside", f"{bare} AS bare")
    count = lambda signs: f"(length(bare) - length(translate(bare, '{signs}', '')))"
    placed = placed.selectExpr("*", f"{count('{')} = 0 AND NOT inside AS no_object", f"{count('[{')} - {count(']}')} AS opened")
    placed = placed.selectExpr("*", "opened - if(inside, 0, 1) AS step", "regexp_like(bare, '^[\\\\s\ufeff]*\\\\[') AS opens_list")
    placed = saved(placed.drop("bare"), "pieces")
    steps = placed.groupBy(*PLACE).agg(F.sum("step").alias("step"), F.min_by("opens_list", "at").alias("opens_list"))
    before = steps.select(
        *PLACE,
        F.coalesce(F.sum("step").over(in_file), F.lit(0)).alias("depth_before"),
        F.first("opens_list").over(Window.partitionBy("file").orderBy("block", "cut")).alias("list"),
    )
    upto = F.coalesce(F.sum("step").over(in_range), F.lit(0))
    placed = placed.withColumn("upto", upto).join(before, PLACE).selectExpr("*", "depth_before + upto AS depth_at_start")
    return placed.selectExpr(
        *(*PLACE, "at", "text", "list", "inside", "step", "depth_at_start + step AS depth"),
        "no_object AND depth_at_start <= if(list, 1, 0) AS tail",
    )


def split_cases(spark: SparkSession, path: str) -> DataFrame:
    """(file, case_index, _case) of transcript files, each read by as many tasks as it has byte ranges.

    A case may span ranges; it is put together by its number. Values of a list that are no objects stand with the next case
    that is one, and are told apart once they are parsed. A file with nothing but blanks has no cases, objects one after another
    (JSON lines) are a case each, and a file that ends within a value is an error.
    """
    pieces = _pieces(spark, path)
    cut_off = pieces.groupBy("file").agg(F.sum(F.expr("step + if(tail, 1, 0)")).alias("open"), F.max_by("inside", F.struct("block", "at")).alias("inside"))
    broken = cut_off.where("open <> 0 OR inside").select("file").first()
    if broken is not None:
        raise ValueError(f"MALFORMED: brackets or quotes of {broken.file} do not match")
    ends = "NOT tail AND NOT inside AND depth = if(list, 1, 0)"
    pieces = pieces.selectExpr("*", f"CAST({ends} AS INT) AS ends")
    in_file = Window.partitionBy("file").orderBy("block", "cut").rowsBetween(Window.unboundedPreceding, -1)
    in_range = Window.partitionBy(*PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ended = pieces.groupBy(*PLACE).agg(F.sum("ends").alias("n"))
    ended = ended.select(*PLACE, F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("before"))
    number = F.col("before") + F.coalesce(F.sum("ends").over(in_range), F.lit(0))
    part = F.struct("block", "at", F.concat("text", F.when(F.col("tail"), "").otherwise("}")).alias("text"))
    groups = (
        pieces.join(ended, PLACE)
        .withColumn("number", number)
        .groupBy("file", "number", "list")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "").alias("text"), F.bool_or("tail").alias("tail"))
    )
    # What a group holds beside its values: the list's bracket before the first, a comma before the others, its end.
    groups = groups.selectExpr("file", "number", "list", "tail", r"regexp_replace(text, '^[\\s\ufeff]+', '') AS text")
    body = r"if(list, regexp_replace(if(tail, regexp_replace(text, '\\]\\s*$', ''), text), if(number = 0, '^\\[', '^,'), ''), text)"
    groups = saved(groups.selectExpr("file", "number", "tail", f"parse_json(concat('[', {body}, ']')) AS _list"), "case-groups")
    # Nearly all groups hold one value: only the others move the numbers behind them. Behind the last brace none is left.
    size = "size(CAST(_list AS ARRAY<VARIANT>))"
    others = groups.where(f"{size} <> 1 AND NOT tail").selectExpr("file", "number AS other", f"{size} - 1 AS more")
    others = saved(others, "uneven-groups")
    if not others.isEmpty():
        moves = groups.select("file", "number").withColumn("_slice", number_slice("number", 100_000))
        moves = moves.join(others, (moves["file"] == others["file"]) & (moves["number"] == others["other"]), "left").select(moves["file"], "number", "_slice", F.coalesce("more", F.lit(0)).alias("more"))
        sums = moves.groupBy("file", "_slice").agg(F.sum("more").alias("n"))
        upto = Window.partitionBy("file").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("file", "_slice", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
        inside = Window.partitionBy("file", "_slice").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
        moves = moves.withColumn("moved", F.coalesce(F.sum("more").over(inside), F.lit(0))).join(sums, ["file", "_slice"])
        groups = groups.join(moves.selectExpr("file", "number", "before + moved AS moved"), ["file", "number"])
    else:
        groups = groups.withColumn("moved", F.lit(0))
    value = spark.tvf.variant_explode(F.col("_list").outer()).selectExpr("pos", "value AS _case")
    return groups.lateralJoin(value).selectExpr("file", "CAST(number + moved + pos AS INT) AS case_index", "_case")


def load_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Read transcript JSON files, lists of cases or lone cases, of any size."""
    return _calls_of(split_cases(spark, path), ["file"])
