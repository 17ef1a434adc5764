"""Tool specifications, capability matrices and seed outputs from JSON documents.

The readers give one row per document (server, source, file, doc); everything
after that is a projection over documents, wherever they come from.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.functions.variants import kind
from callgauge.operators.lint import Spec

DOC_COLUMNS = "server string, source string, file string, doc string"
# A folder's first file in this order is its specification.
SPEC_FILES = ("tools_list.json", "tools.json")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every JSON file in the server folders under ``root``; a missing root gives no rows."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    try:
        files = reader.text(root, wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], DOC_COLUMNS)
        raise
    path = "_metadata.file_path"
    return files.selectExpr(
        f"regexp_extract({path}, '([^/]+)/[^/]+$', 1) AS server",
        f"regexp_extract({path}, '^(.*)/[^/]+$', 1) AS source",
        f"regexp_extract({path}, '([^/]+)$', 1) AS file",
        "value AS doc",
    )


def server_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of one server folder."""
    return read_documents(spark, folder)


def spec_documents(docs: DataFrame) -> DataFrame:
    """One specification document per source: the list file, else the short-named one."""
    rank = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(SPEC_FILES))
    ranked = docs.selectExpr("*", f"CASE file {rank} END AS rank").where("rank IS NOT NULL")
    return ranked.groupBy("server", "source").agg(F.min_by("doc", "rank").alias("doc"))


def tool_documents(docs: DataFrame) -> DataFrame:
    """One row per tool object; a document is ``{"tools": [..]}`` or a bare list.

    Entries that are no objects are skipped. A document that is no JSON is an error.
    """
    listed = docs.selectExpr("*", f"{kind('parse_json(doc)')} AS doc_kind")
    return listed.selectExpr(
        *[c for c in docs.columns if c != "doc"],
        "posexplode(CASE WHEN doc_kind = 'OBJ' THEN from_json(doc, 'struct<tools:array<string>>').tools"
        " WHEN doc_kind = 'ARR' THEN from_json(doc, 'array<string>') END) AS (tool_pos, tool)",
    ).where(f"{kind('try_parse_json(tool)')} = 'OBJ'")


_SCHEMA_KEYS = ("inputSchema", "input_schema", "parameters")


def normalize_tools(tool_docs: DataFrame, column: str = "tool") -> DataFrame:
    """Tool rows from tool objects: name, description, capabilities, and its schema's properties.

    The first non-empty of the three schema keys counts. A schema without a
    ``properties`` key is itself the property map.
    """
    kept = [c for c in tool_docs.columns if c != column]
    got = [f"get_json_object({column}, '$.{k}')" for k in _SCHEMA_KEYS]
    full = [f"CASE WHEN {g} NOT IN ('{{}}', '[]', 'null', '', '0', 'false') THEN {g} END" for g in got]
    schema = tool_docs.selectExpr("*", f"parse_json({column}) AS _v", f"coalesce({', '.join(full)}, '{{}}') AS _schema")
    shaped = schema.selectExpr(
        "*",
        f"{kind('try_parse_json(_schema)')} = 'OBJ' AND NOT array_contains(json_object_keys(_schema), 'properties') AS _flat",
        f"{kind('try_parse_json(_schema)')} = 'OBJ' AS _object",
    )
    return shaped.selectExpr(
        *kept,
        "coalesce(try_variant_get(_v, '$.name', 'string'), '') AS tool_name",
        "coalesce(try_variant_get(_v, '$.description', 'string'), '') AS description",
        "to_json(try_variant_get(_v, '$.capabilities', 'variant')) AS tool_capabilities",
        "CASE WHEN NOT coalesce(_object, false) THEN '{}' WHEN _flat THEN _schema"
        " ELSE coalesce(get_json_object(_schema, '$.properties'), '{}') END AS properties",
        "CASE WHEN _object AND NOT _flat THEN coalesce(from_json(get_json_object(_schema, '$.required'), 'array<string>'), array())"
        " ELSE array() END AS required_list",
    )


def param_rows(tools: DataFrame) -> DataFrame:
    """One row per property of each tool, in the order of the document."""
    keyed = tools.selectExpr("*", "json_object_keys(properties) AS _keys", "try_parse_json(properties) AS _props")
    each = tools.sparkSession.tvf.variant_explode(F.col("_props").outer()).selectExpr("key AS param_name", "value AS _p")
    text = lambda key: f"try_variant_get(_p, '$.{key}', 'string')"
    raw = lambda key: f"to_json(try_variant_get(_p, '$.{key}', 'variant'))"
    kept = [c for c in tools.columns if c not in ("properties", "required_list", "description", "tool_capabilities")]
    return keyed.lateralJoin(each).selectExpr(
        *kept,
        "CAST(array_position(_keys, param_name) - 1 AS INT) AS param_pos",
        "param_name",
        f"coalesce({text('type')}, 'string') AS param_type",
        f"coalesce({text('description')}, '') AS description",
        "array_contains(required_list, param_name)"
        f" OR coalesce({raw('required')} NOT IN ('false', 'null', '[]', '0', '\"\"', '{{}}'), false) AS required",
        "transform(try_variant_get(_p, '$.enum', 'array<variant>'), e -> to_json(e)) AS enum",
        f"{raw('default')} AS default_value",
        f"{raw('items')} AS items",
        f"{raw('properties')} AS properties",
        "try_variant_get(_p, '$.minimum', 'double') AS minimum",
        "try_variant_get(_p, '$.maximum', 'double') AS maximum",
        "endswith(param_name, '_uri') AND NOT contains(param_name, 'bucket') AS is_uri",
    )


def capability_rows(docs: DataFrame) -> DataFrame:
    """Long capability table from matrix documents: models at the top or under ``models``."""
    spark = docs.sparkSession
    wrapped = f"CASE WHEN {kind('''try_variant_get(_v, '$.models', 'variant')''')} = 'OBJ' THEN try_variant_get(_v, '$.models', 'variant') ELSE _v END"
    v = docs.selectExpr("server", "parse_json(doc) AS _v").selectExpr("server", f"{wrapped} AS _models")
    v = v.where(f"{kind('_models')} = 'OBJ'")
    model = spark.tvf.variant_explode(F.col("_models").outer()).selectExpr("key AS model", "value AS _caps")
    models = v.lateralJoin(model).where(f"{kind('_caps')} = 'OBJ'")
    cap = spark.tvf.variant_explode(F.col("_caps").outer()).selectExpr("key AS capability", "to_json(value) AS value")
    return models.lateralJoin(cap).select("server", "model", "capability", "value")


def seed_rows(docs: DataFrame) -> DataFrame:
    """Seed outputs per tool, with or without the grounding wrapper; notes are skipped."""
    v = docs.selectExpr("server", "parse_json(doc) AS _v")
    each = docs.sparkSession.tvf.variant_explode(F.col("_v").outer()).selectExpr("key AS tool_name", "value AS _seed")
    return v.lateralJoin(each).where(f"{kind('_seed')} = 'OBJ'").selectExpr(
        "server",
        "tool_name",
        "try_variant_get(_seed, '$.grounding', 'string') AS grounding",
        "to_json(coalesce(try_variant_get(_seed, '$.example_output', 'variant'), _seed)) AS example_output",
    )


def overlay_capabilities(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Capabilities of ``base`` with those of ``extra`` on top."""
    key = ["server", "model", "capability"]
    both = base.join(extra.withColumnRenamed("value", "over"), key, "full")
    return both.select(*key, F.coalesce("over", "value").alias("value"))


def override_tools(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Registry with the passed tools in place of the same-named ones."""
    return base.join(extra.select("tool_name").distinct(), "tool_name", "left_anti").unionByName(extra.select(*base.columns))


def load_spec(spark: SparkSession, root: str, rules: DataFrame, capabilities: str | None = None) -> Spec:
    """Registry of all server folders under ``root`` (or of one folder), ready for the linter.

    ``capabilities`` is an optional folder of matrices put on top.
    """
    docs = read_documents(spark, root)
    tools = normalize_tools(tool_documents(spec_documents(docs)))
    params = param_rows(tools)
    matrix = capability_rows(docs.where("file = 'capabilities.json'"))
    if capabilities is not None:
        matrix = overlay_capabilities(matrix, capability_rows(read_documents(spark, capabilities)))
    columns = ["server", "tool_name", "param_pos", "param_name", "param_type", "required", "enum", "is_uri"]
    return Spec(
        tools.select("server", "tool_name", "description"),
        params.select(*columns, "minimum", "maximum"),
        matrix,
        rules,
    )


def spec_from_dict(spark: SparkSession, server: str, spec_json: str) -> DataFrame:
    """Documents table of a specification given as JSON text."""
    return spark.createDataFrame([(server, server, SPEC_FILES[0], spec_json)], DOC_COLUMNS)


def only_servers(table: DataFrame, servers: list[str]) -> DataFrame:
    """One registry of several servers out of a larger one."""
    return table.where(F.col("server").isin(*servers))
