"""Input tables of the registered queries, derived from the driver's tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.operators.lint import RULE_COLUMNS, Spec
from callgauge.operators.ordering import number_slice, time_slice, with_position
from callgauge.session import configure, literal_table

MEDIA_TOOLS = (
    ("img", "img_generate"),
    ("vid", "vid_generate"),
    ("vid", "vid_from_image"),
    ("music", "music_generate"),
    ("av", "av_combine"),
)
MEDIA_PARAMS = (
    ("seed", "number"),
    ("prompt", "string"),
    ("model", "string"),
    ("aspect_ratio", "string"),
    ("generate_audio", "boolean"),
    ("sample_count", "number"),
    ("image_uri", "string"),
    ("images", "array"),
    ("bucket", "string"),
)
MODELS = (("m-1", False, "16:9", 4), ("m-2", True, "16:9|9:16", 2), ("m-3", True, "16:9|9:16|1:1", 3))
JUDGES = (("judge_a", 1), ("judge_b", 4))
SPREAD_ROWS = 50_000


def json_pair(key: str, value: Column | str) -> Column:
    """``,"key":value`` where value is JSON text; NULL leaves the pair out."""
    text = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f',"{key}":'), text), F.lit(""))


class Tables:
    """Driver tables of one folder and the fixtures built from them, made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table's rows handed to tasks of about ``SPREAD_ROWS`` rows, at least one for each core.

        The splits of a file are no guide: the rows of one row group are read by one of them and the others are empty. The count
        comes from the files' footers.
        """
        table = self.read(name)
        return table.repartition(max(self.spark.sparkContext.defaultParallelism, -(-table.count() // SPREAD_ROWS)), key)

    # ---- media registry: 5 tools, fixed size -------------------------------

    @cached_property
    def tool_params(self) -> DataFrame:
        rows = []
        for server, tool in MEDIA_TOOLS:
            for pos, (param, kind) in enumerate(MEDIA_PARAMS):
                required = param == "prompt" or (param == "image_uri" and tool == "vid_from_image")
                enum = ["1:1", "16:9", "9:16", "4:3"] if (param, tool) == ("aspect_ratio", "img_generate") else None
                rows.append((server, tool, pos, param, kind, required, enum))
        return literal_table(
            self.spark,
            rows,
            "server string, tool_name string, param_pos int, param_name string, param_type string, "
            "required boolean, enum_values array<string>",
        )

    @cached_property
    def media_spec(self) -> Spec:
        spark = self.spark
        tools = literal_table(spark, [(s, t, "") for s, t in MEDIA_TOOLS], "server string, tool_name string, description string")
        params = self.tool_params.select(
            "server", "tool_name", "param_pos", "param_name", "param_type", "required",
            F.transform("enum_values", lambda e: F.concat(F.lit('"'), e, F.lit('"'))).alias("enum"),
            (F.col("param_name") == "image_uri").alias("is_uri"),
        )
        caps = []
        for server in ("img", "vid", "music", "av"):
            for model, audio, ratios, most in MODELS:
                listed = "[" + ",".join(f'"{r}"' for r in ratios.split("|")) + "]"
                caps += [(server, model, "audio", str(audio).lower()), (server, model, "ratios", listed)]
                caps.append((server, model, "max_samples", str(most)))
        rules = [
            (".*", "model", "known_model", None, None, None, None, "unknown_model", "ERROR", "is not a known model"),
            (".*", "generate_audio", "flag", "audio", None, None, None, "capability_violation", "CAPABILITY_VIOLATION", "is not supported"),
            (".*", "aspect_ratio", "model_set", "ratios", None, None, None, "capability_violation", "CAPABILITY_VIOLATION", "is not supported"),
            (".*", "sample_count", "range", None, 1.0, None, None, "invalid_value", "ERROR", "is below 1"),
        ]
        return Spec(
            tools,
            params,
            literal_table(spark, caps, "server string, model string, capability string, value string"),
            literal_table(spark, rules, RULE_COLUMNS),
            bounded=True,
        )

    # ---- emitted calls ------------------------------------------------------

    @cached_property
    def call_keys(self) -> DataFrame:
        """call_id, transcript_id, ts, fault_no and tool of each event."""
        return self._keys(self.spread("events", "event_id"))

    @cached_property
    def stream_calls(self) -> DataFrame:
        """The same calls as ``calls_unordered``, read as a stream of files."""
        schema = self.read("events").schema
        return self._with_arguments(self._keys(self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/events*.parquet")))

    @staticmethod
    def _keys(events: DataFrame) -> DataFrame:
        e = F.col("event_type")
        fault = (F.col("event_id") % 20).cast("int")
        return events.select(
            F.col("event_id").alias("call_id"),
            (F.col("user_id") * 100 + F.day("ts").cast("bigint")).alias("transcript_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            fault.alias("fault_no"),
            F.when(fault == 8, "media_unknown")
            .when(e == "view", "img_generate")
            .when(e == "click", "vid_generate")
            .when(e == "purchase", "vid_from_image")
            .when(e == "signup", "music_generate")
            .otherwise("av_combine")
            .alias("tool_name"),
        )

    @cached_property
    def calls_unordered(self) -> DataFrame:
        """Calls without their index: enough for every rule that looks at one call."""
        return self._with_arguments(self.call_keys)

    @staticmethod
    def _with_arguments(keys: DataFrame) -> DataFrame:
        f, cid = F.col("fault_no"), F.col("call_id").cast("string")
        args = F.concat(
            F.lit('{"seed":'),
            (F.col("call_id") % 100).cast("string"),
            F.when(f == 0, "")
            .when(f == 10, ',"prompt":""')
            .when(f == 11, ',"prompt":null')
            .otherwise(F.concat(F.lit(',"prompt":"scene '), cid, F.lit('"'))),
            F.lit(',"model":"'),
            F.when(f == 3, "m-9-ultra")
            .when(f == 4, "m-1")
            .when(F.col("call_id") % 2 == 0, "m-2")
            .otherwise("m-3"),
            F.when(f == 1, '","ratio":"16:9"').when(f == 2, '","aspect_ratio":"21:9"').otherwise('","aspect_ratio":"16:9"'),
            F.when(f == 4, ',"generate_audio":true').otherwise(',"generate_audio":false'),
            F.lit(',"sample_count":'),
            F.when(f == 5, '"two"').when(f == 6, "0").when(f == 12, "true").otherwise("1"),
            F.lit(',"image_uri":"'),
            F.when(f == 7, "in.png").otherwise(
                F.concat(F.lit("gs://b/"), F.col("transcript_id").cast("string"), F.lit(".png"))
            ),
            F.when(f == 9, '","images":"gs://b/x.png"').otherwise('","images":["gs://b/x.png"]'),
            F.lit(',"bucket":"gs://b/out/"}'),
        )
        return keys.withColumn("arguments", args)

    @cached_property
    def call_order(self) -> DataFrame:
        """call_keys with call_index."""
        return with_position(self.call_keys, ["transcript_id"], ["ts", "call_id"], time_slice("ts"), "call_index")

    @cached_property
    def calls(self) -> DataFrame:
        return with_position(
            self.calls_unordered, ["transcript_id"], ["ts", "call_id"], time_slice("ts"), "call_index"
        )

    # ---- raw call objects, with the aliases and faults of real emitters -----

    @cached_property
    def raw_calls(self) -> DataFrame:
        n = F.col("event_id") % 10
        ident = F.col("event_id").cast("string")
        good = F.concat(F.lit('{"prompt":"scene '), ident, F.lit('"}'))
        call = (
            F.when(n == 0, F.concat(F.lit('{"function_name":"img_generate","parameters":'), good, F.lit(',"id":"c'), ident, F.lit('"}')))
            .when(n == 1, F.concat(F.lit('{"name":"vid_generate","arguments":'), good, F.lit(',"call_id":"k'), ident, F.lit('"}')))
            .when(n == 2, '"just text"')
            .when(n == 3, F.concat(F.lit('{"function_name":null,"name":"img_generate","arguments":'), good, F.lit("}")))
            .when(n == 4, '{"function_name":["x"],"arguments":{}}')
            .when(n == 5, '{"name":"","arguments":[1]}')
            .when(n == 6, '{"name":"img_generate","arguments":[1]}')
            .when(n == 7, '{"function_name":"img_generate","parameters":"text"}')
            .when(n == 8, '{"name":"music_generate"}')
            .otherwise(F.concat(F.lit('{"name":"av_combine","parameters":{},"arguments":'), good, F.lit("}")))
        )
        return self.spread("events", "event_id").select(
            F.col("event_id").alias("call_id"),
            (F.col("user_id") * 100 + F.day("ts").cast("bigint")).alias("transcript_id"),
            call.alias("call"),
        )

    # ---- a second registry for the rules the first one cannot show -----------

    @cached_property
    def studio_params(self) -> DataFrame:
        tools = (("vid", "clip_morph"), ("av", "gif_make"), ("speech", "speech_say"), ("music", "song_make"))
        params = (
            ("prompt", "string"),
            ("model", "string"),
            ("fps", "number"),
            ("encoding", "string"),
            ("sample_count", "number"),
            ("tags", "array"),
            ("out_uri", "string"),
            ("aspect_ratio", "string"),
            ("image_uri", "string"),
        )
        rows = [
            (server, tool, pos, name, kind, name == "prompt")
            for server, tool in tools
            for pos, (name, kind) in enumerate(params)
        ]
        return literal_table(
            self.spark,
            rows,
            "server string, tool_name string, param_pos int, param_name string, param_type string, required boolean",
        )

    @cached_property
    def studio_spec(self) -> Spec:
        spark = self.spark
        params = self.studio_params.selectExpr("*", "CAST(NULL AS array<string>) AS enum", "false AS is_uri")
        tools = params.selectExpr("server", "tool_name", "'' AS description").distinct()
        caps = [("vid", "m-1", "first_last", "false"), ("vid", "m-2", "first_last", "true"), ("vid", "m-3", "first_last", '"true"')]
        caps += [("music", m, "max_samples", n) for m, n in (("m-1", "4"), ("m-2", "2"), ("m-3", "3"))]
        caps += [(s, m, "listed", "true") for s in ("av", "speech") for m in ("m-1", "m-2", "m-3")]
        violation = ("capability_violation", "CAPABILITY_VIOLATION")
        rules = [
            (".*", "model", "known_model", None, None, None, None, "unknown_model", "ERROR", "is not a known model"),
            ("clip_morph", "model", "tool_flag", "first_last", None, None, None, *violation, "has no first/last frame mode"),
            ("gif_make", "fps", "range", None, 1.0, 60.0, None, *violation, "is not between 1 and 60"),
            ("speech_say", "encoding", "fixed_set", None, None, None, ["LINEAR16", "MP3", "OGG_OPUS"], *violation, "is not supported"),
            ("song_make", "sample_count", "model_max", "max_samples", None, None, None, "capability_violation", "ERROR", "is above the maximum"),
            ("song_make", "sample_count", "range", None, 1.0, None, None, "invalid_value", "ERROR", "is below 1"),
        ]
        return Spec(
            tools,
            params,
            literal_table(spark, caps, "server string, model string, capability string, value string"),
            literal_table(spark, rules, RULE_COLUMNS),
            bounded=True,
        )

    @cached_property
    def studio_calls(self) -> DataFrame:
        i = F.col("event_id")
        pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), ((i % n) + 1).cast("int"))
        args = F.concat(
            F.lit('{"prompt":"take '), i.cast("string"),
            F.lit('","model":"'), pick(3, "m-1", "m-2", "m-3"),
            F.lit('","fps":'), (i % 70).cast("string"),
            F.lit(',"encoding":"'), pick(5, "LINEAR16", "MP3", "OGG_OPUS", "FLAC", "WAV"),
            F.lit('","sample_count":'), (i % 6).cast("string"),
            F.lit(',"tags":'), pick(4, '["a","b"]', '["a",1]', "[]", "[null]"),
            F.lit(',"out_uri":"'), pick(11, "gs://b/o.mp4", "gs://Bad/x", "b/o", "gs://b/", "gs://b-1/a/b", "s3://b/x", "gs://b_c/.d", "", "gs://-b/x", "gs://b.c/d", "/tmp/x"),
            F.lit('","'), pick(7, "ratio", "aspectRatio", "image_url", "aspect_ratioo", "aspect_ratio", "aspect_ratio", "image_uri"),
            F.lit('":"16:9"}'),
        )
        return self.spread("events", "event_id").select(
            i.alias("call_id"),
            (F.col("user_id") * 100 + F.day("ts").cast("bigint")).alias("transcript_id"),
            pick(4, "clip_morph", "gif_make", "speech_say", "song_make").alias("tool_name"),
            args.alias("arguments"),
        )

    # ---- judge scores ------------------------------------------------------------

    def _judge_scores(self, calls: DataFrame) -> DataFrame:
        judges = F.explode(F.array(*[F.struct(F.lit(n).alias("judge"), F.lit(k).alias("k")) for n, k in JUDGES]))
        base = calls.withColumn("_j", judges).selectExpr("*", "_j.judge AS judge", "_j.k AS k").drop("_j")

        def score(a: int, b: int, good: str, when_null: str = "") -> str:
            spread = f"(call_id * {a} + {b} * k) % 11"
            return f"CAST(CASE {when_null} WHEN fault_no >= 13 THEN {good} ELSE {spread} END AS INT)"

        every = lambda a: f"CAST((call_id * {a} + k) % 11 AS INT)"
        passed = ["multi_call"] if "multi_call" in calls.columns else []
        return base.selectExpr(
            "call_id",
            "transcript_id",
            "tool_name",
            "fault_no",
            "judge",
            *passed,
            "CASE WHEN fault_no >= 13 THEN 'correct' ELSE 'broken' END AS kind",
            "CASE WHEN fault_no IN (0, 10, 11) THEN 'argument_completeness' WHEN fault_no = 1 THEN 'argument_name'"
            " WHEN fault_no IN (5, 9, 12) THEN 'argument_type' WHEN fault_no = 8 THEN 'selection'"
            " WHEN fault_no >= 13 THEN 'none' ELSE 'argument_value' END AS expected_taxonomy",
            f"{score(7, 1, '8 + (call_id * 3 + k) % 3')} AS necessity",
            f"{score(3, 1, '8 + (call_id * 5 + k) % 3')} AS sel_correctness",
            f"{score(5, 1, '8 + (call_id + k) % 3')} AS sel_specificity",
            f"{score(9, 1, '9')} AS sel_completeness",
            f"{every(1)} AS sequence_logic",
            f"{every(2)} AS dependency_handling",
            f"{every(4)} AS execution_efficiency",
            f"{score(6, 1, '10', 'WHEN call_id % 89 = 0 THEN 15')} AS completeness",
            f"{score(8, 1, '10')} AS name_accuracy",
            f"{score(10, 1, '9')} AS value_accuracy",
            f"{score(2, 3, '10')} AS type_compliance",
            f"{score(3, 5, '10')} AS format_compliance",
            f"{score(1, 7, '10', 'WHEN call_id % 97 = 0 THEN NULL')} AS relevancy",
        ).selectExpr(
            "*",
            "CASE WHEN call_id % 3 = 0 AND kind = 'broken' THEN array(expected_taxonomy)"
            " WHEN call_id % 7 = 0 THEN array('ordering') ELSE array() END AS failures",
            "CASE WHEN call_id % 4 = 0 THEN concat('fault in ', expected_taxonomy) ELSE 'no comment' END AS rationale",
        )

    @cached_property
    def judge_scores(self) -> DataFrame:
        return self._judge_scores(self.call_keys)

    @cached_property
    def judge_scores_ordered(self) -> DataFrame:
        """With multi_call, which needs the call index."""
        return self._judge_scores(self.call_order.withColumn("multi_call", F.expr("call_index > 0")))

    @cached_property
    def coherence_raw(self) -> DataFrame:
        """One raw coherence reply per conversation; some leaves are text, missing or out of range."""
        convs = self.read("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
        return convs.selectExpr(
            "conv_id",
            "CAST(1 + conv_id % 3 AS STRING) AS logical_flow",
            "CASE conv_id % 7 WHEN 0 THEN 'bad' WHEN 1 THEN NULL WHEN 2 THEN 'NaN' WHEN 3 THEN '7' WHEN 4 THEN '2.5'"
            " WHEN 5 THEN 'true' ELSE '-1' END AS completeness",
            "CAST(1 + turns % 3 AS STRING) AS conciseness",
            "CASE WHEN conv_id % 11 = 0 THEN 'Infinity' ELSE '3' END AS topic_relevance",
            "turns < 3 AS retention_na",
            "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE CAST(1 + conv_id % 2 AS STRING) END AS context_retention",
        )

    # ---- chains ---------------------------------------------------------------------

    @cached_property
    def call_io(self) -> DataFrame:
        at = lambda shift: f"concat('gs://b/', transcript_id, '/', call_index + {shift}, '.png')"
        return self.call_order.selectExpr(
            "call_id", "transcript_id", "call_index", "tool_name", "fault_no",
            # Some calls write again what an earlier call wrote.
            f"CASE WHEN fault_no = 3 AND call_index > 1 THEN {at(-2)} ELSE {at(0)} END AS produced_uri",
            f"CASE WHEN fault_no = 7 THEN 'gs://b/none.png' WHEN fault_no = 9 THEN {at(1)}"
            f" WHEN call_index > 0 THEN {at(-1)} END AS consumed_uri",
            "CASE WHEN fault_no = 2 THEN '21:9' ELSE '16:9' END AS aspect_ratio",
        )

    @cached_property
    def produced(self) -> DataFrame:
        return self.call_io.withColumnRenamed("produced_uri", "uri").drop("consumed_uri")

    @cached_property
    def consumed(self) -> DataFrame:
        return self.call_io.withColumnRenamed("consumed_uri", "uri").drop("produced_uri").where("uri IS NOT NULL")

    @cached_property
    def tool_needs(self) -> DataFrame:
        rows = [("av_combine", "vid_generate"), ("av_combine", "music_generate"), ("vid_from_image", "img_generate")]
        return literal_table(self.spark, rows, "tool_name string, needs_tool string")

    @cached_property
    def expected_steps(self) -> DataFrame:
        kept = self.call_order.where("fault_no <> 19").selectExpr(
            "transcript_id", "call_index AS step_index",
            "CASE WHEN tool_name = 'media_unknown' THEN 'img_generate' ELSE tool_name END AS tool_name",
        )
        # The index of the extra last step is the number of calls: no ordering needed.
        extra = (
            self.call_keys.where("transcript_id % 5 = 0")
            .groupBy("transcript_id")
            .agg(F.count("*").cast("int").alias("step_index"))
            .withColumn("tool_name", F.lit("av_combine"))
        )
        return kept.unionByName(extra)

    # ---- a registry that grows with the data: one tool per part ------------------------

    @cached_property
    def spec_tools(self) -> DataFrame:
        return self.spread("part", "p_partkey").selectExpr(
            "CASE WHEN p_partkey % 97 = 0 THEN concat('solo_', p_partkey) ELSE p_brand END AS server",
            "concat('tool_', p_partkey) AS tool_name",
            "p_partkey AS tool_pos",
            "CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS description",
        )

    @cached_property
    def spec_params(self) -> DataFrame:
        rows = (
            "stack(6, 0, 'prompt', 'string', true, false, true,"
            " 1, 'image_uri', 'string', p_partkey % 3 = 0, false, true,"
            " 2, 'style', 'string', p_partkey % 4 = 0, true, p_partkey % 2 = 0,"
            " 3, 'count', 'integer', p_partkey % 5 = 0, false, p_partkey % 3 <> 1,"
            " 4, 'hd', 'boolean', p_partkey % 6 = 0, false, true,"
            " 5, 'tags', 'array', p_partkey % 7 = 0, false, p_partkey % 5 <> 2)"
            " AS (param_pos, param_name, param_type, required, listed, there)"
        )
        return (
            self.spread("part", "p_partkey")
            .where("p_partkey % 13 <> 0")
            .selectExpr("concat('tool_', p_partkey) AS tool_name", rows)
            .where("there")
            .selectExpr(
                "tool_name", "param_pos", "param_name", "param_type", "required",
                "CASE WHEN listed THEN array('\"draft\"', '\"final\"') END AS enum",
            )
        )

    @cached_property
    def spec_seeds(self) -> DataFrame:
        return self.read("part").where("p_partkey % 2 = 0").selectExpr(
            "concat('tool_', p_partkey) AS tool_name", "concat('{\"uri\":\"gs://b/', p_partkey, '.png\"}') AS example_output"
        )
