"""Checks across the calls of one transcript: URI provenance, settings, order, repeats, depth.

Every join is an equi-join on (transcript, URI) or (transcript, tool) against a
side reduced to one row per key, so no pairs are listed inside a transcript.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgauge.functions.variants import kind
from callgauge.operators.dims import BROADCAST_ROWS, join_spec
from callgauge.session import saved

KEY = ["transcript_id", "uri"]


SLICE_CALLS = 256


def provenance(consumed: DataFrame, produced: DataFrame, carried: list[str]) -> DataFrame:
    """Each read URI with the last call before it that wrote it; ``producer_*`` is NULL when no earlier call did.

    Writes and reads of a URI are walked in call order in slices of the order, and each slice starts from the last write
    of the slices before it (one row per URI and slice), so a URI with very many reads is not one task's work. Of
    several writes in one call any one stands; a call's own writes come after its reads.
    """
    wrote = F.struct("call_index", *carried)
    slice_of = F.floor(F.col("call_index") / SLICE_CALLS).cast("bigint")
    keyed = [*KEY, "_slice"]
    writes = produced.select(*KEY, "call_index", wrote.alias("_wrote"), F.lit(1).alias("_turn")).withColumn("_slice", slice_of)
    reads = consumed.select(*KEY, "call_index", F.struct(*consumed.columns).alias("_read"), F.lit(0).alias("_turn")).withColumn("_slice", slice_of)
    before = Window.partitionBy(*KEY).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # Slices with reads or writes: each knows the last write of the slices before it.
    both = reads.unionByName(writes, allowMissingColumns=True)
    heads = both.groupBy(*keyed).agg(F.max_by("_wrote", F.when(F.col("_wrote").isNotNull(), F.col("call_index"))).alias("_tail"))
    heads = heads.withColumn("_before", F.last("_tail", ignorenulls=True).over(before)).drop("_tail")
    inside = Window.partitionBy(*keyed).orderBy("call_index", "_turn").rowsBetween(Window.unboundedPreceding, -1)
    walked = both.withColumn("_inside", F.last("_wrote", ignorenulls=True).over(inside)).where("_read IS NOT NULL")
    joined = walked.join(heads, keyed).withColumn("_from", F.coalesce("_inside", "_before"))
    names = {"producer_index": "call_index", **{f"producer_{c}": c for c in carried}}
    return joined.select("_read.*", *[F.col(f"_from.{c}").alias(n) for n, c in names.items()])


def dangling(consumed: DataFrame, produced: DataFrame) -> DataFrame:
    """Reads of a URI that no earlier call wrote."""
    return provenance(consumed, produced, []).where("producer_index IS NULL").drop("producer_index")


def setting_mismatch(consumed: DataFrame, produced: DataFrame, setting: str) -> DataFrame:
    """Reads whose own setting differs from that of the call that wrote the URI."""
    linked = provenance(consumed, produced, [setting])
    return linked.where(F.col(setting) != F.col(f"producer_{setting}"))


def input_mismatch(consumed: DataFrame, produced: DataFrame, settings: list[str]) -> DataFrame:
    """Calls that read several URIs whose producers disagree on a setting."""
    linked = provenance(consumed, produced, settings).where("producer_index IS NOT NULL")
    spread = [f"{f}(producer_{s}) AS {f}_{s}" for s in settings for f in ("min", "max")]
    per_call = linked.groupBy("transcript_id", "call_index").agg(*[F.expr(e) for e in spread])
    return per_call.where(" OR ".join(f"min_{s} <> max_{s}" for s in settings))


def order_violations(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """Calls of a tool before the first call of a tool it needs.

    ``needs`` is a fixed list of (tool_name, needs_tool). (ts, call_id) is the order,
    so no index has to be worked out. state: late (it comes later) or never.
    """
    first = calls.groupBy("transcript_id", F.col("tool_name").alias("needs_tool")).agg(
        F.min(F.struct("ts", "call_id")).alias("first_at")
    )
    asking = calls.join(F.broadcast(needs), "tool_name")
    linked = asking.join(first, ["transcript_id", "needs_tool"], "left")
    bad = linked.where("first_at IS NULL OR first_at > struct(ts, call_id)")
    return bad.selectExpr(
        "transcript_id", "call_id", "tool_name", "needs_tool", "CASE WHEN first_at IS NULL THEN 'never' ELSE 'late' END AS state"
    )


def canonical(arguments: str) -> str:
    """Argument text with sorted keys, so equal arguments have equal text."""
    return f"to_json(parse_json({arguments}))"


def redundant_calls(calls: DataFrame) -> DataFrame:
    """Same tool with the same arguments more than once in a transcript."""
    marked = calls.withColumn("args_hash", F.expr(f"md5({canonical('arguments')})"))
    repeats = marked.groupBy("transcript_id", "tool_name", "args_hash").agg(F.count("*").alias("n"), F.min("call_id").alias("first_call"))
    return repeats.where("n > 1")


def mock_lookup(calls: DataFrame, mocks: DataFrame) -> DataFrame:
    """Prepared output for each call with the same tool and the same arguments."""
    hashed = lambda d: d.withColumn("args_hash", F.expr(f"md5({canonical('arguments')})")).drop("arguments")
    unique = hashed(mocks).groupBy("tool_name", "args_hash").agg(F.min("mock_output").alias("mock_output"))
    # Agents repeat themselves, so one argument set may be most of the calls.
    found = join_spec(hashed(calls), unique, ["tool_name", "args_hash"], "left", spread="call_id")
    return found.drop("args_hash").withColumn("matched", F.col("mock_output").isNotNull())


def workflow_diff(expected: DataFrame, emitted: DataFrame) -> DataFrame:
    """Held-out steps against emitted calls, step by step."""
    e = expected.selectExpr("transcript_id", "step_index", "tool_name AS expected_tool")
    g = emitted.selectExpr("transcript_id", "call_index AS step_index", "tool_name AS called_tool")
    return e.join(g, ["transcript_id", "step_index"], "full").selectExpr(
        "*",
        "CASE WHEN called_tool IS NULL THEN 'missing' WHEN expected_tool IS NULL THEN 'extra'"
        " WHEN expected_tool = called_tool THEN 'match' ELSE 'wrong_tool' END AS status",
    )


def tool_set_diff(expected: DataFrame, emitted: DataFrame) -> DataFrame:
    """Per (transcript, tool): expected and called, expected only, or called only."""
    e = expected.selectExpr("transcript_id", "tool_name", "true AS want", "false AS got")
    g = emitted.selectExpr("transcript_id", "tool_name", "false AS want", "true AS got")
    both = e.unionByName(g).groupBy("transcript_id", "tool_name").agg(F.bool_or("want").alias("want"), F.bool_or("got").alias("got"))
    return both.selectExpr(
        "transcript_id", "tool_name", "CASE WHEN want AND got THEN 'both' WHEN want THEN 'not_called' ELSE 'not_expected' END AS status"
    )


# ---- dependency depth -------------------------------------------------------------


# How many pointers a round may make for each node and edge of the graph; beyond that only single ones are followed.
GROWTH = 4
MERGED_ROUNDS = 32
CYCLE = "the dependencies hold a cycle"


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Depth of each call in the dependency graph (its longest path to a root); calls of one level can run together.

    nodes: transcript_id, node; edges: transcript_id, node, parent. Edges to or from something that is no node are ignored,
    repeated ones count once.

    Paths are doubled in max-plus arithmetic: a node keeps, for each ancestor it points at, the longest path there, and
    the longest path that has reached a root. A round replaces each pointer by those of the ancestor, so paths
    that join again are one pointer, and a graph of depth d is done in about log2(d) rounds however chains and diamonds
    alternate. Where that would make more pointers than ``GROWTH`` times the graph's size (wide, tangled graphs), a
    round ends the pointers to finished nodes, which then leave, and follows only single pointers: that makes none. Each
    round finishes at least the open nodes nearest to the roots, or there is a cycle, which is an error. Rounds end in a
    table in the shared folder.
    """
    ends = ["transcript_id", "node"]
    nodes = saved(nodes.select(*ends).distinct(), "graph-nodes")
    kind = nodes.schema["node"].dataType.simpleString()
    edges = edges.select(*ends, "parent").distinct().join(nodes, ends, "left_semi")
    edges = saved(edges.join(nodes.withColumnRenamed("node", "parent"), ["transcript_id", "parent"], "left_semi"), "graph-edges")
    roots = nodes.join(edges, ends, "left_anti").selectExpr(*ends, f"CAST(NULL AS {kind}) AS up", "0 AS far")
    # A row is a pointer (up, longest path to it), or, without up, the longest path that ends at a root.
    state = saved(edges.selectExpr(*ends, f"CAST(parent AS {kind}) AS up", "1 AS far").unionByName(roots), "pointers")
    done: list[DataFrame] = []
    most = open_before = None
    while True:
        per_node = state.groupBy(*ends).agg(F.count("*").alias("n"), F.count("up").alias("pointers"))
        rows, widest, still_open = per_node.agg(F.sum("n"), F.max("n"), F.count_if(F.col("pointers") > 0)).first()
        if not still_open:
            return reduce(DataFrame.unionByName, [*done, state.selectExpr(*ends, "far AS level")])
        if still_open == open_before:
            raise ValueError(CYCLE)
        open_before, most = still_open, most or GROWTH * rows
        small = rows <= BROADCAST_ROWS
        if widest > 1 and _after_doubling(state, per_node, small) > most:
            ended = state.join(per_node.where("pointers = 0"), ends, "left_semi").selectExpr(*ends, "far AS level")
            ended = saved(ended, "levels")
            done.append(ended)
            if len(done) == MERGED_ROUNDS:
                done = [saved(reduce(DataFrame.unionByName, done), "levels")]
            left = join_spec(state, ended.withColumnRenamed("node", "up"), ["transcript_id", "up"], "left", small, "node")
            left = left.join(ended.select(*ends), ends, "left_anti")
            state = _longest(left.selectExpr(*ends, "CASE WHEN level IS NULL THEN up END AS up", "far + coalesce(level, 0) AS far"))
            single = state.groupBy(*ends).count().where("count = 1")
            state = _followed(state, state.join(single, ends, "left_semi"), small)
        else:
            state = _followed(state, state, small)


def _after_doubling(state: DataFrame, per_node: DataFrame, small: bool) -> int:
    """How many rows there would be if each pointer were replaced by all of its ancestor's (before equal ones are merged)."""
    held = per_node.selectExpr("transcript_id", "node AS up", "n")
    met = join_spec(state.where("up IS NOT NULL"), held, ["transcript_id", "up"], "inner", small, "node")
    return met.agg(F.sum("n")).first()[0] or 0


def _followed(state: DataFrame, through: DataFrame, small: bool) -> DataFrame:
    """``state`` with the pointers to nodes of ``through`` replaced by the rows of these nodes; of equal pointers the longest stays."""
    above = through.selectExpr("transcript_id", "node AS up", "up AS next_up", "far AS more")
    met = join_spec(state, above, ["transcript_id", "up"], "left", small, "node")
    return _longest(met.selectExpr("transcript_id", "node", "CASE WHEN more IS NULL THEN up ELSE next_up END AS up", "far + coalesce(more, 0) AS far"))


def _longest(state: DataFrame) -> DataFrame:
    return saved(state.groupBy("transcript_id", "node", "up").agg(F.max("far").alias("far")), "pointers")


# ---- reading what calls write and read out of their arguments -----------------------

PREFIX_PARAMS = ("bucket", "gcs_bucket_uri", "output_gcs_bucket")
FILE_PARAM = "output_filename"
READ_PARAMS = ("image_uri", "video_uri", "input_audio_uri", "input_video_uri", "first_image_uri", "last_image_uri", "images")


def normal_prefix(text: str) -> str:
    """``mybucket``, ``gs://mybucket`` and ``gs://mybucket/`` are one prefix."""
    return f"concat('gs://', trim(TRAILING '/' FROM regexp_replace({text}, '^gs://', '')), '/')"


def call_uris(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(written, read) of calls with transcript_id, call_index and arguments.

    written: prefix and, where a file name is declared, uri. read: one row per URI,
    arrays taken apart.
    """
    parsed = calls.selectExpr("transcript_id", "call_index", "parse_json(coalesce(arguments, '{}')) AS a")
    parsed = parsed.selectExpr("transcript_id", "call_index", f"CASE WHEN {kind('a')} = 'OBJ' THEN a END AS a")
    text = lambda p: f"nullif(try_variant_get(a, '$.{p}', 'string'), '')"
    first = f"coalesce({', '.join(text(p) for p in PREFIX_PARAMS)})"
    # A filter right on ``raw`` would be pushed below the parse and repeat it; behind
    # the outer generator it stays where it is.
    written = (
        parsed.selectExpr("transcript_id", "call_index", f"{first} AS raw", f"{text(FILE_PARAM)} AS file")
        .selectExpr("transcript_id", "call_index", "inline_outer(array(struct(raw, file)))")
        .where("raw IS NOT NULL")
        .selectExpr("transcript_id", "call_index", f"{normal_prefix('raw')} AS prefix", "file")
        .selectExpr("*", "concat(prefix, file) AS uri")
    )
    each = calls.sparkSession.tvf.variant_explode(F.col("a").outer()).selectExpr("key", "value AS v")
    one = f"CASE {kind('v')} WHEN 'STR' THEN array(CAST(v AS STRING)) WHEN 'ARR' THEN CAST(v AS array<string>) END"
    read = parsed.lateralJoin(each).where(F.col("key").isin(*READ_PARAMS))
    return written, read.selectExpr("transcript_id", "call_index", f"explode({one}) AS uri").where("uri <> ''")


def ungrounded(calls: DataFrame, prompts: DataFrame) -> DataFrame:
    """Read URIs that nothing accounts for.

    A URI is accounted for when the prompt names it, when an earlier call declares
    exactly this file, or when it lies under the output prefix of an earlier call
    that declares no file name.
    """
    written, read = call_uris(calls)
    named = written.where("file IS NOT NULL").groupBy(*KEY).agg(F.min("call_index").alias("file_at"))
    open_prefix = written.where("file IS NULL").groupBy("transcript_id", "prefix").agg(F.min("call_index").alias("prefix_at"))
    # Every folder above the URI, so that "lies under" is an equi-join.
    split = read.where("startswith(uri, 'gs://')").selectExpr("*", "split(substring(uri, 6), '/') AS folders")
    above = split.selectExpr(
        "transcript_id", "call_index", "uri", "folders", "explode(sequence(1, greatest(size(folders) - 1, 1))) AS n"
    ).selectExpr(
        "transcript_id", "call_index", "uri", "concat('gs://', array_join(slice(folders, 1, n), '/'), '/') AS prefix"
    )
    under = (
        above.join(open_prefix, ["transcript_id", "prefix"])
        .where("prefix_at < call_index")
        .select("transcript_id", "call_index", "uri")
        .distinct()
        .withColumn("under", F.lit(True))
    )
    linked = (
        read.distinct()
        .join(named, KEY, "left")
        .join(under, ["transcript_id", "call_index", "uri"], "left")
        .join(prompts.select("transcript_id", "prompt"), "transcript_id", "left")
    )
    return linked.where(
        "NOT coalesce(file_at < call_index, false) AND under IS NULL AND NOT coalesce(contains(prompt, uri), false)"
    ).select("transcript_id", "call_index", "uri")
