"""Registered queries against their SQL, and the shape of their plans."""

from __future__ import annotations

import contextlib
import io
import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from callgauge.operators import prompts
from callgauge.plans import catalog
from callgauge.plans.fixtures import SPREAD_ROWS, Tables
from tests.conftest import SF
from tools.check import compare, duck

SAMPLE = (
    "lint_summary", "lint_all", "violation_messages", "call_normalize", "lint_malformed", "penalty_collapse", "tc_score", "judge_spearman",
    "discrimination_summary", "worst_cases", "evaluation_report", "turn_pairs", "uri_grounding", "oracle_diff", "parallel_levels",
    "scenarios_complex", "multi_turn_expand", "fault_injection", "json_extract_kinds", "judge_prompts", "param_catalog", "results_sink", "evaluate_replies",
)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    note, fine = compare(spark, duck(SF), name, contract.queries()[name], contract.oracle_sql()[name], SF)
    assert fine, note


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ("lint_summary", "lint_all", "penalty_collapse", "uri_provenance", "order_violations"))
def test_plan_shape(spark, name):
    out = io.StringIO()
    frame = contract.queries()[name](spark, SF)
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    plan = out.getvalue()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name.startswith("lint"):
        assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", ("lint_summary", "lint_all", "lint_cap_tool", "lint_capability_rules", "violations_by_rule", "fault_injection", "tc_score"))
def test_generated_methods_can_be_compiled(spark, name):
    """The JVM leaves methods above 8000 bytes uncompiled, which makes a query several times slower."""
    out = io.StringIO()
    frame = contract.queries()[name](spark, SF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(out):
            frame.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert max(sizes, default=0) < 7500


def test_texts_of_many_rows_are_whole(spark):
    calls = spark.range(2501).selectExpr("7L AS transcript_id", "id AS call_index", "concat('t', id) AS tool_name", "'{}' AS arguments")
    row = prompts.call_lists(calls).collect()
    assert len(row) == 1 and row[0].n == 2501
    assert row[0].text == ",\n".join(f'{{"name":"t{i}","arguments":{{}}}}' for i in range(2501))


def test_spec_json_survives_quotes(spark):
    rows = spark.sql("""SELECT 's' AS server, 'a"b' AS tool_name, 0 AS tool_pos, 'say "x"\nand \\\\ go' AS description,
        array(named_struct('param_pos', 0, 'param_name', 'p"q', 'param_type', 'string', 'required', true, 'enum', array('"u"', '1'))) AS args""")
    made = json.loads(prompts.spec_json(rows).collect()[0].spec)
    assert made["name"] == 'a"b' and made["description"].startswith('say "x"\n') and made["inputSchema"]["required"] == ['p"q']
    assert made["inputSchema"]["properties"] == {'p"q': {"type": "string", "enum": ["u", 1]}}


def test_rows_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path):
    """A file of many splits may hold all its rows in one row group, which one split reads."""
    spark.range(200_000).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        dealt = Tables(spark, str(tmp_path)).spread("events", "event_id")
        most = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert most <= 1.1 * SPREAD_ROWS
