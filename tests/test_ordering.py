"""Skewed keys: one key owns most rows."""

from __future__ import annotations

import contextlib
import io
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from callgauge.operators import generation, judges, ordering
from callgauge.operators.dims import is_small, join_spec
from callgauge.operators.ordering import number_slice, with_next, with_position

random.seed(7)
ROWS = [(0, t, random.randrange(1000)) for t in range(900)] + [(k, t * 37, 5) for k in range(1, 60) for t in range(5)]


def frame(spark):
    rows = ROWS[:]
    random.shuffle(rows)
    return spark.createDataFrame(rows, "k int, t int, v int")


def test_position(spark):
    got = {(r.k, r.t): r.at for r in with_position(frame(spark), ["k"], ["t"], number_slice("t", 16), "at").collect()}
    keys = {k for k, _, _ in ROWS}
    want = {(k, t): i for k in keys for i, (_, t, _) in enumerate(sorted(r for r in ROWS if r[0] == k))}
    assert got == want


def test_next(spark):
    got = {(r.k, r.t): r.next_v for r in with_next(frame(spark), ["k"], "t", number_slice("t", 16), ["v"]).collect()}
    want = {}
    for k in {k for k, _, _ in ROWS}:
        line = sorted(r for r in ROWS if r[0] == k)
        for here, after in zip(line, [*line[1:], None]):
            want[(k, here[1])] = after[2] if after else None
    assert got == want


def test_no_task_gets_a_whole_key(spark):
    plan = with_position(frame(spark), ["k"], ["t"], number_slice("t", 16), "at")
    sizes = plan.groupBy("k", F.floor(F.col("t") / 16)).count().agg(F.max("count")).first()[0]
    assert sizes <= 16


def test_salted_join_equals_broadcast(spark):
    spec = spark.createDataFrame([(i, f"n{i}") for i in range(0, 60, 2)], "k int, name string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = sorted(map(str, join_spec(frame(spark), spec, ["k"], how, small=True).collect()))
        b = sorted(map(str, join_spec(frame(spark), spec, ["k"], how, small=False).collect()))
        assert a == b
    assert is_small(spec) and not is_small(spec, 10)


def test_a_burst_of_one_key_is_cut_evenly(spark):
    # 60,000 calls of one key in one second, half of them at the very same time; a null time; light keys beside it.
    rows = spark.range(60_000).selectExpr(
        "0 AS k", "CASE WHEN id % 2 = 0 THEN timestamp'2024-01-01 00:00:00.5' ELSE timestampadd(MICROSECOND, id, timestamp'2024-01-01 00:00:00') END AS t", "(id * 7919) % 60000 AS v"
    )
    light = spark.range(300).selectExpr("1 + id % 9 AS k", "timestampadd(HOUR, CAST(id AS INT), timestamp'2024-01-01 00:00:00') AS t", "id AS v")
    odd = spark.sql("SELECT 0 AS k, CAST(NULL AS timestamp) AS t, 99999999L AS v")
    rows = rows.union(light).union(odd)
    cut = ordering.with_even_slices(rows, ["k"], ["t", "v"], most=1000)
    sizes = [r.n for r in cut.where("k = 0").groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 32 and max(sizes) <= 2000
    assert {tuple(r[0]) for r in cut.where("k > 0").select("_slice").distinct().collect()} == {(0, 0)}
    placed = ordering.with_position(rows, ["k"], ["t", "v"], None, "at", most=1000)
    plain = rows.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("t", "v")) - 1)
    assert placed.join(plain.drop("t"), ["k", "v"]).where("at <> want").count() == 0 and placed.count() == 60_301
    assert placed.columns == ["k", "t", "v", "at"]


def test_ranks_of_values_of_any_range(spark):
    values = spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN -pow(1.001, id % 9000) ELSE 1e6 * sin(id) + id % 7 END AS x")
    got = {r.x: r.rank_x for r in judges.average_rank(values, "x", bounded=False).collect()}
    listed = sorted(r.x for r in values.collect())
    want, i = {}, 0
    while i < len(listed):
        j = i
        while j < len(listed) and listed[j] == listed[i]:
            j += 1
        want[listed[i]] = (i + 1 + j) / 2
        i = j
    assert got == want
    counts = values.groupBy("x").count()
    sizes = [r.n for r in counts.groupBy(ordering.value_slice(counts, "x").alias("s")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 200 and max(sizes) <= 4 * sorted(sizes)[len(sizes) // 2]
    both = values.selectExpr("x AS tc_a", "-pow(x / 1e6, 3) AS tc_b")
    assert judges.spearman(both, four_decimals=False).first().spearman == -1
    placed = judges.ranking(spark.createDataFrame([(-5.0,), (7.5,), (7.5,), (1e9,)], "x double"), "x", "place")
    assert sorted((r.x, r.place) for r in placed.collect()) == [(-5.0, 4), (7.5, 2), (7.5, 2), (1e9, 1)]
    assert judges.average_rank(values.limit(0), "x", bounded=False).count() == 0


def test_joins_of_files_that_only_look_small_are_not_broadcast(spark, tmp_path):
    """A file of a few bytes may hold, behind a generator, more rows than the driver can."""
    spark.range(5000).selectExpr("concat('t', id) AS tool_name", "'s' AS server", "id AS tool_pos").write.parquet(f"{tmp_path}/tools")
    tools = spark.read.parquet(f"{tmp_path}/tools")
    params = tools.selectExpr("tool_name", "explode(sequence(1, 6)) AS param_pos", "'p' AS param_name", "'string' AS param_type", "true AS required", "CAST(NULL AS array<string>) AS enum")
    rows = generation.tool_rows(tools, params)
    joined = join_spec(rows, tools.select("tool_name", "tool_pos"), ["tool_name"], "left", small=False)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        joined.explain()
    assert "Broadcast" not in out.getvalue()
    assert joined.count() == 5000
