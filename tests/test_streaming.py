from __future__ import annotations

import datetime
import random

from callgauge.operators import lint
from callgauge.streaming import live
from tests import registry

SCHEMA = "call_id bigint, transcript_id bigint, tool_name string, arguments string, ts timestamp"


def test_stream_over_several_batches_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, "clip_text" if i % 4 else "nobody", '{"prompt":"p"}' if i % 5 else "{}", f"2024-01-01 {i % 24:02d}:00:00") for i in range(96)]
    whole = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).selectExpr("* EXCEPT (ts)", "CAST(ts AS timestamp) AS ts")
    source = str(tmp_path / "in")
    whole.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    live.lint_stream(stream, registry.spec(spark), good, bad, str(tmp_path / "state")).awaitTermination()
    want = lint.violations(whole, registry.spec(spark))
    assert spark.read.parquet(bad).count() == want.count()
    assert spark.read.parquet(good).count() == whole.count() - want.select("call_id").distinct().count()

    counts = live.rule_counts(stream, registry.spec(spark), "2 days", "6 hours")
    live.write_updates(counts, str(tmp_path / "counts"), str(tmp_path / "state2")).awaitTermination()
    got = live.latest(spark.read.parquet(str(tmp_path / "counts")), ["window", "rule_id"], ["n"])
    assert got.groupBy().sum("n").first()[0] == want.count()


def test_out_of_order_write_is_no_false_alarm(spark, tmp_path):
    rows = [
        (1, "a", 1, "2024-01-01 10:00:00", False),
        (1, "a", 2, "2024-01-01 09:00:00", True),
        (1, "b", 3, "2024-01-01 10:00:00", False),
        (1, "b", 4, "2024-01-01 10:30:00", True),
        (1, "z", 9, "2024-01-05 00:00:00", True),
    ]
    names = ["transcript_id", "uri", "call_id", "ts", "writes"]
    source = str(tmp_path / "in")
    for row in rows:
        spark.createDataFrame([row], names).selectExpr("transcript_id", "uri", "call_id", "CAST(ts AS timestamp) AS ts", "writes").write.mode("append").parquet(source)
    stream = spark.readStream.schema("transcript_id bigint, uri string, call_id bigint, ts timestamp, writes boolean").parquet(source)
    out = live.dangling_stream(stream, "2 hours").writeStream.format("parquet").outputMode("append")
    out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert [r.call_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3]


def test_an_old_write_is_forgotten(spark, tmp_path):
    rows = [
        (1, "a", 1, "2024-01-01 00:00:00", True),
        (1, "z", 2, "2024-01-06 00:00:00", True),
        (1, "z", 3, "2024-01-06 01:00:00", True),
        (1, "a", 4, "2024-01-07 00:00:00", False),
        (1, "z", 5, "2024-01-09 00:00:00", False),
        (1, "z", 6, "2024-01-20 00:00:00", True),
    ]
    names = ["transcript_id", "uri", "call_id", "ts", "writes"]
    source = str(tmp_path / "in")
    for row in rows:
        spark.createDataFrame([row], names).selectExpr("transcript_id", "uri", "call_id", "CAST(ts AS timestamp) AS ts", "writes").write.mode("append").parquet(source)
    schema = "transcript_id bigint, uri string, call_id bigint, ts timestamp, writes boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = live.dangling_stream(stream, "2 hours", keep_days=4).writeStream.format("parquet").outputMode("append")
    out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert [r.call_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [4]


def run_dangling(spark, tmp_path, batches, keep_days):
    names = ["transcript_id", "uri", "call_id", "ts", "writes"]
    source = str(tmp_path / "in")
    for rows in batches:
        made = spark.createDataFrame(rows, names).selectExpr("transcript_id", "uri", "call_id", "CAST(ts AS timestamp) AS ts", "writes")
        made.coalesce(1).write.mode("append").parquet(source)
    schema = "transcript_id bigint, uri string, call_id bigint, ts timestamp, writes boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = live.dangling_stream(stream, "2 hours", keep_days=keep_days).writeStream.format("parquet").outputMode("append")
    out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return sorted(r.call_id for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_later_write_is_not_forgotten_with_the_first(spark, tmp_path):
    day = lambda n, time="00:00:00": f"2024-01-{n + 1:02d} {time}"
    batches = [
        [(1, "a", 1, day(0), True)],
        [(1, "a", 2, day(6), True)],
        [(1, "z", 3, day(7, "12:00:00"), True)],
        [(1, "a", 4, day(8), False), (1, "b", 5, day(8), False)],
        [(1, "z", 6, day(12, "23:00:00"), True), (1, "a", 7, day(13, "00:00:00"), False)],
        [(1, "a", 8, day(13, "00:00:01"), False)],
        [(1, "z", 9, day(25), True)],
    ]
    assert run_dangling(spark, tmp_path, batches, 7) == [5, 8]


def test_many_writes_and_reads_equal_a_plain_history(spark, tmp_path):
    draw = random.Random(9)
    begin = datetime.datetime(2024, 1, 1)
    rows = []
    for call_id in range(400):
        # Some calls share a time to the millisecond, or altogether.
        at = begin + datetime.timedelta(hours=draw.randrange(200), milliseconds=draw.randrange(2), microseconds=draw.choice([0, 1, 999]))
        rows.append((draw.randrange(2), draw.choice("ab"), call_id, at, draw.random() < 0.3))
    rows.sort(key=lambda r: r[3])
    batches, last = [], [(9, "z", 999, begin + datetime.timedelta(days=60), True)]
    for i in range(0, len(rows), 80):
        batches.append([(*r[:3], r[3].isoformat(sep=" "), r[4]) for r in rows[i : i + 80]])
    batches.append([(*r[:3], r[3].isoformat(sep=" "), r[4]) for r in last])
    keep = datetime.timedelta(days=1)
    want = []
    for t, uri, call_id, at, writes in rows:
        if not writes and not any(w[:2] == (t, uri) and w[4] and w[3] < at <= w[3] + keep for w in rows):
            want.append(call_id)
    assert run_dangling(spark, tmp_path, batches, 1) == sorted(want)


def test_state_grows_with_groups_not_with_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "GROUPS", 8, raising=False)
    at = "CAST('2024-01-01' AS timestamp) + make_interval(0, 0, 0, 0, 0, 0, id % 500)"
    rows = spark.range(2000).selectExpr("id div 2 AS transcript_id", "concat('u', id % 3) AS uri", "id AS call_id", f"{at} AS ts", "id % 2 = 0 AS writes")
    lone = spark.sql("SELECT CAST(NULL AS bigint) AS transcript_id, 'u' AS uri, 9000L AS call_id, TIMESTAMP '2024-01-01' AS ts, false AS writes")
    source = str(tmp_path / "in")
    rows.unionByName(lone).write.parquet(source)
    spark.sql("SELECT 1L AS transcript_id, 'z' AS uri, -1L AS call_id, TIMESTAMP '2024-01-02' AS ts, true AS writes").write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    out = live.dangling_stream(stream, "2 hours").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
    query = out.trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    # A call with an odd number reads a file that only calls of another transcript or another name wrote.
    assert sorted(r.call_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [*range(1, 2000, 2), 9000]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 8 * 6
