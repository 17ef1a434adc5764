"""Streaming checks over the events file, run to its end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.plans.fixtures import Tables
from callgauge.plans.registry import CTES, query
from callgauge.session import scratch_path
from callgauge.streaming import live

DELAY = "2 hours"


def _out(t: Tables, name: str) -> tuple[str, str]:
    base = scratch_path(t.spark, name)
    return f"{base}/rows", f"{base}/state"


def _append(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to its end into files, and read them."""
    path, checkpoint = _out(t, name)
    run = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    run.trigger(availableNow=True).start(path).awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(path)


@query(
    "stream_lint",
    """
SELECT 'accepted' AS sink, transcript_id, count(*) AS n FROM calls WHERE call_id NOT IN (SELECT call_id FROM violations) GROUP BY transcript_id
UNION ALL SELECT 'rejected', transcript_id, count(*) FROM violations GROUP BY transcript_id
""",
)
def stream_lint(t: Tables) -> DataFrame:
    (good, checkpoint), (bad, _) = _out(t, "accepted"), _out(t, "rejected")
    live.lint_stream(t.stream_calls, t.media_spec, good, bad, checkpoint).awaitTermination()
    out = None
    for sink, path in (("accepted", good), ("rejected", bad)):
        counted = t.spark.read.parquet(path).groupBy("transcript_id").agg(F.count("*").alias("n")).withColumn("sink", F.lit(sink))
        out = counted if out is None else out.unionByName(counted)
    return out.select("sink", "transcript_id", "n")


CTES["timed_violations"] = "SELECT v.rule_id, c.ts FROM violations v JOIN (SELECT call_id, ts FROM calls) c USING (call_id)"


@query(
    "stream_rule_counts",
    "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, rule_id, count(*) AS n FROM timed_violations GROUP BY ALL",
)
def stream_rule_counts(t: Tables) -> DataFrame:
    path, checkpoint = _out(t, "rule-counts")
    live.write_updates(live.rule_counts(t.stream_calls, t.media_spec, DELAY, "1 hour"), path, checkpoint).awaitTermination()
    counts = live.latest(t.spark.read.parquet(path), ["window", "rule_id"], ["n"])
    return counts.selectExpr("unix_timestamp(window.start) AS window_start", "rule_id", "n")


@query(
    "stream_sliding_counts",
    "SELECT CAST(epoch(date_trunc('hour', ts)) - s * 3600 AS BIGINT) AS window_start, rule_id, count(*) AS n FROM timed_violations, (VALUES (0), (1)) v(s) GROUP BY ALL",
)
def stream_sliding_counts(t: Tables) -> DataFrame:
    path, checkpoint = _out(t, "sliding-counts")
    live.write_updates(live.rule_counts(t.stream_calls, t.media_spec, DELAY, "2 hours", "1 hour"), path, checkpoint).awaitTermination()
    counts = live.latest(t.spark.read.parquet(path), ["window", "rule_id"], ["n"])
    return counts.selectExpr("unix_timestamp(window.start) AS window_start", "rule_id", "n")


@query(
    "stream_sessions",
    """
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS n_calls FROM (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
  FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events))
GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOURS < (SELECT max(ts) FROM events) - INTERVAL 2 HOURS
""",
)
def stream_sessions(t: Tables) -> DataFrame:
    """Closed sessions only: the last ones are still open when the stream ends."""
    users = t.stream_calls.withColumn("user_id", F.expr("transcript_id div 100"))
    done = _append(t, live.sessions(users, ["user_id"], DELAY, "6 hours"), "sessions")
    return done.selectExpr("user_id", "unix_timestamp(started) AS started", "n_calls")


@query("stream_dedup", "SELECT event_id AS call_id FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Every third call is delivered twice."""
    twice = t.stream_calls.withColumn("copy", F.expr("explode(CASE WHEN call_id % 3 = 0 THEN array(1, 2) ELSE array(1) END)"))
    return _append(t, live.drop_repeats(twice, DELAY), "dedup").select("call_id")


CTES["stream_uris"] = """
SELECT call_id, transcript_id, ts, tool_name AS writes, CASE tool_name WHEN 'vid_from_image' THEN 'img_generate' WHEN 'av_combine' THEN 'vid_generate' END AS reads FROM calls
"""


@query(
    "stream_dangling",
    """
SELECT r.transcript_id, r.reads AS uri, r.call_id FROM stream_uris r
WHERE r.reads IS NOT NULL AND r.ts < (SELECT max(ts) FROM events) - INTERVAL 2 HOURS
  AND NOT EXISTS (SELECT 1 FROM stream_uris w WHERE w.transcript_id = r.transcript_id AND w.writes = r.reads AND w.ts < r.ts)
""",
)
def stream_dangling(t: Tables) -> DataFrame:
    """Each call writes a file named after its tool; two tools read another tool's file."""
    reads = "CASE tool_name WHEN 'vid_from_image' THEN 'img_generate' WHEN 'av_combine' THEN 'vid_generate' END"
    uris = t.stream_calls.selectExpr(
        "transcript_id", "call_id", "ts", f"stack(2, tool_name, true, {reads}, false) AS (uri, writes)"
    ).where("uri IS NOT NULL")
    return _append(t, live.dangling_stream(uris, DELAY), "dangling").select("transcript_id", "uri", "call_id")
