"""The same checks on calls as they arrive.

Sinks of one micro-batch are written under its batch number in overwrite mode, so
a batch that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from callgauge.operators import lint
from callgauge.operators.lint import Spec
from callgauge.session import ship_code


def lint_stream(calls: DataFrame, spec: Spec, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Lint arriving calls into two tables: clean calls, and violations of the others."""
    spec = spec.checked()

    def each(batch: DataFrame, batch_id: int) -> None:
        # One lint per batch: its violations are kept while both tables are written.
        found = lint.violations(batch, spec).persist()
        found.write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
        clean = batch.join(found.select("call_id").distinct(), "call_id", "left_anti")
        clean.write.mode("overwrite").parquet(f"{accepted}/batch_id={batch_id}")
        found.unpersist()

    return calls.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rule_counts(calls: DataFrame, spec: Spec, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Violations per rule and time window, tumbling or sliding; rows later than the watermark are dropped."""
    found = lint.violations(calls.withWatermark("ts", delay), spec.checked())
    return found.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "rule_id").agg(F.count("*").alias("n"))


def write_updates(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every update of an aggregate; ``latest`` reads the last one of each key."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_no", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    stream = rows.writeStream.outputMode("update").foreachBatch(each)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    last = updates.groupBy(*key).agg(F.max_by(F.struct(*values), "batch_no").alias("_last"))
    return last.select(*key, *[F.col(f"_last.{v}") for v in values])


def sessions(calls: DataFrame, key: list[str], delay: str, gap: str) -> DataFrame:
    """Sessions of calls: a session ends after ``gap`` without a call."""
    grouped = calls.withWatermark("ts", delay).groupBy(*key, F.session_window("ts", gap).alias("session"))
    counted = grouped.agg(F.count("*").alias("n_calls"))
    return counted.select(*key, F.col("session.start").alias("started"), F.col("session.end").alias("ended"), "n_calls")


def drop_repeats(calls: DataFrame, delay: str) -> DataFrame:
    """Drop calls that are delivered again within the delay."""
    return calls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["call_id"])


# (transcript, URI) pairs are dealt to so many groups of state; a group's rows are worked on as arrays.
GROUPS = 1024


class _Dangling(StatefulProcessor):
    """State of one group of (transcript, URI) pairs: rows that wait for the watermark, as they came, and each pair's last write.

    The only timer open stands behind the first row that waits or, without one, where the first write is forgotten. It hands out
    all rows the watermark has passed at once: reads meet the last write before them, and the last write of each pair stays
    for ``keep_ms`` after itself. So a write history never holds more than the writes ahead of the watermark and one behind it.
    Calls into the state go with groups and batches, not with rows; rows still waiting are written again when others leave.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = "transcripts array<string>, uris array<string>, micros array<bigint>"
        self.waiting = handle.getListState("waiting", f"{rows}, calls array<bigint>, writes array<boolean>")
        self.last_writes = handle.getValueState("last_writes", rows)
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = []
        for batch in rows:
            micros = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
            calls = [0 if w else int(c) for c, w in zip(batch["call_id"], batch["writes"], strict=True)]
            arrived.append((batch["transcript_id"].tolist(), batch["uri"].tolist(), micros, calls, [bool(w) for w in batch["writes"]]))
        self.waiting.appendList(arrived)
        self._wake(min(min(at) for _, _, at, _, _ in arrived) // 1000 + 1)
        yield from ()

    def _wake(self, ms: int) -> None:
        """Have the timer stand at ``ms`` or before it."""
        if self.timer.exists():
            (set_to,) = self.timer.get()
            if set_to <= ms:
                return
            self.handle.deleteTimer(set_to)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        columns = ["transcript_id", "uri", "micros", "call_id", "writes"]
        held = [pd.DataFrame(dict(zip(columns, lists, strict=True))) for lists in self.waiting.get()] if self.waiting.exists() else []
        waiting = pd.concat(held, ignore_index=True) if held else pd.DataFrame({c: [] for c in columns})
        due = waiting["micros"] // 1000 < passed
        left, rows = waiting[~due], waiting[due]
        if self.last_writes.exists():
            last = pd.DataFrame(dict(zip(columns, self.last_writes.get(), strict=False)))
            rows = pd.concat([last.assign(call_id=0, writes=True), rows], ignore_index=True)
        # By pair and time; a write at the very time of a read comes after it.
        pair = rows.groupby(["transcript_id", "uri"], dropna=False, sort=False).ngroup().to_numpy(dtype="int64")
        micros, writes = rows["micros"].to_numpy(dtype="int64"), rows["writes"].to_numpy(dtype="bool")
        order = np.lexsort((writes, micros, pair))
        rows, pair, micros, writes = rows.iloc[order], pair[order], micros[order], writes[order]
        wrote = np.maximum.accumulate(np.where(writes, np.arange(len(rows)), -1))
        known = (wrote >= 0) & (pair[wrote] == pair)
        lost = rows[~writes & ~(known & (micros - micros[wrote] <= self.keep_ms * 1000))]
        ends = np.append(pair[1:] != pair[:-1], True)[: len(rows)]
        kept = rows.iloc[wrote[ends & known]]
        kept = kept[self._end(kept["micros"]) > passed]
        if len(left):
            self.waiting.put([tuple(left[c].tolist() for c in columns)])
        else:
            self.waiting.clear()
        if len(kept):
            self.last_writes.update(tuple(kept[c].tolist() for c in columns[:3]))
        else:
            self.last_writes.clear()
        if len(left):
            self._wake(int(left["micros"].min()) // 1000 + 1)
        elif len(kept):
            self._wake(int(self._end(kept["micros"]).min()))
        if len(lost):
            yield lost[["transcript_id", "uri", "call_id"]].assign(ts=pd.to_datetime(lost["micros"], unit="us"))

    def _end(self, micros):
        return micros // 1000 + self.keep_ms + 2

    def close(self) -> None:
        pass


def dangling_stream(uris: DataFrame, delay: str, keep_days: int = 7) -> DataFrame:
    """Reads of a URI that no earlier call of the transcript wrote in the ``keep_days`` before it.

    uris: transcript_id, uri, call_id, ts, writes. The state is kept by hash groups of
    (transcript, URI), so one long transcript is spread over many groups. A read is
    judged only when the watermark has passed it: calls out of order within the
    delay give no false alarm. Every write counts for reads up to ``keep_days`` after it, however many there are.
    """
    ship_code(uris.sparkSession)
    group = F.pmod(F.xxhash64("transcript_id", "uri"), F.lit(GROUPS)).alias("state_group")
    # As text: a column of numbers with a null would come as floating point.
    rows = uris.withWatermark("ts", delay).select(group, F.col("transcript_id").cast("string"), "uri", "call_id", "ts", "writes")
    found = rows.groupBy("state_group").transformWithStateInPandas(
        statefulProcessor=_Dangling(keep_days * 86_400_000),
        outputStructType="transcript_id string, uri string, call_id bigint, ts timestamp",
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.withColumn("transcript_id", F.col("transcript_id").cast("bigint"))
