"""Streams: latency windows, lockout after failures, and the change log."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import Storage


def windowed_latency(events: DataFrame, length: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Counts and mean of ``(ts, route, ms)`` in sliding windows, batch or stream; rows later than the watermark are left out of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length, slide), "route").agg(F.count("*").alias("samples"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms")).select(F.col("window.start").alias("start"), "route", "samples", "mean_ms", "max_ms")


def sessions(events: DataFrame, gap: str = "3 seconds", late: str = "5 minutes") -> DataFrame:
    """Bursts of ``(ts, key)`` that end with a quiet period: when an index may be compacted."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "key").agg(F.count("*").alias("writes")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "writes")


class Lockout:
    """Which attempts are let in: ``limit`` failures within ``window_s`` block a key for ``block_s``; a success clears it."""

    def __init__(self, limit: int = 10, window_s: float = 300.0, block_s: float = 300.0) -> None:
        self.limit, self.window_s, self.block_s = limit, window_s, block_s

    def step(self, failures: list[float], until: float, ts: float, ok: bool) -> tuple[list[float], float, bool]:
        """Failures kept, end of the block, and whether this attempt was blocked. At most ``limit`` times are kept."""
        if ts < until:
            return failures, until, True
        if ok:
            return [], 0.0, False
        failures = [t for t in failures if t > ts - self.window_s] + [ts]
        return ([], ts + self.block_s, False) if len(failures) >= self.limit else (failures, 0.0, False)


def lockout(attempts: DataFrame, rule: Lockout | None = None, late: str = "5 minutes") -> DataFrame:
    """``(key, ts, ok)`` attempts as a stream to ``(key, ts, blocked)``; a key's state expires once its window and block are over."""
    rule = rule or Lockout()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, until = state.get if state.exists else ([], 0.0)
        failures, latest = list(failures), 0.0
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        blocked = []
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            at = ts.timestamp()
            latest = max(latest, at)
            failures, until, hit = rule.step(failures, until, at, bool(ok))
            blocked.append(hit)
        state.update((failures, until))
        # State can only time out beyond the watermark.
        end = int(1000 * (max(latest, until) + rule.window_s))
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "blocked": blocked})

    rows = attempts.select("key", F.col("ts").cast("timestamp").alias("ts"), "ok").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, blocked boolean", "failures array<double>, until double", "append", GroupStateTimeout.EventTimeTimeout)


def write_changes(changes: DataFrame, storage: Storage, checkpoint: str, compact_every: int = 50_000):
    """A stream of records into an index's change table, one numbered write a micro-batch; a snapshot after so many rows.

    A batch's number is written down before its rows, so a batch that is run again after a failure replaces
    what it wrote. Of rows of one id in a batch the last one counts. How many rows wait for a snapshot
    is counted in the table, which outlives the stream.
    """
    name = f"stream-{hashlib.sha1(checkpoint.encode()).hexdigest()[:16]}.json"

    def sink(batch: DataFrame, number: int) -> None:
        known = json.loads(storage.read_text(name) or "{}")
        seq = known["seq"] if known.get("batch") == number else storage.next_seq()
        if seq <= storage.at():  # run again after its rows went into a snapshot
            return
        storage.write_text(name, json.dumps({"batch": number, "seq": seq}))
        storage.append(batch.withColumn("pos", F.monotonically_increasing_id()), seq)
        if storage.log(storage.at()).count() >= compact_every:
            storage.snapshot()

    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retained(events: DataFrame, most: int = 20_000) -> DataFrame:
    """The newest events by id; older ones are due for removal."""
    return events.orderBy(F.desc("id")).limit(most)
