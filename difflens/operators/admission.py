"""Sliding-window admission: at most ``limit`` accepted events per key in the trailing window.

Whether an event is accepted depends on the accepted ones before it, so a key's events are walked in time order. All else
is shared out, also for a key that never pauses: events are sorted by ranges of (key, time) over all tasks and numbered;
runs of them are packed as arrays of times, one row a block; and the flags go back to the events by their number. The walk
reads the blocks of a key one after the other and holds one of them and ``limit`` times. It doesn't look at every event:
after an accepted one the next that can be accepted is found by a binary search for the time at which the window has room,
so its steps are as many as accepted events and blocks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import staging

BLOCK = 1 << 16


class Admission:
    """Accepted times of one key."""

    def __init__(self, limit: int, window_us: int, accepted=()):
        self.limit, self.window_us, self.accepted = limit, window_us, deque(accepted)

    def accept(self, t: int) -> bool:
        while self.accepted and self.accepted[0] <= t - self.window_us:
            self.accepted.popleft()
        if len(self.accepted) >= self.limit:
            return False
        self.accepted.append(t)
        return True


def walk(times: np.ndarray, recent: deque, window_us: int) -> list[int]:
    """Places of the accepted events among sorted ``times``. ``recent``: the last accepted times, as many as its ``maxlen``,
    which is the limit; it is carried on from block to block."""
    out, at, n = [], 0, len(times)
    while at < n and recent.maxlen:
        if len(recent) == recent.maxlen and times[at] < recent[0] + window_us:
            at += int(np.searchsorted(times[at:], recent[0] + window_us))
            if at == n:
                break
        out.append(at)
        recent.append(int(times[at]))
        at += 1
    return out


def micros(events: DataFrame, ts: str) -> Column:
    """Microseconds of a time column; one without time zone is read as it stands."""
    if dict(events.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(ts)


def blocks_of(numbered: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(key, block, events)``: the events of a key in runs of at most ``size`` as arrays of (number, time)."""
    timed = numbered.filter(F.col("us").isNotNull()).withColumn("block", F.expr(f"_id div {int(size)}"))
    return timed.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("_id", "us"))).alias("events"))


def admit(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    limit: int = V.ADMISSION_LIMIT,
    window_seconds: int = V.ADMISSION_WINDOW_SECONDS,
    block: int = BLOCK,
) -> DataFrame:
    """``(key, ts, order, accepted)`` for every event; ``order`` settles equal times. Events without a time are not
    accepted; those without a key share one."""
    window_us = window_seconds * 1_000_000
    slim = events.select(
        F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(order).alias("seq"), micros(events, ts).alias("us")
    )
    # Written once: the numbers must not change when a task runs again. A range never shares a block with the next.
    ranged = slim.repartitionByRange("key", "us", "seq").sortWithinPartitions("key", "us", "seq")
    numbered = staging.stage(ranged.withColumn("_id", F.monotonically_increasing_id()), "admission")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = object(), deque(maxlen=limit)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            lists = batch.column("events")
            ends = lists.offsets.to_numpy()
            fields = lists.values
            ids, times = (fields.field(name).to_numpy(zero_copy_only=False) for name in ("_id", "us"))
            found = []
            for i, k in enumerate(keys):
                if k != current:
                    current, recent = k, deque(maxlen=limit)
                own = slice(ends[i], ends[i + 1])
                found.append(ids[own][walk(times[own], recent, window_us)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], ["_id"])

    packed = blocks_of(numbered, block).repartition("key").sortWithinPartitions("key", "block")
    accepted = packed.select("key", "events").mapInArrow(run, "_id long").withColumn("accepted", F.lit(True))
    out = numbered.join(accepted, "_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    return out.select(F.col("key").alias(key), F.col("ts").alias(ts), F.col("seq").alias(order), "accepted")
