"""Sliding-window admission on a stream, with the same result as the batch form.

Events of a key wait until the watermark has passed their time bucket, are then decided in time order, and leave the
state. A micro-batch adds what arrived as packed rows of its own and touches no row that waits; a timer at the end of a
bucket decides that bucket alone. So a batch's work is what arrives and what is decided, however much waits, and no
state row grows: a packed row holds at most ``rows`` events, the accepted times at most ``limit``.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import values as V
from ..operators.admission import walk

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_TIME = -(1 << 63)


class Waiting(StatefulProcessor):
    """State of a key: packed rows by (bucket, number), the number of rows by bucket, and the last accepted times."""

    def __init__(self, limit: int, window_us: int, bucket_ms: int, rows: int):
        self.limit, self.window_us, self.bucket_ms, self.rows = limit, window_us, bucket_ms, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packed = handle.getMapState("packed", "bucket bigint, n int", "us array<bigint>, seq array<bigint>")
        self.counts = handle.getMapState("counts", "bucket bigint", "n int")
        self.accepted = handle.getValueState("accepted", "us array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            us, seq = batch["us"].to_numpy(np.int64), batch["seq"].to_numpy(np.int64)
            timeless = us == NO_TIME
            if timeless.any():
                yield _decided(key, us[timeless], seq[timeless], np.zeros(timeless.sum(), bool))
            bucket = us // (1000 * self.bucket_ms)
            for b in np.unique(bucket[~timeless]).tolist():
                self._add(b, us[bucket == b], seq[bucket == b])

    def _add(self, bucket: int, us: np.ndarray, seq: np.ndarray) -> None:
        known = self.counts.containsKey((bucket,))
        n = self.counts.getValue((bucket,))[0] if known else 0
        for at in range(0, len(us), self.rows):
            self.packed.updateValue((bucket, n), (us[at : at + self.rows].tolist(), seq[at : at + self.rows].tolist()))
            n += 1
        self.counts.updateValue((bucket,), (n,))
        if not known:
            self.handle.registerTimer((bucket + 1) * self.bucket_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        recent = deque(self.accepted.get()[0] if self.accepted.exists() else (), maxlen=self.limit)
        # Timers may fire in any order; a key's buckets are decided in theirs.
        for bucket in sorted(b for (b,) in self.counts.keys() if (b + 1) * self.bucket_ms <= now):
            n = self.counts.getValue((bucket,))[0]
            parts = [self.packed.getValue((bucket, i)) for i in range(n)]
            us, seq = (np.concatenate([np.array(p[i], np.int64) for p in parts]) for i in (0, 1))
            order = np.lexsort((seq, us))
            us, seq = us[order], seq[order]
            flags = np.zeros(len(us), bool)
            flags[walk(us, recent, self.window_us)] = True
            for i in range(n):
                self.packed.removeKey((bucket, i))
            self.counts.removeKey((bucket,))
            yield _decided(key, us, seq, flags)
        until = (recent[-1] + self.window_us) // 1000 + 1 if recent else now
        if until > now:
            self.accepted.update((list(recent),))
            self.handle.registerTimer(until)
        else:
            self.accepted.clear()

    def close(self) -> None:
        pass


def _decided(key: tuple, us: np.ndarray, seq: np.ndarray, accepted: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series([key[0]] * len(us), dtype=object), "us": us, "seq": seq, "accepted": accepted})


def admit_stream(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    limit: int = V.ADMISSION_LIMIT,
    window_seconds: int = V.ADMISSION_WINDOW_SECONDS,
    delay: str = "1 minute",
    bucket_seconds: int = 10,
    rows: int = 4096,
) -> DataFrame:
    """``(key, ts, seq, accepted)``; ``order`` is a number that settles equal times.

    Events later than ``delay`` are dropped, as by any watermark; the others are decided at most ``bucket_seconds`` after
    the watermark has passed them. Events without a time come out at once and are not accepted; those without a key share
    one.
    """
    if events.sparkSession.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    us = F.coalesce(F.unix_micros(ts), F.lit(NO_TIME).cast("bigint"))
    slim = events.withWatermark(ts, delay).select(
        F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), us.alias("us"), F.col(order).cast("bigint").alias("seq")
    )
    decided = slim.groupBy("key").transformWithStateInPandas(
        Waiting(limit, window_seconds * 1_000_000, bucket_seconds * 1000, rows),
        "key string, us bigint, seq bigint, accepted boolean",
        "append",
        "EventTime",
    )
    return decided.select(
        "key", F.when(F.col("us") != NO_TIME, F.timestamp_micros("us")).alias("ts"), "seq", "accepted"
    )
