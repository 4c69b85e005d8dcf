"""Sharding by bytes: minimax contiguous partition of ordered atomic groups.

Equal texts form a group, which is never split; groups are ordered by a hash of their text. The smallest capacity with
which a greedy walk over the groups needs no more shards than there are is found by binary search, and the walk with
that capacity gives the cuts. All work on rows is plain DataFrame code.

The search doesn't gather the groups. It knows the order as segments: hash ranges with their total size. A walk that
may cut anywhere in a segment gives a lower bound of the capacity, a walk that keeps segments whole an upper bound, and
only the segments in which a cut can fall are divided again, until both agree. What reaches the driver is bounded by
the number of shards, not by the input.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from difflens.llm.common import staged

_BITS = 60
_STEP = 10


@dataclass(frozen=True)
class Segment:
    """Groups whose order is in [low, low + 2^bits): their number, total size and largest size."""

    low: int
    bits: int
    groups: int
    size: int
    largest: int


def order_of(text: Column) -> Column:
    """The place of a text's group: 60 bits of a hash, so that equal texts share it. Null is a text of its own."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))


def _divided(groups: DataFrame, parts: list[Segment] | None) -> list[Segment]:
    """The segments one step below ``parts`` (all, if None)."""
    bits = (parts[0].bits if parts else _BITS) - _STEP
    key = F.shiftright("place", bits)
    if parts is not None:
        wanted = [p.low >> p.bits for p in parts]
        groups = groups.filter(F.shiftright("place", bits + _STEP).isin(wanted))
    rows = groups.groupBy(key.alias("key")).agg(F.count("*").alias("groups"), F.sum("size").alias("size"), F.max("size").alias("largest")).collect()
    return [Segment(r.key << bits, bits, r.groups, r.size, r.largest) for r in rows]


def _walk(ends: list[int], loose: list[bool], capacity: int, shards: int) -> list[int]:
    """Where each of the greedy shards ends: sizes up to there. ``ends``: running sizes of the segments, and ``loose``
    whether a cut may fall inside."""
    at, out = 0, []
    for _ in range(shards):
        limit = at + capacity
        i = bisect_right(ends, limit) - 1  # the last segment that fits whole
        if i + 1 < len(ends) and loose[i + 1]:
            at = max(at, limit)
        else:
            at = max(at, ends[i] if i >= 0 else 0)
        out.append(at)
    return out


def _least(ends: list[int], loose: list[bool], low: int, shards: int) -> int:
    """The smallest capacity from ``low`` on with which the walk reaches the end."""
    high = max(low, ends[-1])
    while low < high:
        middle = (low + high) // 2
        if _walk(ends, loose, middle, shards)[-1] >= ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def cuts(groups: DataFrame, shards: int) -> list[int]:
    """The places at which shards 1, 2, … begin, for ``groups`` (place, size). Fewer than shards - 1 if some stay empty."""
    segments = sorted(_divided(groups, None), key=lambda s: s.low)
    if not segments:
        return []
    total = sum(s.size for s in segments)
    while True:
        ends, at = [], 0
        for s in segments:
            at += s.size
            ends.append(at)
        single = [s.groups == 1 or s.bits == 0 for s in segments]
        todo = [s for s, one in zip(segments, single) if not one and s.size > total / (8 * shards)]
        least = max(max(s.largest for s in segments), -(-total // shards))
        if not todo:
            low = _least(ends, [not one for one in single], least, shards)
            high = _least(ends, [False] * len(ends), low, shards)
            if low == high:
                break
            first = [0, *_walk(ends, [False] * len(ends), low, shards)]
            last = [0, *_walk(ends, [not one for one in single], high, shards)]
            touched = [(a, b) for a, b in zip(first[1:-1], last[1:-1])]
            begins = [0, *ends[:-1]]
            todo = [s for s, one, b, e in zip(segments, single, begins, ends) if not one and any(b <= y and e > x for x, y in touched)]
        finest = max(s.bits for s in todo)
        todo = [s for s in todo if s.bits == finest]
        gone = {(s.low, s.bits) for s in todo}
        segments = sorted([s for s in segments if (s.low, s.bits) not in gone] + _divided(groups, todo), key=lambda s: s.low)
    out = []
    for end in _walk(ends, [False] * len(ends), high, shards):
        i = bisect_right(ends, end)
        if i < len(segments):
            out.append(segments[i].low)
    return out


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    The size of a row is its text's UTF-8 bytes plus 1; the largest shard is as small as the order of the groups allows.
    ``slot`` numbers the rows of a shard from 0 without gaps. Null texts are a group of size 1 each and checksum 0.
    Repeated rows stay and share a shard; other columns are ignored. No rows give no rows.
    """
    text = F.col("text")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), order_of(text).alias("place"))
    rows = staged(rows, "rows")
    groups = staged(rows.groupBy("place").agg(F.sum("size").alias("size")), "groups")
    number = F.lit(0)
    for cut in cuts(groups, shards):
        number = number + (F.col("place") >= cut).cast("int")
    # Slots: rows are dealt into pieces of a shard, whose counts give each piece its first slot.
    pieces = max(1, int((rows.count() / shards) ** 0.5))
    placed = rows.withColumn("shard", number).withColumn("piece", F.pmod(F.xxhash64("doc_id", "size"), F.lit(pieces)))
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("shard", "piece").orderBy("place", "doc_id")
    numbered = placed.withColumn("k", F.row_number().over(inside)).join(begins, ["shard", "piece"])
    slot = (F.col("begin") + F.col("k") - 1).cast("long")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
