"""Periodic runs of words: seeds on diagonals, extended to maximal repetitions.

A run is a stretch of consecutive words of one text with smallest period q (words q apart are equal) and a length of at
least ``max(least, repeats * q)`` that no neighbouring word extends.

Lags are taken by classes [m, 2m), m = 1, 2, 4, ... A run of a lag in a class overlaps its own copy, shifted by the lag,
by 3m words or more (``repeats`` is 4), so every class has an index of its 3m-grams, named exactly by doubling (the name
of a gram is the rank of the names of its halves, so equal names mean equal words, without hashes). A gram is paired
with its next occurrence in the same text only, never with all: 3m words are longer than any period of the class, so
the first gram of a run recurs one period later and not before (by the theorem of Fine and Wilf an earlier recurrence
would make the period shorter). For the same reason each pair leads to a stretch whose smallest period is the lag. A
pair lies on a diagonal, the positions i with i + lag; it is extended to both sides unless the table of that lag says
that the diagonal is covered beyond it. Grams whose halves don't recur are not looked at again, so prose without
repeats ends after a few classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from difflens.llm.common import slices, text_column

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_CHUNK = 64


def collapse(docs: DataFrame, least: int = 6, repeats: int = 4) -> DataFrame:
    """(doc_id, runs, text) per row of ``docs`` (doc_id, text): its runs by start and period, numbered in words from 0,
    and its words joined by one blank, without those that a run contains after its first period.

    A null or blank text has no words, hence no runs and an empty text. Rows are judged one by one: repeated rows and
    doc_ids, null doc_ids and further columns change nothing, and an empty table gives no rows. Texts are taken whole.
    ``repeats`` must be 4 or more, else a gram of a class could be longer than what a run is sure to repeat.
    """
    if repeats < 4 or least < 1:
        raise ValueError("repeats must be at least 4 and least at least 1")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("runs", T.ArrayType(T._parse_datatype_string(RUN))), T.StructField("text", T.StringType())])

    def work(batches):
        for whole in batches:
            for batch in slices(whole):
                yield _collapsed(batch, least, repeats)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _collapsed(batch: pa.RecordBatch, least: int, repeats: int) -> pa.RecordBatch:
    texts = [t.as_buffer().to_pybytes().split() for t in text_column(batch).cast(pa.binary())]  # bytes are split at blank and 9 to 13
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = [w for t in texts for w in t]
    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, length, period = find_runs(ids, first, least, repeats)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    keep = np.cumsum(gone[:-1]) == 0
    of = np.searchsorted(first, start, side="right") - 1
    runs_at = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
    kept = []
    for i, text in enumerate(texts):
        if runs_at[i] < runs_at[i + 1]:
            text = [w for w, k in zip(text, keep[first[i] : first[i + 1]].tolist()) if k]
        kept.append(b" ".join(text))
    runs = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    columns = [batch.column(batch.schema.get_field_index("doc_id")), pa.ListArray.from_arrays(pa.array(runs_at), runs), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "text"])


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = 6, repeats: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period. ``ids``: the words of all texts one after the other as
    numbers, text ``i`` from ``first[i]`` to ``first[i + 1]``. Starts count over all texts."""
    n = len(ids)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    longest = int(np.diff(first).max(initial=0))
    found: list[tuple[int, int, int]] = []
    name = np.full(n + 1, -1, dtype=np.int64)
    at = _named(name, np.arange(n), text * (int(ids.max(initial=0)) + 1) + ids)
    m = 1
    while repeats * m <= longest and len(at):
        double = np.full(n + 1, -1, dtype=np.int64)
        both = at[at + m < n]
        both = both[name[both + m] >= 0]
        at_double = _named(double, both, _pair(name, name, both, m))
        third = at_double[at_double + 2 * m < n]
        third = third[name[third + 2 * m] >= 0]
        found += _extended(ids, text, first, *_seeds(third, _pair(double, name, third, 2 * m), m), 3 * m, least, repeats)
        name, at, m = double, at_double, 2 * m
    rows = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def _pair(left: np.ndarray, right: np.ndarray, at: np.ndarray, apart: int) -> np.ndarray:
    """A number for the two names at each place; names are below the number of words, so it fits."""
    return left[at] * len(right) + right[at + apart]


def _named(name: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gives the places whose key occurs more than once the key's rank, and returns these places."""
    _, rank, count = np.unique(key, return_inverse=True, return_counts=True)
    often = count[rank] > 1
    name[at[often]] = rank[often]
    return at[often]


def _seeds(at: np.ndarray, key: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) where a gram's next occurrence is m to 2m - 1 words later. Of places in a row on one diagonal only
    the first is given."""
    order = np.lexsort((at, key))
    at, key = at[order], key[order]
    lag = at[1:] - at[:-1]
    near = (key[1:] == key[:-1]) & (lag >= m) & (lag < 2 * m)
    at, lag = at[:-1][near], lag[near]
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    head = np.ones(len(at), dtype=bool)
    head[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
    return at[head], lag[head]


def _extended(ids, text, first, at, lag, seed: int, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """(start, period, length) of the stretches around the seeds that are long enough."""
    out = []
    covered: dict[int, int] = {}
    for i, q in zip(at.tolist(), lag.tolist()):
        if i < covered.get(q, 0):
            continue
        low, high = int(first[text[i]]), int(first[text[i] + 1]) - q
        right, step = i + seed, _CHUNK
        while right < high:
            same = ids[right : min(right + step, high)] == ids[right + q : min(right + step, high) + q]
            right += len(same) if same.all() else int(same.argmin())
            if not same.all():
                break
            step *= 2
        left, step = i, _CHUNK
        while left > low:
            same = (ids[max(left - step, low) : left] == ids[max(left - step, low) + q : left + q])[::-1]
            left -= len(same) if same.all() else int(same.argmin())
            if not same.all():
                break
            step *= 2
        covered[q] = right
        if right + q - left >= max(least, repeats * q):
            out.append((left, q, right + q - left))
    return out
