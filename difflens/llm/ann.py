"""Nearest neighbours by a block matrix join over int8 product tiles.

Vectors are quantised to int8, each with its own scale, and packed into blocks. Every tile, a block of queries times a
block of candidates, is one integer matrix product. With the quantisation's error bound it gives a lower and an upper
bound of each inner product, and only pairs whose upper bound reaches the query's k-th largest lower bound survive.
Survivors are recomputed in double precision, so a tile loses none of its nearest; tiles are merged by heaps.
"""

from __future__ import annotations

import heapq
import math
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflens.llm.common import staged

_PAIRS = 1 << 20
_TINY = np.nextafter(0.0, 1.0)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part: with an id, not null, without null or non-finite components, not zero."""
    v = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(finite & F.exists("embedding", lambda x: x != 0))


def _blocks(vectors: DataFrame, rows: int, column: str, copies: int) -> tuple[DataFrame, int]:
    """Vectors packed into blocks of about ``rows``: (column, ids, data, dim). Blocks differ in no more than chance."""
    n = vectors.count()
    blocks = max(1, math.ceil(n / rows))
    placed = vectors.withColumn(column, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        return _pack(group, column, copies)

    return placed.groupBy(column, F.size("embedding").alias("dim")).applyInArrow(pack, f"{column} int, dim int, ids binary, data binary"), blocks


def _pack(group: pa.Table, column: str, copies: int) -> pa.Table:
    ids = group.column("vec_id").to_numpy()
    data = np.ascontiguousarray(np.array(group.column("embedding").combine_chunks().flatten()).reshape(len(ids), -1))
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    if copies:
        # Of equal vectors only those with the smallest ids can be among the nearest; one more for the query itself.
        _, kind = np.unique(data, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        by = np.argsort(kind, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(kind))[:-1]])
        keep = np.sort(by[np.arange(len(by)) - first[kind[by]] <= copies])
        ids, data = ids[keep], data[keep]
    return pa.table({column: pa.array([group.column(column)[0].as_py()], pa.int32()), "dim": pa.array([data.shape[1]], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the sum of each row's absolute codes."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, _TINY)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.abs(codes.astype(np.float64)).sum(axis=1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row; where terms are beyond the largest double, the sum's sign still decides."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (x * y).sum(axis=1)
    beyond = np.flatnonzero(~np.isfinite(out))
    if len(beyond):
        (_, a), (_, b) = (np.frexp(np.abs(v[beyond]).max(axis=1)) for v in (x, y))
        small = (np.ldexp(x[beyond], -a[:, None]) * np.ldexp(y[beyond], -b[:, None])).sum(axis=1)
        with np.errstate(over="ignore"):
            out[beyond] = np.ldexp(small, a + b)
    return out


def tile(q_ids, q, c_ids, c, k: int) -> list[list[tuple[float, int]]]:
    """For each query its ``k`` nearest of one block as (-score, vec_id), nearest first."""
    qc, qs, qn = quantise(q)
    cc, cs, cn = quantise(c)
    # |x y - product of codes| is at most the scales times half of both sums and a quarter for each dimension.
    slack = 0.25 * q.shape[1]
    out = []
    right = cc.T.astype(np.float32)  # products and sums of int8 codes are exact in 24 bits up to 1040 dimensions
    wide = q.shape[1] > 1040
    right = cc.T.astype(np.float64) if wide else right
    step = max(1, _PAIRS // max(1, len(c)))
    for lo in range(0, len(q), step):
        part = slice(lo, lo + step)
        itself = q_ids[part, None] == c_ids[None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            scales = qs[part, None] * cs[None, :]
            middle = (qc[part].astype(right.dtype) @ right) * scales
            # Beside the quantisation: what sums of very small products lose.
            error = (0.5 * (qn[part, None] + cn[None, :]) + slack) * scales * (1 + 1e-6) + 2 * q.shape[1] * _TINY
            upper, lower = middle + error, middle - error
        # Without a finite bound nothing is known: such a pair survives and displaces none.
        lower = np.where(itself | ~np.isfinite(lower), -np.inf, lower)
        upper = np.where(np.isfinite(upper), upper, np.inf)
        most = min(k, lower.shape[1])
        cut = -np.partition(-lower, most - 1, axis=1)[:, most - 1]
        i, j = np.nonzero((upper >= cut[:, None]) & ~itself)
        score = np.empty(len(i))
        for a in range(0, len(i), 1 << 16):
            score[a : a + (1 << 16)] = products(q[lo + i[a : a + (1 << 16)]], c[j[a : a + (1 << 16)]])
        order = np.lexsort((c_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        edges = np.searchsorted(i, np.arange(len(lower) + 1))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            e = min(e, s + k)
            out.append(list(zip((-score[s:e]).tolist(), c_ids[j[s:e]].tolist())))
    return out


_LISTS = "qb int, part int, query_id long, scores array<double>, ids array<long>"


def _tiles(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    rows = []
    for a in left.to_pylist():
        for b in right.to_pylist():
            if a["dim"] == b["dim"]:
                q_ids, c_ids = np.frombuffer(a["ids"], np.int64), np.frombuffer(b["ids"], np.int64)
                q, c = (np.frombuffer(x["data"], np.float64).reshape(-1, x["dim"]) for x in (a, b))
                rows += [(a["qb"], b["cb"], i, found) for i, found in zip(q_ids.tolist(), tile(q_ids, q, c_ids, c, k))]
    return _lists(rows)


def _lists(rows) -> pa.Table:
    return pa.table(
        {
            "qb": pa.array([r[0] for r in rows], pa.int32()),
            "part": pa.array([r[1] for r in rows], pa.int32()),
            "query_id": pa.array([r[2] for r in rows], pa.int64()),
            "scores": pa.array([[-s for s, _ in r[3]] for r in rows], pa.list_(pa.float64())),
            "ids": pa.array([[i for _, i in r[3]] for r in rows], pa.list_(pa.int64())),
        }
    )


def _merge(batches, k):
    """Merges the sorted lists of each query by a heap. Rows come sorted by query."""
    held, name = [], None
    for batch in batches:
        rows = []
        for r in zip(*(batch.column(c).to_pylist() for c in ("query_id", "scores", "ids"))):
            if r[0] != name and held:
                rows.append((0, 0, name, list(islice(heapq.merge(*held), k))))
                held = []
            name = r[0]
            held.append([(-s, i) for s, i in zip(r[1], r[2])])
            if len(held) == 64:
                held = [list(islice(heapq.merge(*held), k))]
        yield from _lists(rows).to_batches()
    if held:
        yield from _lists([(0, 0, name, list(islice(heapq.merge(*held), k)))]).to_batches()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, query_block: int = 2048, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with other vectors.

    ``vectors`` and ``queries`` have vec_id and embedding; a query's own row is no candidate. Ties go to the smaller
    vec_id; with fewer candidates all are returned. Vectors that are null or zero or hold null or non-finite components
    take no part; vectors of another length than the query's aren't compared with it. Ids of any whole type come as longs.
    A product beyond the largest double is infinite, and such ones tie. Ids are expected to be unique;
    rows that repeat an id with an equal vector count once. Other columns are ignored.
    """
    v, q = usable(vectors).distinct(), usable(queries).distinct()
    left, n_left = _blocks(q, query_block, "qb", 0)
    right, n_right = _blocks(v, block, "cb", k)
    left, right = staged(left, "queries"), staged(right, "vectors")
    left = left.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    # One task for each tile of a block of queries and a block of vectors.
    left, right = (x.repartition(min(n_left * n_right, 4096), "qb", "cb") for x in (left, right))

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        return _tiles(a, b, k)

    tiles = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(join, _LISTS)
    merged = tiles.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(partial(_merge, k=k), _LISTS)
    ranked = merged.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
