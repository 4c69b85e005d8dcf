"""Whitening of vectors by an incremental eigendecomposition.

The covariance is never formed from the rows. Each task keeps a spectrum of the rows it has seen: their number, mean and
the eigenpairs of their scatter. A row enters as one centred rank-one update: its difference to the mean, rotated into
the eigenvectors, shifts the eigenvalues to the roots of a secular equation, and the eigenvectors turn by the matching
Cauchy-like matrix. Directions the row doesn't touch, and directions of equal eigenvalue, are deflated: they keep their
pairs. Spectra of tasks are combined in a tree, again by rank-one updates: one for each eigenpair of the smaller spectrum
and one for the difference of the means. The basis that results is refined by a distributed Rayleigh-Ritz step: all rows
are centred by the exact mean and projected on it, the covariance of the projections is summed over the tasks, and its
eigenvectors turn the basis. What a task holds or sends is d * d numbers, whatever the input.

Entries are quantised to whole numbers first, so that sums, means and distances to the mean are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflens.llm.common import staged

_EPS = np.finfo(np.float64).eps
_FAN = 16
_ZERO = 1_000_000
_LARGE = float(1 << 62)


@dataclass
class Spectrum:
    """The rows seen so far: their number, mean, and the eigenvalues (ascending) and eigenvectors of their scatter."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, row: np.ndarray) -> None:
        """One row more: a rank-one update by its difference to the mean of the rows before."""
        off = row - self.mean
        self.n += 1
        self.mean = self.mean + off / self.n
        self.update(off * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: Spectrum) -> Spectrum:
        """The spectrum of the rows of both, by rank-one updates of the larger one."""
        big, small = (self, other) if self.n >= other.n else (other, self)
        if small.n:
            for value, vector in zip(small.values, small.vectors.T):
                if value > 0:
                    big.update(np.sqrt(value) * vector)
            off = small.mean - big.mean
            big.update(off * np.sqrt(big.n * (small.n / (big.n + small.n))))
            big.mean = big.mean + off * (small.n / (big.n + small.n))
            big.n += small.n
        return big

    def update(self, v: np.ndarray) -> None:
        """Adds ``v v'`` to the scatter."""
        self.values, self.vectors = rank_one(self.values, self.vectors, self.vectors.T @ v)


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (ascending) of ``vectors (diag(values) + z z') vectors'``; ``values`` ascend."""
    rho = float(z @ z)
    largest = max(float(values[-1]), rho)
    if not rho or rho < _EPS * _EPS * largest:
        return values, vectors
    z = z / np.sqrt(rho)
    tol = 8 * _EPS * largest
    vectors = _join_equal(values, vectors, z, tol)
    active = np.flatnonzero(rho * np.abs(z) > tol)
    if len(active) == len(z):
        values, turn = secular(values, z, rho)
        return values, vectors @ turn
    if not len(active):
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    values[active], turn = secular(values[active], z[active], rho)
    vectors[:, active] = vectors[:, active] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _join_equal(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, tol: float) -> np.ndarray:
    """Deflation of equal eigenvalues: within such a group any basis will do, and a reflection finds the one in which
    only the last vector meets the update. Returns the vectors; ``z`` is changed."""
    close = np.diff(values) <= tol
    if not close.any():
        return vectors
    vectors = vectors.copy()
    edge = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]]).astype(np.int8)))
    for lo, hi in zip(edge[::2], edge[1::2] + 1):
        part = z[lo:hi].copy()
        norm = float(np.sqrt(part @ part))
        if norm == 0.0:
            continue
        mirror = part
        mirror[-1] += norm if mirror[-1] >= 0 else -norm
        sign = -norm if mirror[-1] > 0 else norm
        half = float(mirror @ mirror) / 2
        vectors[:, lo:hi] -= np.outer(vectors[:, lo:hi] @ mirror, mirror / half)
        z[lo:hi] = 0.0
        z[hi - 1] = sign
    return vectors


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``diag(d) + rho z z'``; ``d`` ascends strictly, ``z`` has no zero and length 1.

    The k-th root lies between d[k] and d[k + 1] (the last one within rho of d[-1]). All are sought at once, as distances
    to the nearer end, by the rational function that has both ends as poles and agrees in value and slope, and by halving
    where that leaves the bracket.
    """
    n = len(d)
    if n == 1:
        return d + rho * z * z, np.ones((1, 1))
    z2 = rho * z * z
    right = np.append(d[1:], d[-1] + z2.sum())
    gap = right - d
    half = gap / 2
    nearer = 1 + (1.0 / ((d - d[:, None]) - half[:, None])) @ z2 >= 0  # the root is in the left half
    nearer[-1] = True
    origin = np.where(nearer, d, right)
    delta = d - origin[:, None]
    low = np.where(nearer, 0.0, -half)
    high = np.where(nearer, half, 0.0)
    high[-1] = gap[-1]
    first, second = np.where(nearer, 0.0, -gap), np.where(nearer, gap, 0.0)
    lower = np.tri(n, dtype=bool)
    tau = (low + high) / 2
    todo = np.arange(n)
    for _ in range(100):
        everywhere = len(todo) == n
        t = tau[todo]
        terms = delta - t[:, None] if everywhere else delta[todo] - t[:, None]
        np.divide(1.0, terms, out=terms)
        left = terms * (lower if everywhere else lower[todo])
        total, below = terms @ z2, left @ z2  # the poles to the left are negative, those to the right positive
        f = 1 + total
        bound = _EPS * n * (1 + total - 2 * below)
        below, above = np.square(left, out=left) @ z2, np.square(terms, out=terms) @ z2
        above -= below
        lo = np.where(f < 0, t, low[todo])
        hi = np.where(f < 0, high[todo], t)
        low[todo], high[todo] = lo, hi
        one, two = first[todo] - t, second[todo] - t
        a = (one + two) * f - one * two * (below + above)
        b = one * two * f
        c = f - one * below - two * above
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = t + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        inside = (new > lo) & (new < hi)
        new = np.where(inside, new, (lo + hi) / 2)
        exact = np.abs(f) <= bound
        done = exact | (np.abs(new - t) <= 4 * _EPS * np.abs(t)) | (new == lo) | (new == hi)
        tau[todo] = np.where(exact, t, new)
        todo = todo[~done]
        if not len(todo):
            break
    # The z for which the roots found are exact, so that the vectors are orthogonal whatever the roots' last digits.
    away = delta - tau[:, None]  # d[i] - root[k], row k
    ratio = -away
    spread = d[:, None] - d
    ratio[:-1] /= np.where(lower[:-1], spread[1:], spread[:-1])
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z)
    turn = exact / away
    turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
    return origin + tau, turn.T


def quantised(vector: str = "embedding") -> Column:
    """floor(64 c) + 1000000 of each entry as long, null for a vector that is null or holds null or non-finite entries.
    Entries of 2^56 and more, whose multiple has no long, count as 2^56."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    within = lambda c: F.greatest(F.least(c.cast("double") * 64.0, F.lit(_LARGE)), F.lit(-_LARGE))
    return F.when(usable, F.transform(vector, lambda c: F.floor(within(c)).cast("long") + F.lit(_ZERO).cast("long")))


@dataclass
class Whitening:
    """A fitted whitening: the fit list's size and sums, and its covariance's leading eigenpairs, largest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def used(self) -> np.ndarray:
        """Whether a component has variance at all: the covariance's rank is what rounding leaves of it."""
        return self.values > len(self.sums) * _EPS * max(self.trace, 0.0)


def fit(vectors: DataFrame, components: int = 16, vector: str = "embedding", rows_per_task: int = 4096, most_tasks: int = 20_000) -> Whitening | None:
    """Fits to each distinct quantised vector once. None if no vector remains.

    The dimension is that of most vectors (of several such, the largest); vectors of another length take no part, nor do
    those that ``quantised`` leaves out. ``rows_per_task`` rows are a task's share of the rank-one updates, more where
    there would be over ``most_tasks`` tasks.
    """
    x = vectors.select(quantised(vector).alias("x")).filter("x is not null")
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or sizes.d == 0:
        return None
    d = sizes.d
    rows = staged(x.filter(F.size("x") == d).distinct(), "whitening-rows")
    count = rows.count()
    tasks = max(1, min(most_tasks, -(-count // rows_per_task)))
    rows = rows.repartition(tasks)

    first = _gathered(rows.mapInArrow(_spectra(d), "id long, n long, sums string, state binary"), tasks, _merged(d))
    n, sums = first["n"], [int(s) for s in first["sums"].split(",")]
    found = _unpacked(first["n"], first["state"], d)
    basis = np.linalg.qr(found.vectors)[0]
    centre = Centre(n, sums)

    def gram(of: np.ndarray):
        summed = _gathered(rows.mapInArrow(_grams(of, centre), "id long, n long, sums string, state binary"), tasks, _added)
        width = of.shape[1]
        data = np.frombuffer(summed["state"])
        mean = data[:width] / n
        return data[width:].reshape(width, width) / n - np.outer(mean, mean)

    ritz = gram(basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(values)[::-1][: min(components, d)]
    trace = float(np.trace(ritz))
    out = Whitening(n, sums, np.maximum(values[order], 0.0), basis @ turn[:, order], trace, 0.0)
    if (used := out.used).any():
        white = gram(out.vectors[:, used] / np.sqrt(out.values[used]))
        out.identity_error = float(np.abs(white - np.eye(len(white))).max())
    return out


class Centre:
    """Rows minus the mean S / n, from whole numbers."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=object)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as int64 if all of it is below 2^53, else as whole numbers of any size."""
        if len(x) and max(int(x.max()) - int(self.base.min()), int(self.base.max()) - int(x.min())) * self.n + self.n < 1 << 53:
            return (x - self.base) * self.n - self.rest.astype(np.int64)
        return (x.astype(object) - self.base.astype(object)) * self.n - self.rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)


def whiten(vectors: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """``vectors`` (vec_id and ``vector``) per remaining row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error. Repeated rows and ids give rows each. Without a model, and for an empty table, no rows.

    Null are: ``whitened`` of a component without variance, ``explained`` if nothing varies, and a ``deviation`` that is
    too large for a long.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, used, centre = len(model.sums), model.used, Centre(model.n, model.sums)
    wide = len(model.values)
    basis = np.where(used, model.vectors / np.sqrt(np.where(used, model.values, 1.0)), 0.0)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(wide)

    def work(batches):
        for batch in batches:
            scaled = centre.scaled(_matrix(batch, d))
            if len(scaled) and _largest(scaled) ** 2 * d >= 1 << 63:
                scaled = scaled.astype(object)
            squares = (scaled * scaled).sum(axis=1)
            deviation = pa.array([int(v) if v < 1 << 63 else None for v in squares] if squares.dtype == object else squares, pa.int64())
            white = (scaled / centre.n).astype(np.float64) @ basis
            rows = np.repeat(np.arange(len(scaled)), wide)
            columns = [
                batch.column(0).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(scaled))),
                pa.array(np.full(len(rows), model.n, dtype=np.int64)),
                deviation.take(pa.array(rows)),
                pa.array(white.ravel(), pa.float64(), mask=~np.tile(used, len(scaled))),
                pa.array(np.tile(explained, len(scaled)), pa.float64(), mask=np.full(len(rows), model.trace <= 0)),
                pa.array(np.full(len(rows), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    x = vectors.select("vec_id", quantised(vector).alias("x")).filter("x is not null").filter(F.size("x") == d)
    return x.mapInArrow(work, schema)


def _largest(scaled: np.ndarray) -> int:
    return max(abs(int(scaled.max())), abs(int(scaled.min())))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _row(n: int, sums: list[int], state: bytes) -> pa.RecordBatch:
    columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([",".join(map(str, sums))]), pa.array([state], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n", "sums", "state"])


def _packed(s: Spectrum) -> bytes:
    return np.concatenate([s.mean, s.values, s.vectors.ravel()]).tobytes()


def _unpacked(n: int, state: bytes, d: int) -> Spectrum:
    data = np.frombuffer(state)
    return Spectrum(n, data[:d], data[d : 2 * d], data[2 * d :].reshape(d, d))


def _exact_sums(x: np.ndarray) -> list[int]:
    small = len(x) and max(abs(int(x.max())), abs(int(x.min()))) * len(x) < 1 << 63
    return [int(s) for s in (x if small else x.astype(object)).sum(axis=0)]


def _spectra(d: int):
    def work(batches):
        spectrum, sums = Spectrum.empty(d), [0] * d
        for batch in batches:
            x = _matrix(batch, d)
            sums = [a + b for a, b in zip(sums, _exact_sums(x))]
            for row in (x - _ZERO).astype(np.float64):  # small numbers keep more digits; the scatter is the same
                spectrum.add(row)
        if spectrum.n:
            yield _row(spectrum.n, sums, _packed(spectrum))

    return work


def _merged(d: int):
    def merge(states: list[dict]) -> dict:
        spectrum, sums = Spectrum.empty(d), [0] * d
        for s in sorted(states, key=lambda s: s["id"]):
            spectrum = spectrum.merge(_unpacked(s["n"], s["state"], d))
            sums = [a + int(b) for a, b in zip(sums, s["sums"].split(","))]
        return {"n": spectrum.n, "sums": ",".join(map(str, sums)), "state": _packed(spectrum)}

    return merge


def _grams(of: np.ndarray, centre: Centre):
    """Per task the sum and the sum of products of the centred rows' projections on the columns of ``of``."""
    d, width = of.shape

    def work(batches):
        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            seen = centre.centred(_matrix(batch, d)) @ of
            n, total, products = n + len(seen), total + seen.sum(axis=0), products + seen.T @ seen
        if n:
            yield _row(n, [], np.concatenate([total, products.ravel()]).tobytes())

    return work


def _added(states: list[dict]) -> dict:
    ordered = sorted(states, key=lambda s: s["id"])
    return {"n": sum(s["n"] for s in ordered), "sums": "", "state": sum(np.frombuffer(s["state"]) for s in ordered).tobytes()}


def _gathered(states: DataFrame, tasks: int, combine) -> dict:
    """One state out of those of all tasks, by a tree in which each task combines at most ``_FAN`` of them."""

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = combine(rows)
        columns = [[rows[0]["id"] // _FAN], [out["n"]], [out["sums"]], [out["state"]]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["id", "n", "sums", "state"])

    states = staged(states, "whitening-states")
    while tasks > 1:
        states = states.groupBy(F.expr(f"id div {_FAN}")).applyInArrow(work, "id long, n long, sums string, state binary")
        tasks = -(-tasks // _FAN)
    return states.first().asDict()
