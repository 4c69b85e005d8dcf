"""Whitening against a dense eigendecomposition of the exact covariance."""

import math
import random

import numpy as np
import pytest

from difflens.llm import queries, whitening
from difflens.llm.whitening import Spectrum

SCHEMA = "vec_id long, embedding array<float>, n long, x string, id int"


def _expected(rows, components=16):
    """Per remaining vec_id: (n, deviation, whitened of each component), and the shares explained."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in good]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = lambda v: np.array([(n * a - s) / n for a, s in zip(v, sums)])
    c = np.array([centred(v) for v in fit])
    e, q = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(e)[::-1][:components]
    out = [(i, n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), centred(v) @ q[:, order] / np.sqrt(e[order])) for i, v in x]
    return out, e[order] / e.sum()


def _check(got, rows, components):
    expected, explained = _expected(rows, components)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert len(got) == len(expected) * components
    sign = {}
    for i, n, deviation, white in expected:
        for k in range(components):
            r = by[i][k + 1][0]
            assert (r.n, r.deviation) == (n, deviation)
            if abs(white[k]) > 0.05:
                sign.setdefault(k, np.sign(r.whitened * white[k]))
            assert r.whitened == pytest.approx(sign.get(k, 1) * white[k], abs=1e-8) or abs(white[k]) <= 0.05
            assert r.explained == pytest.approx(explained[k], rel=1e-9)
            assert r.identity_error < 1e-9


def _rows(seed, n, d, scale=1.0):
    rng = random.Random(seed)
    spread = [scale * 0.8**k for k in range(d)]
    return [(i, [rng.gauss(0.1, s) for s in spread]) for i in range(n)]


def test_whitening_equals_the_dense_decomposition(spark):
    rows = _rows(1, 700, 20)
    rows += [(1000, None), (1001, [math.nan] * 20), (1002, [None] + [0.0] * 19), (1003, [math.inf] * 20), (1004, [0.5] * 7), (1005, []), (1006, rows[3][1]), (rows[4][0], rows[4][1])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(5)
    model = whitening.fit(df, components=16, rows_per_task=30)
    got = whitening.whiten(df, model).collect()
    _check(got, [r for r in rows if r[1] is None or len(r[1]) == 20], 16)


def test_query_on_the_given_table(spark, sf_small):
    got = queries.op11_whitening(spark, sf_small)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    assert [(c, t) for c, t in got.dtypes[:7]] == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double"),
    ]
    _check(got.collect(), rows, 16)


def test_few_and_flat_vectors(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    none = make([])
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    assert whitening.fit(make([(1, None), (2, [])])) is None
    one = make([(7, [0.5, 0.25]), (8, [0.5, 0.25])])
    got = whitening.whiten(one, whitening.fit(one)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got) == [(i, k, 1, 0, None, None) for i in (7, 8) for k in (1, 2)]
    line = make([(i, [float(i), float(2 * i), 0.0]) for i in range(6)])
    got = {(r.vec_id, r.component): r for r in whitening.whiten(line, whitening.fit(line)).collect()}
    assert got[0, 2].whitened is None and got[0, 3].whitened is None
    assert [abs(got[i, 1].whitened) for i in range(6)] == pytest.approx([abs(i - 2.5) / math.sqrt(35 / 12) for i in range(6)], abs=1e-9)
    assert got[3, 1].explained == pytest.approx(1.0)


def test_large_entries(spark):
    rows = [(i, [10.0 ** (12 + i % 3) * (i + 1), float(i * i % 7), float(i % 5)]) for i in range(40)] + [(50, [1e300, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert len(got) == 41 * 3
    assert all(r.deviation is None for r in got)  # none fits a long
    assert all(math.isfinite(r.whitened) for r in got if r.component == 1)


@pytest.mark.parametrize("kind", ["spread", "whole", "half zero", "copies", "axes"])
@pytest.mark.parametrize("d", [1, 2, 9, 33])
def test_rank_one_updates_and_merges(kind, d):
    rng = np.random.default_rng(d)
    x = rng.integers(-3, 4, size=(90, d)).astype(float)
    if kind == "spread":
        x *= 10 ** rng.uniform(-3, 3, size=d)
    elif kind == "half zero":
        x[:, d // 2 :] = 0
    elif kind == "copies":
        x = np.repeat(x[:3], 30, axis=0)
    elif kind == "axes":
        x = 1e6 * np.sign(x) * np.eye(d)[rng.integers(0, d, 90)]
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    parts = [Spectrum.empty(d) for _ in range(4)]  # the last stays empty
    for k, row in enumerate(x):
        parts[0 if k < 20 else 1 if k < 25 else 2].add(row)
    got = parts[0].merge(parts[1]).merge(parts[2]).merge(parts[3])
    assert got.n == 90 and got.mean == pytest.approx(x.mean(axis=0), abs=1e-9 * np.abs(x).max())
    assert np.all(np.diff(got.values) >= 0)
    assert np.abs(got.vectors.T @ got.vectors - np.eye(d)).max() < 1e-12
    assert np.abs(got.vectors * got.values @ got.vectors.T - scatter).max() <= 1e-12 * max(1.0, np.abs(scatter).max())
