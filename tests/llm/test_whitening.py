import math
from fractions import Fraction

import numpy as np
import pytest

from admitflow.llm.whitening import cross_products, fit, planes, solve, whiten
from admitflow.session import read

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def brute(rows):
    """The fit list, centred sums and covariance in exact arithmetic, for vectors of one width."""
    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in rows}
    fit_list = sorted(set(x.values()))
    n, d = len(fit_list), len(fit_list[0])
    s = [sum(v[k] for v in fit_list) for k in range(d)]
    cov = [[sum((Fraction(v[i]) - Fraction(s[i], n)) * (Fraction(v[j]) - Fraction(s[j], n)) for v in fit_list) / n for j in range(d)] for i in range(d)]
    return x, fit_list, n, s, cov


def check(rows, got, components=16):
    x, fit_list, n, s, cov = brute(rows)
    d = len(s)
    v = np.array([[float(c) for c in row] for row in cov])
    trace = float(sum(cov[i][i] for i in range(d)))
    values = np.linalg.eigvalsh(v)[::-1]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n
        assert r.deviation == sum((n * c - t) ** 2 for c, t in zip(x[r.vec_id], s, strict=True))
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-6)
        assert r.identity_error <= 1e-4
    assert by.keys() == x.keys() and all(sorted(c) == list(range(1, min(d, components) + 1)) for c in by.values())
    # whitened has covariance one over the fit list, and says the eigenvectors up to their sign
    first = {x[i]: i for i in x}
    z = np.array([[by[first[f]][k].whitened for k in range(1, min(d, components) + 1)] for f in fit_list])
    assert np.abs(z.T @ z / n - np.eye(z.shape[1])).max() < 1e-7
    centred = np.array([[float(Fraction(c) - Fraction(t, n)) for c, t in zip(f, s, strict=True)] for f in fit_list])
    for k in range(z.shape[1]):
        u = centred.T @ z[:, k] / n / math.sqrt(values[k])
        assert np.abs(v @ u - values[k] * u).max() < 1e-8 * values[0]


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for high, rows in ((2, 1), (500, 200), (1 << 50, 130)):
        y = rng.integers(0, high, (rows, 5))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(5)] for i in range(5)]
        got = cross_products(y)
        assert all(int(got[i, j]) == want[i][j] for i in range(5) for j in range(i, 5))
        assert planes(y)[1] == max(1, int(y.max()).bit_length())


def test_small(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, [float(c) for c in rng.normal(0, [3, 1, 0.5, 2]).astype(np.float32)]) for i in range(40)]
    vectors += [(100, vectors[0][1]), (101, vectors[0][1]), (102, [1e5, -1e5, 0.001, 2e4])]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [float("nan"), 1.0, 1.0, 1.0]), (203, [float("inf"), 1.0, 1.0, 1.0]), (204, []), (205, [1e30, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors + bad], SCHEMA).repartition(3)
    check(vectors, whiten(frame, keep=["vec_id"]).collect())
    # columns of clashing names pass beside the results'
    assert {"n", "vec_id", "label"} <= set(whiten(frame).columns)


def test_odd_tables(spark):
    one = lambda rows: whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA), keep=["vec_id"]).collect()
    assert one([]) == []
    alone = one([(1, [1.0, 2.0]), (None, [1.0, 2.0])])
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, 0.0, 0.0)] * 4
    # a constant dimension has no variance; vectors of another width are a space of their own
    mixed = one([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [1.0]), (4, [3.0]), (5, [4.0])])
    assert [(r.vec_id, r.n, r.whitened) for r in mixed if r.component == 2] == [(1, 2, None), (2, 2, None)]
    assert {r.n for r in mixed if r.vec_id > 2} == {3}
    # beyond a long
    assert {r.deviation for r in one([(1, [1e10, 0.0]), (2, [-1e10, 0.0])])} == {None}


def test_fit_serves_other_rows(spark):
    a = spark.createDataFrame([(i, [float(i), float(i * i)], 1, "x") for i in range(9)], SCHEMA)
    b = spark.createDataFrame([(5, [5.0, 25.0], 1, "x"), (50, [1.0, 1.0, 1.0], 1, "x")], SCHEMA)
    assert set(whiten(b, keep=["vec_id"], fitted=fit(a)).collect()) < set(whiten(a, keep=["vec_id"]).collect())


def test_offset_does_not_cost_digits():
    rng = np.random.default_rng(3)
    y = rng.integers(-20, 20, (300, 4)).astype(object)
    products = lambda m: np.triu(m.T @ m)
    near, far = (solve(300, list(m.sum(axis=0)), products(m), 4) for m in (y, y + 10**12))
    assert np.allclose(near.values, far.values, rtol=1e-12) and near.identity_error < 1e-12


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in read(spark, sf_dir, "embeddings").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)][:150]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(rows, whiten(table, keep=["vec_id"]).collect())
    assert whiten(read(spark, sf_dir, "embeddings"), keep=["vec_id"]).count() == 16 * len({r.vec_id for r in read(spark, sf_dir, "embeddings").collect()})
