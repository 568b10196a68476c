import math

import numpy as np
import pytest

from changeloom.llm import feast, whitening


def symmetric(values, seed=0):
    r = np.random.default_rng(seed)
    q = np.linalg.qr(r.standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [np.linspace(1, 9, 40), np.logspace(0, -6, 50), [3.0] * 6 + [1.0] * 5, [2.0, 2.0 - 1e-9, 1.0], [5.0], [4.0] * 20 + [0.0] * 20])
def test_feast_finds_all(values):
    a = symmetric(np.array(values))
    real = np.linalg.eigvalsh(a)[::-1]
    for s in (0.5, 1.7, real.mean()):
        assert feast.count_above(a, s) == (real > s).sum()
    floor = 1e-12 * max(values)
    parts = feast.slices(a, 32, floor)
    pairs = [feast.eigenpairs(a, *x) for x in parts]
    e, v = np.concatenate([p[0] for p in pairs])[:32], np.hstack([p[1] for p in pairs])[:, :32]
    k = min(32, int((real > floor).sum()))
    assert len(e) == k and np.allclose(e, real[:k], rtol=1e-12, atol=1e-13)
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-11 and np.abs(a @ v - v * e).max() < 1e-12


def test_indefinite_counts():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 9, 30):
        a = r.integers(-2, 3, (n, n)).astype(float)
        a = a + a.T
        for s in (-1.3, 0.01, 2.6):
            assert feast.count_above(a, s) == (np.linalg.eigvalsh(a) > s).sum()
    assert feast.count_above(np.zeros((4, 4)), 0.0) == 0 and feast.count_above(np.array([[0.0, 1], [1, 0]]), 0.0) == 1


def check(rows, vectors, k):
    """Rows against a plain computation in whole numbers and numpy's own eigenvectors."""
    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    total = [sum(c) for c in zip(*x, strict=True)]
    u = np.array([[a * n - s for a, s in zip(row, total, strict=True)] for row in x]) / n
    cov = u.T @ u / n
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    want = u @ p / np.sqrt(e)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(i for i, _ in vectors)
    w = np.array([[got[i][c + 1].whitened for c in range(k)] for i, _ in vectors])
    w = w * np.sign((w * want).sum(0))
    assert np.abs(w - want).max() < 1e-8
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    for (i, _), row in zip(vectors, x, strict=True):
        r = got[i][1]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True)) and r.identity_error < 1e-9
        assert all(abs(got[i][c + 1].explained - e[c] / np.trace(cov)) < 1e-9 for c in range(k))
    assert len({r.identity_error for r in rows}) == 1


def test_whitening_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = [(i, (r.standard_normal(7) * [9, 7, 5, 3, 2, 1, 0.5]).tolist()) for i in range(90)]
    bad = [(900, None), (901, [1.0] * 6 + [None]), (902, [float("nan")] * 7), (903, [1.0, float("inf")] + [0.0] * 5), (904, [1.0] * 3), (905, [])]
    table = spark.createDataFrame([(i, v, "n", 1.0) for i, v in vectors + bad], "vec_id long, embedding array<double>, n string, whitened double").repartition(5)
    rows = whitening.whiten(table, 5).collect()
    assert len(rows) == 90 * 5
    check(rows, vectors, 5)
    assert len(whitening.whiten(table).collect()) == 90 * 7


def test_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(None, [0.0])]):
        out = whitening.whiten(make(rows))
        assert out.count() == 0 and "identity_error" in out.columns
    # repeated rows and null names are vectors each; a dimension without variance adds no component
    got = whitening.whiten(make([(None, [1.0, 5.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0]), (2, [4.0, 5.0])])).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(make([(1, [1e30]), (2, [0.0])])).collect()


def test_exact_sums():
    c = whitening.Centre(3, [10, 4_000_000_000_000])
    x = np.array([[5, 1 << 43], [2, 7]])
    assert c.deviation(x) == [(15 - 10) ** 2 + (3 * (1 << 43) - 4_000_000_000_000) ** 2, (6 - 10) ** 2 + (21 - 4_000_000_000_000) ** 2]
    assert c.apart(np.array([[4, 0]]))[0, 0] == pytest.approx(2 / 3)
