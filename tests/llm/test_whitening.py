"""Whitening against the eigenvectors of the whole covariance."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("weftline.llm")

from weftline.llm import whitening as W  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int, x string, component string, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "c", 2) for i, v in rows], SCHEMA).repartition(3)


def whole(rows, k):
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), c @ u / np.sqrt(e[:k]), e / e.sum()


def held(rows, got, k):
    n, deviation, w, share = whole(rows, k)
    found = {}
    for r in got:
        found.setdefault(r.vec_id, {})[r.component] = r
    sign = np.sign([sum(found[i][j + 1].whitened * w[m, j] for m, (i, _) in enumerate(rows)) for j in range(k)])
    for m, (i, _) in enumerate(rows):
        assert sorted(found[i]) == list(range(1, k + 1))
        for j in range(k):
            r = found[i][j + 1]
            assert (r.n, r.deviation) == (n, deviation[m])
            assert r.whitened == pytest.approx(sign[j] * w[m, j], abs=1e-7)
            assert r.explained == pytest.approx(share[j], rel=1e-8)
            assert r.identity_error < 1e-9


def some(n, d, seed, spread):
    r = np.random.default_rng(seed)
    turn = np.linalg.qr(r.standard_normal((d, d)))[0]
    return [(i, list(map(float, v))) for i, v in enumerate((r.standard_normal((n, d)) * spread(np.arange(d))) @ turn)]


@pytest.mark.parametrize("spread", [lambda i: 1 + 0 * i, lambda i: 4.0 / (1 + i), lambda i: np.where(i < 9, 9.0 - i, 0.002)])
def test_whitening(spark, spread):
    rows = some(300, 30, 1, spread)
    odd = [(900, None), (901, [1.0] * 29 + [None]), (902, [1.0] * 29 + [float("nan")]), (903, [float("inf")] * 30), (904, []), (905, [1.0, 2.0])]
    got = W.whiten(table(spark, rows + odd)).collect()
    held(rows, got, 8)


def test_passes_end_early_only_when_residuals_allow(spark):
    steep = W._grid(table(spark, some(400, 40, 2, lambda i: np.where(i < 8, 2.0 ** (8 - i), 0.001))), W.SCALE, W.SHIFT)
    flat = W._grid(table(spark, some(400, 40, 3, lambda i: 1 + 0 * i)), W.SCALE, W.SHIFT)
    assert W.fit_whitening(steep, tolerance=1e-9).passes < W.POWER_PASSES + 1
    assert W.fit_whitening(flat).passes == W.POWER_PASSES + 1  # the last in full dimension


def test_few_dimensions_copies_and_large_sums(spark):
    rows = some(50, 3, 4, lambda i: 1.0 + i)
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    held(rows, W.whiten(table(spark, rows)).collect(), 3)
    far = [(0, [0.0, 4e9]), (1, [1.0, -4e9]), (2, [2.0, 1.0]), (3, [1e300, 0.0])]
    got = {r.vec_id: r.deviation for r in W.whiten(table(spark, far)).collect()}
    assert (got[0], got[1]) == (None, None)  # beyond a long
    grid = [[int(v * 1024) + 100_000 for v in x] for _, x in far[:3]]
    assert got[2] == sum((3 * a - sum(col)) ** 2 for a, col in zip(grid[2], zip(*grid, strict=True), strict=True))
    assert 3 not in got


def test_tables_without_components(spark):
    assert W.whiten(table(spark, [])).collect() == []
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert W.whiten(table(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
