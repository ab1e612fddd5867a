"""Whitening against plain linear algebra, and the solver on matrices of many kinds."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodex.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def matrices():
    rng = np.random.default_rng(0)
    for trial in range(240):
        d, n = int(rng.integers(1, 40)), int(rng.integers(1, 120))
        a = rng.normal(size=(n, d))
        kind = trial % 6
        if kind == 1:
            a *= 10.0 ** rng.integers(-6, 7, size=d)
        elif kind == 2:
            a = a @ np.diag(np.repeat([5, 1], [min(3, d), d - min(3, d)]))
        elif kind == 3:
            a[:, d // 2 :] = 0
        elif kind == 4:  # equal values
            a = np.eye(n, d) * rng.integers(1, 4, size=d)
        elif kind == 5:  # all but one nearly nothing
            a = np.outer(rng.normal(size=n), rng.normal(size=d)) + 1e-9 * a
        if np.abs(a).max():
            yield a


def test_solver():
    for a in matrices():
        d = a.shape[1]
        r = np.linalg.qr(a, mode="r")
        s, v = whitening.principal(np.vstack([r, np.zeros((max(0, d - len(r)), d))]), 4)
        want = np.linalg.svd(a, compute_uv=False)
        assert len(s) >= min(4, (want > 1e-10 * want[0]).sum())
        assert np.abs(s - want[: len(s)]).max() < 1e-12 * want[0]
        assert np.linalg.norm(a.T @ (a @ v) - v * s**2) < 1e-12 * want[0] ** 2
        assert np.abs(v.T @ v - np.eye(len(s))).max() < 1e-12


def test_values_are_right_however_small():
    """A graded bidiagonal: dqds keeps the small values' digits."""
    q, e = np.array([1.0, 1e-8, 1e-16, 1e-24]), np.array([1e-3, 1e-12, 1e-20])
    got = whitening.dqds(q, e)
    assert math.isclose(float(np.prod(got)), float(np.prod(q)), rel_tol=1e-12)  # the determinant
    exact = [Fraction(x) for x in q]
    assert math.isclose(float(got.sum()), float(sum(exact) + sum(Fraction(x) for x in e)), rel_tol=1e-14)
    for m in (5, 60):
        main, upper = np.arange(1.0, m + 1), np.ones(m - 1)
        ref = np.linalg.svd(np.diag(main) + np.diag(upper, 1), compute_uv=False)
        assert np.allclose(np.sqrt(whitening.dqds(main**2, upper**2)), ref, rtol=1e-13, atol=0)
    assert whitening.principal(np.zeros((3, 3)), 4)[0].size == 0


def plain(rows, k=4):
    """Expected rows by the whole numbers' covariance."""
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, total = len(fit), fit.sum(axis=0)
    c = (n * fit - total) / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return {i: (int(((n * x - total) ** 2).sum()), ((n * x - total) / n) @ vector / np.sqrt(value)) for i, x in good}, n, value / np.trace(c.T @ c / n)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_against_plain_algebra(spark, parts, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    given = np.float32(rng.normal(size=(300, 12)) * np.array([3, 2.5, 2, 1.5] + [0.5] * 8) + 1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(given)]
    rows += [(1000 + i, given[0].tolist(), 0) for i in range(90)] + [(2000, None, 1), (2001, [1.0, None] + [0.0] * 10, 1), (2002, [float("nan")] * 12, 1), (2003, [float("inf")] + [0.0] * 11, 1), (2004, [300.0] * 12, 1), (None, given[5].tolist(), None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("Component", F.lit("clash"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = whitening.whiten(table, whitening.fit(table)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, n, explained = plain(rows)
    assert len(got) == 4 * len([r for r in rows if r[0] not in (2000, 2001, 2002, 2003)])
    sign = {}
    for r in got:
        deviation, w = want[r.vec_id]
        x = w[r.component - 1]
        if abs(x) > 0.1:
            assert sign.setdefault(r.component, np.sign(x * r.whitened)) == np.sign(x * r.whitened)
        assert r.deviation == deviation and r.n == n and abs(abs(r.whitened) - abs(x)) < 1e-9
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9) and 0 <= r.identity_error < 1e-9


def test_tables_without_variance(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, [], 0)]):
        table = spark.createDataFrame(rows, SCHEMA)
        assert whitening.whiten(table, whitening.fit(table)).count() == 0
    one = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], SCHEMA)
    assert sorted(round(r.whitened, 12) for r in whitening.whiten(one, whitening.fit(one)).collect()) in ([-1, 1],)
    ragged = spark.createDataFrame([(1, [1.0], 0), (2, [2.0, 3.0], 0)], SCHEMA)
    with pytest.raises(Exception, match="different lengths"):
        whitening.fit(ragged)
    with pytest.raises(Exception, match="too large"):
        whitening.fit(spark.createDataFrame([(1, [3e38], 0)], SCHEMA))


def test_large_counts_are_exact():
    x = np.array([[1 << 40, -(1 << 40)]])
    assert whitening.centred(x, 1 << 30, np.array([5, -5], object)).tolist() == [[(1 << 70) - 5, 5 - (1 << 70)]]
    rows = np.array([[1, -2], [40_000, 0], [1 << 40, 3]])
    assert [r[:1] for r in whitening.packed(rows)] == [b"2", b"4", b"8"]
    assert all(whitening.unpacked([r]).tolist() == [x] for r, x in zip(whitening.packed(rows), rows.tolist(), strict=True))
