import math
import random

import numpy as np
import pytest

from bundlewise.llm import bidiagonal, whitening

from .helpers import SF, crowded

ROW = "vec_id bigint, embedding array<float>, label int"


def plain(rows, components=16):
    """Whitening by the covariance matrix of distinct quantised rows."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 10**6 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, s = len(fit), [int(c) for c in fit.sum(axis=0)]
    z = np.array([[float(int(c) * n - t) / n for c, t in zip(x, s)] for x in fit])
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in kept:
        far = sum((n * c - t) ** 2 for c, t in zip(x, s))
        y = np.array([float(c * n - t) / n for c, t in zip(x, s)])
        out[i] = (n, far, [abs(y @ v[:, k]) / math.sqrt(e[k]) for k in range(min(components, len(e))) if e[k] > 1e-9 * e[0]], e / e.sum())
    return out


def check(got, want, tolerance=1e-6):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert set(by) == set(want)
    for i, rs in by.items():
        n, far, y, share = want[i]
        rs.sort(key=lambda r: r["component"])
        assert [r["component"] for r in rs] == list(range(1, len(y) + 1))
        assert all(r["n"] == n and r["deviation"] == far and r["identity_error"] < 1e-8 for r in rs)
        assert np.allclose([abs(r["whitened"]) for r in rs], y, atol=tolerance)
        assert np.allclose([r["explained"] for r in rs], share[: len(rs)], rtol=1e-9)


def query(spark, rows):
    df = crowded(spark.createDataFrame([(i, v, 0) for i, v in rows], ROW)).repartition(3)
    done = whitening.whiten(df, keep=["vec_id"])
    return done.selectExpr("row.vec_id", "component", "n", "cast(deviation as bigint) as deviation", "whitened", "explained", "identity_error").collect()


@pytest.mark.parametrize("d, n", [(5, 200), (20, 300), (3, 40)])
def test_equals_the_covariance_matrix(spark, d, n):
    rng = np.random.default_rng(d)
    base = rng.normal(size=(n, d)) @ np.diag(2.0 ** (np.arange(d)[::-1] / 8)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(base)]
    rows += [(n + j, rows[j % 5][1]) for j in range(60)]  # copies weigh once in the fit
    check(query(spark, rows), plain(rows))


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 3), 7.0]) for i in range(30)]  # the last dimension has no variance
    rows += [(30, None), (31, [1.0, None, 7.0]), (32, [1.0, float("nan"), 7.0]), (33, [float("inf"), 0.0, 7.0]), (34, []), (35, [1.0, 2.0]), (36, [3e38, 0.0, 7.0])]
    check(query(spark, rows), plain(rows[:30]))
    assert {r["component"] for r in query(spark, rows)} == {1, 2}


def test_no_variance_and_no_rows(spark):
    assert query(spark, [(i, [0.5, 0.25]) for i in range(9)]) == []
    assert query(spark, [(1, None)]) == []
    assert whitening.whiten(spark.createDataFrame([], ROW)).collect() == []


def test_far_deviations_are_exact():
    x = np.array([[10**15, -(10**15)], [3, 4], [-5, 10**6]], np.int64)
    s = [int(c) for c in x.sum(axis=0)]
    assert whitening.deviations(x, 3, s) == [sum((3 * int(c) - t) ** 2 for c, t in zip(r, s)) for r in x]


def test_tree_of_factors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STACK_CELLS", 1)  # two factors a stack
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(rng.normal(size=(400, 4)) * [1, 2, 3, 9])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], ROW).repartition(13)
    got = whitening.whiten(df, keep=["vec_id"]).selectExpr("row.vec_id", "component", "n", "cast(deviation as bigint) as deviation", "whitened", "explained", "identity_error")
    check(got.collect(), plain(rows))


def spectra():
    rng = np.random.default_rng(7)
    yield "random", rng.normal(size=(40, 40))
    yield "graded", np.diag(10.0 ** -np.arange(20)) @ rng.normal(size=(20, 20))
    yield "identity", np.eye(12)
    yield "repeated", np.linalg.qr(rng.normal(size=(30, 30)))[0] @ np.diag([5.0] * 10 + [2.0] * 10 + [1.0] * 10) @ np.linalg.qr(rng.normal(size=(30, 30)))[0]
    near = [3.0 * (1 + 1e-9 * k) for k in range(8)] + [1.0] * 4
    yield "near", np.linalg.qr(rng.normal(size=(12, 12)))[0] @ np.diag(near) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    yield "deficient", rng.normal(size=(25, 3)) @ rng.normal(size=(3, 25))
    yield "zero column", rng.normal(size=(10, 10)) * ([1.0] * 4 + [0.0] * 3 + [1.0] * 3)
    yield "one", np.array([[3.0]])
    yield "zero", np.zeros((6, 6))
    yield "glued", np.kron(np.eye(4), np.diag([10.0 - k for k in range(11)]) + np.diag([1e-9] * 10, 1))


@pytest.mark.parametrize("name, a", list(spectra()))
def test_solver(name, a):
    r = np.linalg.qr(a, mode="r")
    squares, v = bidiagonal.principal(r, 16)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(np.sqrt(squares), want, rtol=1e-12, atol=1e-13 * want[0])
    k = v.shape[1]
    assert k == min(16, int((want > 16 * len(want) * bidiagonal.EPS * want[0]).sum()))
    if k:
        assert np.abs(v.T @ v - np.eye(k)).max() < 1e-10
        assert np.abs(a.T @ (a @ v) - v * squares[:k]).max() < 1e-12 * squares[0] * len(a)


def test_small_values_keep_their_digits():
    """A graded bidiagonal matrix: every singular value to full relative accuracy."""
    diagonal, above = 10.0 ** -np.arange(0.0, 24.0, 2.0), 10.0 ** -np.arange(0.5, 22.0, 2.0)
    got = np.sqrt(bidiagonal.squares_of_singular_values(diagonal, above))
    from fractions import Fraction

    # their product is the determinant, their squares' sum the trace
    assert math.isclose(math.prod(got), math.prod(diagonal), rel_tol=1e-13)
    trace = sum(Fraction(float(x)) ** 2 for x in [*diagonal, *above])
    assert math.isclose(float(sum(Fraction(float(x)) ** 2 for x in got)), float(trace), rel_tol=1e-13)


@pytest.mark.parametrize("spread", [1e-4, 1e-6, 1e-10, 0.0], ids=str)
def test_close_values_are_found(spread):
    """Values that agree in many digits, with and without larger ones: transforms alone found none of them."""
    rng = np.random.default_rng(7)
    for large in ([], [5.0, 4.0, 3.0]):
        s = np.sort(np.r_[large, 1.0 + spread * rng.standard_normal(64 - len(large))])[::-1]
        u, w = (np.linalg.qr(rng.standard_normal((64, 64)))[0] for _ in range(2))
        r = np.linalg.qr((u * s) @ w, mode="r")
        squares, v = bidiagonal.principal(r, 16)
        assert np.abs(squares / s**2 - 1).max() < 1e-13
        y = (r @ v) / np.sqrt(squares[:16])
        assert np.abs(y.T @ y - np.eye(16)).max() < 1e-10


def test_query_covers_all_rows(spark):
    got = whitening.op12_embedding_whitening(spark, SF)
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), plain(rows))
