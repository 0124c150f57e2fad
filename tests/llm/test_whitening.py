"""Whitening against NumPy's eigenvectors and exact arithmetic, and on odd tables."""

import math

import numpy as np
import pytest

from gridloom.llm import eigen, whitening

SCHEMA = "vec_id bigint, embedding array<float>, component string, n string"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 64])
def test_eigenpairs_equal_numpys(n):
    rng = np.random.default_rng(n)
    some = rng.normal(size=(n, n))
    rank = rng.normal(size=(n, max(1, n // 3)))
    for a in (some + some.T, rank @ rank.T, np.eye(n), np.ones((n, n)), np.zeros((n, n)), np.diag(np.arange(n) // 3 * 1.0), 1e-150 * some @ some.T):
        values, vectors = eigen.leading(a, 8)
        k, scale = len(values), np.abs(a).max() or 1
        assert k == min(8, n) and np.allclose(values / scale, np.linalg.eigvalsh(a)[::-1][:k] / scale, atol=1e-13)
        assert np.allclose((a @ vectors - vectors * values) / scale, 0, atol=1e-13) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)


def test_clustered_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(40, 40)))
    values, vectors = eigen.leading((q * np.array([7.0] * 5 + [7 - 1e-9] * 5 + [1] * 30)) @ q.T, 8)
    assert np.allclose(values, [7] * 5 + [7 - 1e-9] * 3, atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-13)
    glued = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)  # pairs equal to the last places
    values, vectors = eigen.leading(glued, 8)
    assert np.allclose(values, np.linalg.eigvalsh(glued)[::-1][:8], atol=1e-13) and np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)


def brute(rows):
    kept = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], float)
    c = x - x.mean(axis=0)
    v = c.T @ c / len(x)
    e, q = np.linalg.eigh(v)
    n, s = len(kept), [sum(col) for col in zip(*(v for _, v in kept))]
    exact = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for _, v in kept]
    return kept, c @ q[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), e[::-1] / e.sum(), exact


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    drawn = (rng.normal(size=(300, 12)) * np.arange(1, 13) * 0.05 + 3).astype("float32").tolist()
    rows = list(enumerate(drawn)) + [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0] * 5), (None, drawn[0]), (0, drawn[0])]
    found = whitening.whiten(spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA).repartition(5)).collect()
    kept, whitened, share, exact = brute([r for r in rows if not r[1] or len(r[1]) != 5])
    assert len(found) == 8 * len(kept) == 8 * 302 and {r["n"] for r in found} == {302}
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for k in range(8):
        first = by[1, k + 1][0]["whitened"]
        sign = 1 if first * whitened[1, k] > 0 else -1
        for (i, _), row, d in zip(kept, whitened, exact):
            for r in by[i, k + 1]:
                assert math.isclose(r["whitened"], sign * row[k], abs_tol=1e-9) and r["deviation"] == d and r["deviation_digits"] == str(d)
                assert math.isclose(r["explained"], share[k], rel_tol=1e-9) and r["identity_error"] < 1e-9
    assert len(by[0, 1]) == 2  # a repeated row


def test_odd_tables(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(k, [1.0, 2.0]) for k in range(5)]) == []
    line = run([(k, [k / 1024.0, 0.5, -k / 512.0]) for k in range(40)])  # one dimension
    assert len(line) == 40 and {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12 and line[0]["identity_error"] < 1e-12
    small = run([(k, [float(k * 1000), (k % 2) / 1024.0]) for k in range(1000)])  # a component of 1e-12 of the trace
    assert len(small) == 2000 and small[0]["identity_error"] < 1e-4
    assert math.isclose(next(r["explained"] for r in small if r["component"] == 2), 0.25 / (1024_000**2 * (1000**2 - 1) / 12), rel_tol=1e-4)
    # entries beyond 64 bits: the second component's share is below what numbers can tell
    huge = run([(k, [3e38 if k % 2 else -3e38, float(k)]) for k in range(10)])
    exact = {int(r["deviation_digits"]) for r in huge}
    assert len(huge) == 10 and min(exact) > 1 << 63 and {r["deviation"] for r in huge} == {(1 << 63) - 1}
