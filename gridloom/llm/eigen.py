"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, bisection on Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

#: Eigenvalues nearer than this share of the largest one are a cluster, whose vectors are made orthogonal to each other.
CLUSTER, ITERATIONS = 1e-3, 6
EPS = float(np.finfo(float).eps)


def tridiagonal(a: np.ndarray):
    """(diagonal, off-diagonal, reflectors) of Q.T @ a @ Q: reflector k acts on the places after k."""
    a, n, reflectors = np.array(a, float), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if not np.abs(x[1:]).max() > 0:
            reflectors.append(None)
            continue
        x /= scale  # so that squares neither vanish nor overflow
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        u = x / np.linalg.norm(x)
        block = a[k + 1 :, k + 1 :]
        p = block @ u
        w = 2 * (p - (u @ p) * u)
        block -= np.outer(u, w) + np.outer(w, u)
        column = a[k + 1 :, k]
        column -= 2 * u * (u @ column)
        a[k, k + 1 :] = column
        reflectors.append(u)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflectors


def below(d: np.ndarray, squares: np.ndarray, x: float, tiny: float) -> int:
    """How many eigenvalues lie below x: the negative pivots of T - x."""
    count, pivot = 0, 1.0
    for k in range(len(d)):
        pivot = d[k] - x - (squares[k - 1] / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by halving an interval down to neighbouring numbers."""
    n = len(d)
    around = np.zeros(n)
    around[:-1] += np.abs(e)
    around[1:] += np.abs(e)
    low0, high0 = float((d - around).min()), float((d + around).max())
    norm = max(abs(low0), abs(high0))
    tiny = max(norm * EPS * EPS, 1e-300)
    squares, found, high = e * e, [], high0 + 2 * EPS * norm
    for j in range(k):
        low, top = low0 - 2 * EPS * norm, high  # the next one is no larger
        while True:
            mid = low + (top - low) / 2
            if not low < mid < top or top - low <= EPS * EPS * norm:
                break
            if below(d, squares, mid, tiny) >= n - j:
                top = mid
            else:
                low = mid
        found.append(low + (top - low) / 2)
        high = top
    return np.array(found)


def solve(d: np.ndarray, e: np.ndarray, x: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - x)^-1 b by elimination with row exchanges; pivots that vanish become tiny."""
    n, b = len(d), b.copy()
    rows = [[float(d[0] - x), float(e[0]) if n > 1 else 0.0, 0.0]]
    for k in range(n - 1):
        up, down = rows[k], [float(e[k]), float(d[k + 1] - x), float(e[k + 1]) if k + 2 < n else 0.0]
        if abs(down[0]) > abs(up[0]):
            rows[k], up, down = down, down, up
            b[k], b[k + 1] = b[k + 1], b[k]
        if abs(up[0]) < tiny:
            up[0] = tiny
        f = down[0] / up[0]
        b[k + 1] -= f * b[k]
        rows.append([down[1] - f * up[1], down[2] - f * up[2], 0.0])
    if abs(rows[-1][0]) < tiny:
        rows[-1][0] = tiny
    for k in range(n - 1, -1, -1):
        b[k] = (b[k] - (rows[k][1] * b[k + 1] if k + 1 < n else 0.0) - (rows[k][2] * b[k + 2] if k + 2 < n else 0.0)) / rows[k][0]
    return b


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a, falling, and their unit vectors as columns. Vectors of a cluster are orthogonal to one
    another, of equal values any such ones. A matrix of zeros has values of 0."""
    n, scale = len(a), float(np.abs(a).max()) if a.size else 0.0
    k = min(k, n)
    if not k or not scale:
        return np.zeros(k), np.eye(n)[:, :k]
    d, e, reflectors = tridiagonal(a / scale)
    found = leading_values(d, e, k)
    norm = max(float(np.abs(d).max()), float(np.abs(e).max()) if n > 1 else 0.0)
    vectors: list[np.ndarray] = []
    first, shifted = 0, np.inf
    for j, value in enumerate(found):
        if j and found[j - 1] - value > CLUSTER * norm:
            first, shifted = j, np.inf
        # values that agree to the last places are moved apart, or each would give the same vector
        shifted = min(value, shifted - 4 * EPS * norm)
        z = np.random.default_rng(j).uniform(0.5, 1.0, n) * np.where(np.arange(n) % 2, -1, 1)
        for _ in range(ITERATIONS):
            z = solve(d, e, shifted, z / np.linalg.norm(z), EPS * norm)
            z /= np.abs(z).max()
            for _ in range(2):
                for other in vectors[first:]:
                    z = z - (other @ z) * other
            if np.linalg.norm(z) < 1e-8:  # it lay in the others' span: another start
                z = np.random.default_rng(1000 + j).normal(size=n)
        vectors.append(z / np.linalg.norm(z))
    q = np.array(vectors).T
    for at in range(len(reflectors) - 1, -1, -1):
        if (u := reflectors[at]) is not None:
            q[at + 1 :] -= 2 * np.outer(u, u @ q[at + 1 :])
    return found * scale, q / np.linalg.norm(q, axis=0)
