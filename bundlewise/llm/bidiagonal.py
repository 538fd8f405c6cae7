"""Singular values and right singular vectors of a small triangular matrix by qd transforms.

Householder reflections make the matrix bidiagonal; dqds finds the squared singular values; twisted factorisations of
BᵀB − λ give the vectors. Only factors of d x d come here, whatever the number of rows they stand for.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Neighbouring squares closer than this share are one cluster, whose vectors are made orthogonal explicitly.
CLUSTER = 1e-3
#: Transforms in a row that may find nothing. Values that agree in many digits keep dqds from converging; they are then bisected.
PATIENCE = 100


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors): R = U B Vᵀ with V the product of the reflections."""
    a = np.array(r, float)
    d = a.shape[1]
    right: list[np.ndarray] = []
    for k in range(d):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2.0 * np.outer(v, v @ a[k:, k:])
        if k < d - 1:
            w = _reflector(a[k, k + 1 :])
            right.append(np.zeros(d - k - 1) if w is None else w)
            if w is not None:
                a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit vector v such that x − 2 v (v·x) is zero but for its first entry."""
    size = float(np.abs(x).max(initial=0.0))
    if size == 0.0 or not np.abs(x[1:]).max(initial=0.0):
        return None
    v = x / size
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def reflected(right: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """V z."""
    out = np.array(z, float)
    for k in range(len(right) - 1, -1, -1):
        w = right[k]
        out[k + 1 :] -= 2.0 * w * (w @ out[k + 1 :])
    return out


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One dqds transform: qd numbers of the matrix minus `shift`, and the least pivot (negative: shift too large)."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0.0:
            return new_q, new_e, d
        new_q[i] = d + e[i]
        if new_q[i] == 0.0:
            # an exact zero: the matrix falls apart here
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / new_q[i]
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
        least = min(least, d)
    new_q[n - 1] = d
    return new_q, new_e, least


def _lower_bound(q: list[float], e: list[float]) -> float:
    """A number not above the least eigenvalue: the Newton step 1 / trace of the inverse, read off the pivots without shift."""
    d, total = q[0], 0.0
    for i in range(len(q)):
        if d <= 0.0:
            return 0.0
        total += 1.0 / d
        if i < len(e):
            d = d * (q[i + 1] / (d + e[i]))
    return (1.0 / total) * (1.0 - 4.0 * len(q) * EPS) if total < float("inf") else 0.0


def _bisected(q: list[float], e: list[float], sigma: float) -> list[float]:
    """The eigenvalues of a block, by bisection of all at once: negative pivots of a shifted transform count those below the shift.

    Each is found to the rounding of itself plus `sigma`, however close it lies to others.
    """
    n = len(q)
    top = 2.0 * (max(q) + max(e, default=0.0))
    tiny = EPS**4 * (top + sigma) or 1.0
    low, high = np.zeros(n), np.full(n, top)
    wanted = np.arange(1, n + 1)
    while True:
        shift = 0.5 * (low + high)
        open_ = (high - low > 2.0 * EPS * (sigma + high)) & (high > tiny) & (low < shift) & (shift < high)
        if not open_.any():
            return [float(x) for x in shift]
        d = q[0] - shift
        below = np.zeros(n, int)
        for i in range(n - 1):
            pivot = d + e[i]
            pivot = np.where(np.abs(pivot) > tiny, pivot, np.where(pivot >= 0.0, tiny, -tiny))
            below += pivot < 0.0
            d = q[i + 1] * (d / pivot) - shift
        below += d < 0.0
        high, low = np.where(open_ & (below >= wanted), shift, high), np.where(open_ & (below < wanted), shift, low)


def squares_of_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix by dqds, falling.

    Shifts are lower bounds of the least eigenvalue, so transforms stay positive and lose no relative accuracy; where
    rounding makes a pivot negative, the shift is halved. A block in which `PATIENCE` transforms find nothing is bisected.
    """
    scale = float(max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    todo = [([float(x) for x in (diagonal / scale) ** 2], [float(x) for x in (above / scale) ** 2], 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        sweeps = 0
        while q:
            if len(q) == 1:
                found.append(q[0] + sigma)
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (sigma + q[i]) or e[i] <= EPS * EPS * (sigma + q[i + 1])), None)
            if cut == len(e) - 1:
                found.append(q.pop() + sigma)
                e.pop()
                sweeps = 0
                continue
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                sweeps = 0
                continue
            if sweeps == PATIENCE:
                found.extend(x + sigma for x in _bisected(q, e, sigma))
                break
            if q[0] * 1.5 < q[-1]:
                # the same matrix from its other end: small values belong to the bottom
                q, e = _reversed(q, e)
            shift = _lower_bound(q, e)
            while True:
                new_q, new_e, least = _sweep(q, e, shift)
                if least >= 0.0 or shift == 0.0:
                    break
                shift = shift * 0.5 if shift > EPS * (sigma + shift) else 0.0
            q, e = [max(x, 0.0) for x in new_q], new_e
            sigma += shift
            sweeps += 1
    return np.sort(np.array(found))[::-1] * scale * scale


def _reversed(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """qd numbers of the flipped matrix: diagonal and superdiagonal of B turned round have the same singular values."""
    return q[::-1], e[::-1]


class Twisted:
    """Twisted factorisations of BᵀB − λ for all twist positions."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        q, e, cross = diagonal**2, above**2, diagonal[:-1] * above
        n = len(q)
        tiny = EPS * EPS * max(float(q.max()), float(e.max(initial=0.0)), value) or 1.0
        self.down, self.up = np.zeros(n), np.zeros(n)
        self.low, self.high = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
        s = np.zeros(n)
        s[0] = -value
        for i in range(n - 1):
            self.down[i] = _away(q[i] + s[i], tiny)
            self.low[i] = cross[i] / self.down[i]
            s[i + 1] = e[i] * s[i] / self.down[i] - value
        self.down[n - 1] = q[n - 1] + s[n - 1]
        p = np.zeros(n)
        p[n - 1] = q[n - 1] - value
        for i in range(n - 2, -1, -1):
            self.up[i + 1] = _away(e[i] + p[i + 1], tiny)
            self.high[i] = cross[i] / self.up[i + 1]
            p[i] = p[i + 1] * (q[i] / self.up[i + 1]) - value
        self.gamma = s + p + value
        self.tiny = tiny

    def null_vector(self, r: int) -> np.ndarray:
        """Solution of (BᵀB − λ) z = gamma_r e_r, of length one."""
        n = len(self.gamma)
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -self.low[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -self.high[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, r: int, b: np.ndarray) -> np.ndarray:
        """(BᵀB − λ)⁻¹ b by the factorisation twisted at r, scaled to length one."""
        n = len(self.gamma)
        y = np.array(b, float)
        for i in range(r):
            y[i + 1] -= self.low[i] * y[i]
        for i in range(n - 2, r - 1, -1):
            y[i] -= self.high[i] * y[i + 1]
        y[:r] /= self.down[:r]
        y[r + 1 :] /= self.up[r + 1 :]
        y[r] /= _away(float(self.gamma[r]), self.tiny)
        for i in range(r - 1, -1, -1):
            y[i] -= self.low[i] * y[i + 1]
        for i in range(r, n - 1):
            y[i + 1] -= self.high[i] * y[i]
        size = np.abs(y).max()
        return b if not np.isfinite(size) or size == 0.0 else (y / size) / np.linalg.norm(y / size)


def _away(x: float, tiny: float) -> float:
    """A pivot that can be divided by."""
    return x if abs(x) > tiny else (tiny if x >= 0.0 else -tiny)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray, k: int) -> np.ndarray:
    """Unit eigenvectors of BᵀB for its `k` largest eigenvalues, as columns.

    The twist with the least |gamma| gives a vector without iteration. Vectors of a cluster are kept apart: of several
    twists the one with the most left outside the vectors before it is taken, then refined and made orthogonal again.
    """
    done: list[np.ndarray] = []
    start = 0
    for j in range(k):
        if j and squares[j - 1] - squares[j] > CLUSTER * squares[j - 1]:
            start = j
        before = done[start:j]
        tool = Twisted(diagonal, above, float(squares[j]))
        order = np.argsort(np.abs(tool.gamma), kind="stable")
        z, r, left = None, int(order[0]), 0.0
        for twist in order if before else order[:1]:
            v = _outside(tool.null_vector(int(twist)), before)
            size = float(np.linalg.norm(v))
            if size > left:
                z, r, left = v / size, int(twist), size
            if left > 0.3:
                break
        for _ in range(3 if before else 0):
            v = _outside(tool.solve(r, z), before)
            if np.linalg.norm(v) > 1e-3:
                z = v / np.linalg.norm(v)
        done.append(z)
    return np.array(done).T if done else np.zeros((len(diagonal), 0))


def _outside(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            v = v - o * (o @ v)
    return v


def principal(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values of R, all of them and falling; right singular vectors of the `k` largest as columns).

    Values below 16 d times the rounding unit of the largest singular value count as zero and get no vector.
    """
    diagonal, above, right = bidiagonalise(r)
    squares = squares_of_singular_values(diagonal, above)
    least = (16 * len(squares) * EPS) ** 2 * squares[0]
    k = min(k, int((squares > least).sum()))
    z = right_vectors(diagonal, above, squares, k)
    return squares, np.column_stack([reflected(right, z[:, j]) for j in range(k)]) if k else np.zeros((len(squares), 0))
