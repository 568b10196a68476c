"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST), interval by interval.

A contour around an interval of the real line is integrated by quadrature: sum of w_k (z_k I - A)^-1 Q projects Q onto the
eigenvectors whose eigenvalues lie inside. Rayleigh-Ritz in that subspace gives the pairs, and the projection is repeated
until they no longer change. How many there must be is known beforehand: the inertia of A - sI counts the eigenvalues above s.
"""

from __future__ import annotations

import numpy as np

NODES, MOST_INSIDE, ROUNDS = 8, 12, 30
_EPS = np.finfo(float).eps


def count_above(a: np.ndarray, s: float) -> int:
    """Eigenvalues of a above s: the positive ones of D in L D L^T = P (a - sI) P^T, with 1x1 and 2x2 pivots (complete pivoting)."""
    m = a - s * np.eye(len(a))
    positive, alpha = 0, (1 + 17**0.5) / 8
    while len(m):
        diagonal = np.abs(np.diag(m))
        r = int(np.argmax(diagonal))
        off = np.abs(m - np.diag(np.diag(m)))
        p, q = divmod(int(np.argmax(off)), len(m))
        if not max(diagonal[r], off[p, q]):
            break  # what is left is zero: eigenvalues equal to s
        if diagonal[r] >= alpha * off[p, q]:
            positive += bool(m[r, r] > 0)
            rest = np.delete(np.arange(len(m)), r)
            c = m[rest, r]
            m = m[np.ix_(rest, rest)] - np.outer(c, c / m[r, r])
        else:
            rest = np.delete(np.arange(len(m)), [p, q])
            c, d = m[np.ix_(rest, [p, q])], m[np.ix_([p, q], [p, q])]
            positive += 1  # such a pivot has one eigenvalue of either sign
            m = m[np.ix_(rest, rest)] - c @ np.linalg.solve(d, c.T)
    return positive


def bounds(a: np.ndarray) -> tuple[float, float]:
    """Gershgorin's: no eigenvalue lies outside."""
    radius = np.abs(a).sum(1) - np.abs(np.diag(a))
    return float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())


def _cut(a: np.ndarray, lo: float, hi: float) -> tuple[float, int]:
    """A place between lo and hi that keeps away from eigenvalues as far as a few trials can tell, and how many lie above it."""
    best = None
    for width in (0.02, 0.004, 0.0005):
        for at in (0.5, 0.43, 0.57, 0.36, 0.64):
            s, d = lo + at * (hi - lo), width * (hi - lo)
            n = count_above(a, s + d)
            if count_above(a, s - d) == n:
                return s, n
            best = best or s
    return best, count_above(a, best)


def slices(a: np.ndarray, k: int, floor: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside), from the top down, of at most MOST_INSIDE eigenvalues each (or so narrow that they count as equal), that hold the k largest above floor."""
    low, high = bounds(a)
    pad = 0.01 * max(high - low, abs(high), _EPS)
    out: list[tuple[float, float, int]] = []
    todo = [(floor, high + pad, count_above(a, floor), 0)] if high + pad > floor else []
    found = 0
    while todo and found < k:
        lo, hi, below, above = todo.pop()
        n = below - above
        if not n:
            continue
        if n <= MOST_INSIDE or hi - lo <= 1e-9 * (high + pad):
            out.append((lo, hi, n))
            found += n
            continue
        s, m = _cut(a, lo, hi)
        todo += [(lo, s, below, m), (s, hi, m, above)]
    return out


def eigenpairs(a: np.ndarray, lo: float, hi: float, n: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The n eigenpairs between lo and hi, values falling, vectors as columns. Raises where the projection does not give n of them."""
    size = len(a)
    scale = max(np.abs(a).sum(1).max(), _EPS)
    x, w = np.polynomial.legendre.leggauss(nodes)
    theta = np.pi * (x + 1) / 2  # the upper half circle; the lower one is its conjugate
    mid, radius = (lo + hi) / 2, (hi - lo) / 2
    z = mid + radius * np.exp(1j * theta)
    factor = w * radius * np.exp(1j * theta) / 2
    m = min(size, n + max(4, n // 2))
    q = np.linalg.qr(np.random.default_rng(size * 1000 + n).standard_normal((size, m)))[0]
    shifted = [zk * np.eye(size) - a for zk in z]
    last, values, vectors = np.inf, np.zeros(0), np.zeros((size, 0))
    for _ in range(ROUNDS):
        p = sum(f * np.linalg.solve(s, q) for f, s in zip(factor, shifted, strict=True)).real
        # Rayleigh-Ritz in the span of p; directions that the contour has filtered away are left out
        u, size_of, _ = np.linalg.svd(p, full_matrices=False)
        u = u[:, size_of > 1e-13 * max(size_of[0], _EPS)] if len(size_of) else u
        e, y = np.linalg.eigh(u.T @ a @ u)
        v = u @ y
        inside = np.flatnonzero((e > lo) & (e < hi))
        values, vectors = e[inside], v[:, inside]
        worst = np.abs(a @ vectors - vectors * values).max(initial=0.0)
        if len(values) == n and (worst <= 4 * _EPS * scale or worst >= 0.5 * last and worst <= 1e3 * _EPS * scale):
            break
        last = worst if len(values) == n else np.inf
        q = v if v.shape[1] == m else np.linalg.qr(np.hstack([v, np.random.default_rng(size).standard_normal((size, m - v.shape[1]))]))[0]
    if len(values) != n:
        raise ArithmeticError(f"{len(values)} eigenvalues found between {lo} and {hi}, {n} counted")
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]
