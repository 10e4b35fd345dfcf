"""Eigenpairs of a symmetric matrix inside an interval, by contour integration.

The spectral projector of an interval is a contour integral of the resolvent. Quadrature on a circle
around the interval, one complex shifted solve for each node, applies it to a block of vectors;
Rayleigh-Ritz takes the eigenpairs out of what comes back. How many there must be is known beforehand
from inertia counts at the two ends, so a missed pair is noticed and the block enlarged.
"""

from __future__ import annotations

import numpy as np

#: Nodes on the upper half of the circle; the lower half is its mirror image.
NODES = 8
#: Turns after which a block that still moves is enlarged.
TURNS = 40
#: Pairs that one contour encloses, unless more lie too close together to be parted.
SLICE = 16
#: Share of the norm below which an eigenvalue counts as zero.
LEAST = 1e-11
_EPS = float(np.finfo(float).eps)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a matrix congruent to ``v`` by reflections, so of the same inertia at any shift."""
    a = np.array(v, dtype=float)
    d = len(a)
    for j in range(d - 2):
        x = a[j + 1:, j].copy()
        length = np.linalg.norm(x)
        if length == 0:
            continue
        x[0] += length if x[0] >= 0 else -length
        x /= np.linalg.norm(x)
        rest = a[j + 1:, j + 1:]
        y = rest @ x
        y -= (x @ y) * x
        rest -= 2 * (np.outer(x, y) + np.outer(y, x))
        a[j + 1:, j] -= 2 * x * (x @ a[j + 1:, j])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues greater than ``shift``: positive pivots of the shifted matrix (inertia)."""
    diagonal, side = tri
    tiny = max(np.abs(diagonal).max(), np.abs(side).max(initial=0.0), 1e-300) * _EPS * _EPS
    pivot, count = 1.0, 0
    for i in range(len(diagonal)):
        pivot = diagonal[i] - shift - (side[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def _from_top(tri: tuple[np.ndarray, np.ndarray], nth: int, low: float, high: float, width: float) -> float:
    """The nth largest eigenvalue to within ``width``, by bisection of the counts."""
    while high - low > width:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if above(tri, middle) >= nth else (low, middle)
    return (low + high) / 2


def inside(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` between ``low`` and ``high``, greatest first."""
    d, norm = len(v), np.abs(v).sum(axis=0).max()
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 + x))
    centre, radius = (low + high) / 2, (high - low) / 2
    shifted = [(centre + radius * t) * np.eye(d) - v for t in turn]
    size = min(d, max(2 * count, count + 6))
    while True:
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
        best, still = np.inf, 0
        for _ in range(TURNS):
            y = sum((weight / 2 * radius) * (t * np.linalg.solve(s, q)).real for weight, t, s in zip(w, turn, shifted))
            q = np.linalg.qr(y)[0]
            reduced = q.T @ v @ q
            values, vectors = np.linalg.eigh((reduced + reduced.T) / 2)
            q, values = (q @ vectors)[:, ::-1], values[::-1]
            off = np.linalg.norm(v @ q - q * values, axis=0)
            at = np.flatnonzero((values > low) & (values < high) & (off <= 1e-9 * norm))
            if len(at) == count:
                worst = off[at].max()
                if worst <= 8 * _EPS * norm or still == 2:
                    return values[at], q[:, at] / np.linalg.norm(q[:, at], axis=0)
                still = still + 1 if worst > best / 2 else 0
                best = min(best, worst)
        if size == d:
            raise ArithmeticError(f"{len(at)} of {count} eigenpairs found between {low} and {high}")
        size, seed = min(d, 2 * size), seed + 1


def leading(v: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` greatest eigenvalues of a positive semidefinite matrix and unit eigenvectors (columns).

    Eigenvalues below ``LEAST`` of the matrix's norm are left out: double precision cannot tell their vectors. The spectrum is cut from the top into
    intervals whose ends lie in gaps; each interval is one contour, checked by its inertia counts.
    """
    d, scale = len(v), float(np.abs(v).sum(axis=0).max(initial=0.0))
    if scale == 0:
        return np.zeros(0), np.zeros((d, 0))
    v = np.asarray(v, dtype=float) / scale
    tri = tridiagonal(v)
    top, floor, width = 1.0 + 1e-3, max(LEAST, 4 * d * _EPS), 4 * d * _EPS
    want = min(many, above(tri, floor))
    values, vectors, done, high = [], [], 0, top
    while done < want:
        upto = min(done + SLICE, want)
        # The end of the interval lies between two eigenvalues that bisection can tell apart.
        while True:
            here = _from_top(tri, upto, -floor, top, width)
            after = _from_top(tri, upto + 1, -1.0, top, width) if upto < d else -1.0
            if here - after > 1e-7 * max(here, floor) or upto == d:
                break
            upto += 1
        low = (here + after) / 2
        some, columns = inside(v, low, high, above(tri, low) - above(tri, high))
        values.append(some)
        vectors.append(columns)
        done, high = upto, low
    return np.concatenate(values)[:want] * scale if values else np.zeros(0), (
        np.concatenate(vectors, axis=1)[:, :want] if vectors else np.zeros((d, 0)))
