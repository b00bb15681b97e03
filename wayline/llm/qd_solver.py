"""Singular values and right singular vectors of a small triangle: Householder, dqds and twisted factorisations.

Used on the one triangular factor that blockwise QR leaves of a table; its side is the number of dimensions.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = float(np.finfo(float).eps)
_TINY = 1e-290


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector of the reflection that turns x into a multiple of the first axis, None if it is one already."""
    scale = np.abs(x).max(initial=0.0)
    if scale == 0 or not np.abs(x[1:]).max(initial=0.0):
        return None
    u = x / scale
    u[0] += math.copysign(float(np.linalg.norm(u)), u[0])
    return u / np.linalg.norm(u)


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """diagonal, superdiagonal and v, so that matrix = u @ bidiagonal @ v.T for some orthogonal u."""
    a, d = np.array(matrix, float), matrix.shape[1]
    v = np.eye(d)
    for k in range(d):
        u = _reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= np.outer(2 * u, u @ a[k:, k:])
        if k < d - 2:
            u = _reflector(a[k, k + 1 :])
            if u is not None:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ u, 2 * u)
                v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ u, 2 * u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _pair(q1: float, e1: float, q2: float) -> tuple[float, float]:
    """The eigenvalues, larger first, that a segment of two stands for."""
    half, det = (q1 + e1 + q2) / 2, q1 * q2
    if half <= 0:
        return 0.0, 0.0
    high = half + math.sqrt(max(0.0, half * half - det))
    return high, det / high


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One differential qd step: the new q and e, the last d, and whether every d stayed positive up to there."""
    d, new_q, new_e = q[0] - shift, [], []
    for i in range(len(e)):
        if d < 0:
            return new_q, new_e, d, False
        now = d + e[i]
        part = q[i + 1] / now if now > 0 else 0.0
        new_q.append(now)
        new_e.append(e[i] * part)
        d = d * part - shift if now > 0 else q[i + 1] - shift
    new_q.append(d)
    return new_q, new_e, d, True


def dqds(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """The squares of a bidiagonal's singular values, descending, each to high relative accuracy.

    Shifts come from the last two rows; one that overshoots is taken back by what is missing, then halved, then left out,
    so no q turns negative. A segment ends where an e is negligible beside what has been shifted off and its neighbours.
    """
    top = max(np.abs(diagonal).max(initial=0.0), np.abs(superdiagonal).max(initial=0.0))
    if not len(diagonal) or top == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    segments = [([float(x) ** 2 for x in diagonal / top], [float(x) ** 2 for x in superdiagonal / top], 0.0)]
    tol = (10 * _EPS) ** 2
    steps, limit = 0, 100 * (len(diagonal) + 10)
    while segments:
        q, e, sigma = segments.pop()
        while len(q) > 2:
            cuts = [i for i in range(len(e)) if e[i] <= tol * (sigma + min(q[i], q[i + 1])) or e[i] <= _TINY]
            if cuts:
                at = cuts[-1]
                segments.append((q[: at + 1], e[:at], sigma))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = min(_pair(q[-2], e[-1], q[-1])[1], q[-1])
            for attempt in range(60):
                new_q, new_e, last, upright = _transform(q, e, shift)
                if upright and last >= 0:
                    break
                shift = shift + last if upright and attempt == 0 and shift + last > 0 else shift / 2 if attempt < 6 else 0.0
            q, e, sigma = new_q, new_e, sigma + shift
            steps += 1
            if steps > limit:
                raise ArithmeticError("dqds doesn't converge")
        if len(q) == 2:
            found += [x + sigma for x in _pair(q[0], e[0], q[1])]
        elif q:
            found.append(q[0] + sigma)
    return np.sort(np.array(found))[::-1] * top * top


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit vector that a twisted factorisation of bidiagonal.T @ bidiagonal - value solves for."""
    m = len(a)
    plus, minus, down, up = np.zeros(m), np.zeros(m), np.zeros(m), np.zeros(m)
    s = -value
    for i in range(m):
        down[i] = s
        if i < m - 1:
            pivot = a[i] * a[i] + s
            pivot = pivot if pivot else _TINY
            plus[i] = a[i] * b[i] / pivot
            s = plus[i] * (b[i] / a[i]) * s - value
    p = a[-1] * a[-1] - value
    up[-1] = p
    for i in range(m - 2, -1, -1):
        pivot = b[i] * b[i] + p
        pivot = pivot if pivot else _TINY
        minus[i] = a[i] * b[i] / pivot
        p = p * (a[i] * a[i] / pivot) - value
        up[i] = p
    gamma = np.abs(down + up + value)
    r = int(np.argmin(np.where(np.isfinite(gamma), gamma, np.inf)))
    z = np.zeros(m)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, m - 1):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z


def right_vectors(diagonal: np.ndarray, superdiagonal: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors, as columns, of bidiagonal.T @ bidiagonal for its largest eigenvalues, given in descending order.

    Each vector is set apart from those before it; one of a repeated eigenvalue that is lost by that is found again by
    inverse iteration beside the others.
    """
    m = len(diagonal)
    floor = _EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(superdiagonal).max(initial=0.0), _TINY)
    a = np.where(np.abs(diagonal) < floor, floor, diagonal)
    draw, out = np.random.default_rng(7), []
    for value in squares:
        z = _apart(_twisted(a, superdiagonal, float(value)), out)
        if not np.linalg.norm(z) > 0.5:
            b = np.diag(a) + np.diag(superdiagonal, 1)
            shifted = b.T @ b - (value + 8 * _EPS * squares[0]) * np.eye(m)
            z = _apart(draw.standard_normal(m), out)
            for _ in range(4):
                z = _apart(np.linalg.solve(shifted, z / np.linalg.norm(z)), out)
        out.append(z / np.linalg.norm(z))
    return np.array(out).T if out else np.zeros((m, 0))


def principal_axes(triangle: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of a triangle, descending, and the right singular vectors, as columns, of the first ones.

    Vectors are given for at most so many values, and only for those that tell from rounding (over the dimensions times
    the unit roundoff, beside the largest).
    """
    diagonal, superdiagonal, v = bidiagonalise(triangle)
    squares = dqds(diagonal, superdiagonal)
    rank = int((squares > (len(squares) * _EPS) ** 2 * squares[0]).sum()) if len(squares) and squares[0] > 0 else 0
    return squares, v @ right_vectors(diagonal, superdiagonal, squares[: rank if most is None else min(rank, most)])
