"""Leading eigenpairs of a symmetric matrix that fits one machine, as a covariance of some thousand dimensions does.

Householder reflections make the matrix tridiagonal; Sturm counts bisect the wanted
eigenvalues to the last bit; inverse iteration on the tridiagonal matrix gives their
vectors, which are kept orthogonal inside each cluster of close eigenvalues, and the
reflections carry them back.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps
_CLUSTER = 1e-3  # eigenvalues nearer than this share of the norm are one cluster


def tridiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit vectors of the reflections; vector ``k`` acts on the rows after ``k``."""
    a = np.array(matrix, np.float64)
    size = len(a)
    off, vectors = np.zeros(max(size - 1, 0)), []
    for k in range(size - 2):
        column = a[k + 1 :, k]
        if not column[1:].any():
            off[k] = column[0]
            vectors.append(np.zeros(len(column)))
            continue
        top = np.abs(column).max()
        v = column / top
        length = -np.copysign(np.sqrt(v @ v), v[0])
        off[k] = length * top
        v[0] -= length
        v /= np.sqrt(v @ v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        vectors.append(v)
    if size > 1:
        off[-1] = a[-1, -2]
    return np.diagonal(a).copy(), off, vectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point of ``at``: the negative pivots of T - x."""
    squares = off * off
    least = max(np.finfo(np.float64).tiny, _EPS * _EPS * (squares.max() if len(squares) else 0.0))
    pivot = diagonal[0] - at
    counts = (pivot < 0).astype(np.int64)
    for d, s in zip(diagonal[1:], squares):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - at - s / pivot
        counts += pivot < 0
    return counts


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until the interval holds no further number."""
    around = np.zeros(len(diagonal))
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    norm = np.abs(diagonal).max() + around.max()
    low = np.full(k, (diagonal - around).min() - 2 * _EPS * norm)
    high = np.full(k, (diagonal + around).max() + 2 * _EPS * norm)
    wanted = len(diagonal) - 1 - np.arange(k)  # so many eigenvalues are smaller
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= _EPS * _EPS * norm)).all():
            return middle
        above = sturm_counts(diagonal, off, middle) > wanted
        high = np.where(above, middle, high)
        low = np.where(above, low, middle)


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) y = right by elimination with row exchanges; vanishing pivots become ``least``."""
    size = len(diagonal)
    main = (diagonal - shift).tolist()
    upper, lower = [*off.tolist(), 0.0], off.tolist()
    second, y = [0.0] * size, right.tolist()
    for i in range(size - 1):
        if abs(lower[i]) > abs(main[i]):
            factor = main[i] / lower[i]
            main[i], main[i + 1], upper[i] = lower[i], upper[i] - factor * main[i + 1], main[i + 1]
            second[i], upper[i + 1] = upper[i + 1], -factor * upper[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            if abs(main[i]) < least:
                main[i] = least
            factor = lower[i] / main[i]
            main[i + 1] -= factor * upper[i]
            y[i + 1] -= factor * y[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(size - 1, -1, -1):
        known = y[i]
        if i + 1 < size:
            known -= upper[i] * y[i + 1]
        if i + 2 < size:
            known -= second[i] * y[i + 2]
        y[i] = known / main[i]
    return np.array(y)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling ``values`` by inverse iteration, orthogonal inside clusters."""
    size, k = len(diagonal), len(values)
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0) or 1.0
    vectors = np.zeros((size, k))
    rng = np.random.Generator(np.random.PCG64(13))
    first = 0
    shift = np.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > _CLUSTER * norm:
            first = j
        # Equal eigenvalues get shifts a few units in the last place apart.
        shift = min(values[j], shift - 4 * _EPS * norm) if j > first else values[j]
        y = rng.uniform(-1, 1, size)
        for _ in range(6):
            y /= np.abs(y).max()
            y = _solve_shifted(diagonal, off, shift, y, _EPS * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= vectors[:, first:j] @ (vectors[:, first:j].T @ y)
            y /= np.sqrt(y @ y)
        vectors[:, j] = y
    return vectors


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    size = len(matrix)
    k = min(k, size)
    scale = np.abs(matrix).max() if size else 0.0
    if not k or not scale:
        return np.zeros(k), np.eye(size)[:, :k]
    diagonal, off, reflections = tridiagonalise(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = tridiagonal_vectors(diagonal, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i][:, None]
        vectors[i + 1 :] -= 2 * v * (v.T @ vectors[i + 1 :])
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    return values * scale, vectors
