"""Small dense linear algebra over stacked arrays: many systems at a time,
one row of the input each (used inside Arrow batches)."""

from __future__ import annotations

import math

import numpy as np

#: A pivot this small against its diagonal entry makes a system singular.
PIVOT_FLOOR = 1e-9
#: Residuals this small against the total are rounding: the fit is perfect.
RESIDUAL_FLOOR = 1e-20


def eliminate_in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Take the columns of stacked designs (n, rows, k + 1) out of the columns
    after them, one by one (modified Gram-Schmidt); the last is the response.

    Per column, as (n, k): whether it is independent of those before it, its
    squared length by then, its product with what is left of the response, and
    the response's residual sum of squares after it, which is that of the
    regression on the columns so far.  Dependent columns take nothing out.
    """
    a = rows.astype(np.float64, copy=True)
    own = (a ** 2).sum(axis=1)
    n, k = len(a), a.shape[2] - 1
    live, norm, dot, rest = np.zeros((n, k), bool), np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    for j in range(k):
        pivot = a[:, :, j]
        norm[:, j] = (pivot ** 2).sum(axis=1)
        live[:, j] = norm[:, j] > PIVOT_FLOOR * own[:, j]
        shared = np.einsum("nr,nrc->nc", pivot, a[:, :, j + 1:])
        dot[:, j] = shared[:, -1]
        factor = np.where(live[:, j], 1.0 / np.where(live[:, j], norm[:, j], 1.0), 0.0)
        a[:, :, j + 1:] -= pivot[:, :, None] * (shared * factor[:, None])[:, None, :]
        rest[:, j] = (a[:, :, k] ** 2).sum(axis=1)
    return live, norm, dot, np.where(rest > RESIDUAL_FLOOR * own[:, k:], rest, 0.0)


def stacked_triangles(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Triangular factors (groups, c, c) of consecutive runs of ``rows``
    (n, c) of the given sizes, by orthogonal reflections.  Runs of similar
    size are padded with zero rows, which change no factor, and factored
    together."""
    c = rows.shape[1]
    out = np.zeros((len(size), c, c))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    padded = np.maximum(c, 2 ** np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    for height in np.unique(padded):
        own = np.flatnonzero(padded == height)
        place = np.arange(height)[None, :]
        inside = place < size[own, None]
        stack = np.where(inside[:, :, None], rows[np.where(inside, begin[own, None] + place, 0)], 0.0)
        out[own] = np.linalg.qr(stack, mode="r")
    return out


def fit_triangles(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least squares of the last column on the others, from triangular factors
    (n, k + 1, k + 1): coefficients, diagonal of the inverse of X'X, residual
    and total sums of squares, and a mask of the systems of full rank."""
    k = r.shape[2] - 1
    x = r[:, :k, :k]
    own = np.abs(x[:, np.arange(k), np.arange(k)])
    length = np.sqrt((x ** 2).sum(axis=1))
    regular = (own ** 2 > PIVOT_FLOOR * length ** 2).all(axis=1)
    x = np.where(regular[:, None, None], x, np.eye(k))
    scale = np.where(regular[:, None], length, 1.0)
    inverse = np.linalg.solve(x / scale[:, None, :], np.broadcast_to(np.eye(k), x.shape)) / scale[:, :, None]
    beta = (inverse @ r[:, :k, k:])[:, :, 0]
    total = (r[:, :, k] ** 2).sum(axis=1)
    rest = r[:, k, k] ** 2
    return beta, (inverse ** 2).sum(axis=2), np.where(rest > RESIDUAL_FLOOR * total, rest, 0.0), total, regular


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                     -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
    value = np.where(y <= 0, 0.0, front * f)
    return np.where(swap, 1 - value, value)


def t_test_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    known = np.isfinite(t) & (dof > 0)
    safe_t, safe_dof = np.where(known, t, 0.0), np.where(known, dof, 1.0)
    p = incomplete_beta(safe_dof / 2, 0.5, safe_dof / (safe_dof + safe_t * safe_t))
    return np.where(known, p, np.nan)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))
