"""Small matrices on the driver: half-vectors, correlations from free parameters, derivatives by chain."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def half_vector(a: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Upper triangle row by row, with or without the diagonal."""
    return np.asarray(a, float)[np.triu_indices(len(a), 0 if diagonal else 1)]


def from_half_vector(v: np.ndarray, diagonal: bool = True, ones: bool = False) -> np.ndarray:
    """Symmetric matrix of a half-vector; a missing diagonal is zero, or one with ``ones``."""
    n = int(round((np.sqrt(8 * len(v) + 1) + (-1 if diagonal else 1)) / 2))
    out = np.eye(n) if ones and not diagonal else np.zeros((n, n))
    i, j = np.triu_indices(n, 0 if diagonal else 1)
    out[i, j] = out[j, i] = v
    return out


def symmetric(a: np.ndarray) -> np.ndarray:
    """The upper triangle mirrored."""
    u = np.triu(a)
    return u + np.triu(a, 1).T


def off_diagonal(a: np.ndarray) -> np.ndarray:
    return np.asarray(a)[~np.eye(len(a), dtype=bool)]


def correlation_of_angles(theta: np.ndarray) -> np.ndarray:
    """Correlation matrix of free parameters: each row of its factor is a point of the sphere, with angles pi * logistic(theta).

    Parameters are the lower triangle row by row.
    """
    n = int(round((1 + np.sqrt(1 + 8 * len(theta))) / 2))
    factor = np.zeros((n, n))
    factor[0, 0] = 1.0
    at = 0
    for i in range(1, n):
        angle = np.pi / (1 + np.exp(-np.asarray(theta[at : at + i], float)))
        at += i
        factor[i, : i + 1] = np.append(np.cos(angle), 1.0) * np.append(1.0, np.cumprod(np.sin(angle)))
    return factor @ factor.T


def angles_of_correlation(r: np.ndarray) -> np.ndarray:
    """The inverse of ``correlation_of_angles``."""
    low = np.linalg.cholesky(r)
    out = []
    for i in range(1, len(r)):
        left = 1.0
        for j in range(i):
            angle = np.arccos(np.clip(low[i, j] / max(left, 1e-300), -1 + 1e-12, 1 - 1e-12))
            out.append(np.log(angle / (np.pi - angle)))
            left *= np.sin(angle)
    return np.array(out)


def correlation_of_tanh(theta: np.ndarray) -> np.ndarray:
    """Each correlation by itself as tanh of a parameter; need not be positive definite."""
    return from_half_vector(np.tanh(np.asarray(theta, float)), diagonal=False, ones=True)


def split_covariance(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviations and correlations."""
    sd = np.sqrt(np.diag(cov))
    return sd, cov / np.outer(sd, sd)


def jacobian(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float = 1e-6) -> np.ndarray:
    """Derivatives of every entry of f by every entry of x, by central differences."""
    x = np.asarray(x, float)
    out = []
    for i in range(len(x)):
        e = np.zeros(len(x))
        e[i] = step * (1 + abs(x[i]))
        out.append((np.ravel(f(x + e)) - np.ravel(f(x - e))) / (2 * e[i]))
    return np.array(out)


def d_sandwich_by_left(a: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """d vech(A Omega A') / d A, rows by the entries of A."""
    return jacobian(lambda v: half_vector(v.reshape(a.shape) @ omega @ v.reshape(a.shape).T), np.ravel(a))


def d_sandwich_by_middle(a: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """d vech(A Omega A') / d vech(Omega)."""
    i, j = np.triu_indices(len(omega))
    each = a.T[i][:, :, None] * a.T[j][:, None, :]
    each = np.where((i != j)[:, None, None], each + each.transpose(0, 2, 1), each)
    return each[:, *np.triu_indices(len(a))]


def d_inverse(a: np.ndarray) -> np.ndarray:
    """d vech(A^-1) / d vech(A) for symmetric A."""
    inv = np.linalg.inv(a)
    return -d_sandwich_by_middle(inv, a)


def d_covariance(cov: np.ndarray) -> np.ndarray:
    """d vech(covariance) / d (standard deviations, correlations)."""
    sd, r = split_covariance(cov)
    n = len(sd)
    i, j = np.triu_indices(n)
    by_sd = np.array([np.where(i == k, sd[j], 0) + np.where(j == k, sd[i], 0) for k in range(n)]) * r[i, j]
    p, q = np.triu_indices(n, 1)
    by_r = ((i[None] == p[:, None]) & (j[None] == q[:, None])) * (sd[p] * sd[q])[:, None]
    return np.vstack([by_sd, by_r])


def chain(*factors: np.ndarray) -> np.ndarray:
    """Derivatives chained from the innermost parameter outwards."""
    out = factors[0]
    for f in factors[1:]:
        out = out @ f
    return out


def ldlt(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower factor and diagonal of a symmetric matrix."""
    low = np.linalg.cholesky(np.asarray(a, float))
    d = np.diag(low)
    return low / d, d * d


def ldlt_update(low: np.ndarray, d: np.ndarray, v: np.ndarray, alpha: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of A + v alpha v', for a vector (rank one) or two columns (rank two)."""
    v = np.asarray(v, float).reshape(len(d), -1)
    middle = np.atleast_2d(alpha) if np.ndim(alpha) else np.eye(v.shape[1]) * alpha
    return ldlt(low @ np.diag(d) @ low.T + v @ middle @ v.T)
