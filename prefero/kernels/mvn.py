"""Multivariate normal probabilities on batches of rows, for tasks.

Every function takes arrays whose first axis is the row: limits (N, K) and
covariances (N, K, K) or one (K, K).  The analytic approximations condition one
variable, or one pair, after another: what is left keeps a normal with the mean
and covariance that truncation gives it.  They differ in how many variables each
factor looks at (screening) and how many are truncated at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from prefero.kernels.chain import METHODS, PLAIN, TINY, _factor, chained, density, gradient, phi, phi2
from prefero.kernels.chain import truncated_pair as _truncated_pair

__all__ = ["METHODS", "TINY", "density", "exact", "mvn_cdf", "mvn_cdf_gradient", "mvn_rectangle", "mvn_rectangle_gradient", "phi", "phi2", "truncated_pair"]



def exact(a: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """P(X <= a) of up to four variables."""
    if a.shape[1] == 0:
        return np.ones(len(a))
    return _factor(list(a.T), [0.0] * a.shape[1], _listed(cov), a.shape[1], PLAIN)


def _listed(cov: np.ndarray) -> list[list]:
    """An array a row for each place, or a number where all rows have one matrix."""
    return [[cov[..., i, j] for j in range(cov.shape[-1])] for i in range(cov.shape[-1])]


def truncated_pair(a: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean (N, 2) and covariance (N, 2, 2) of a normal pair below its limits."""
    m, c = _truncated_pair(list(a.T), list(mean.T), _listed(np.broadcast_to(cov, (len(a), 2, 2))), PLAIN)
    return np.stack(m, axis=1), np.stack([np.stack(row, axis=1) for row in c], axis=1)


def _patterns(a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with the same limits of plus infinity, and the variables that those leave; rows with one of minus infinity are left out."""
    never, free = np.isneginf(a).any(axis=1), np.isposinf(a)
    for pattern in np.unique(free, axis=0) if free.any() else free[:1]:
        at = np.flatnonzero((free == pattern).all(axis=1) & ~never)
        if len(at):
            yield at, np.flatnonzero(~pattern)


def mvn_cdf(a: np.ndarray, cov: np.ndarray, method: str = "ovus", draws: int = 1000, seed: int = 0) -> np.ndarray:
    """P(X <= a) for each row.

    A limit of minus infinity makes it 0, one of plus infinity drops its variable.
    One and two variables are exact whatever the method.  Variables are taken by
    rising size of their standardised limits.  Methods: those of METHODS, ``exact``
    (up to four variables) and ``ssj`` (quasi-random simulation).
    """
    a = np.asarray(a, float)
    cov = np.asarray(cov, float)
    out = np.zeros(len(a))
    for at, use in _patterns(a):
        out[at] = _finite(a[np.ix_(at, use)], cov[np.ix_(use, use)] if cov.ndim == 2 else cov[np.ix_(at, use, use)], method, draws, seed)
    return out


def _is_exact(k: int, method: str) -> bool:
    return k <= 2 or method in ("exact", "scipy") and k <= 4


def _ordered(a: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """The order in which each row's variables are taken."""
    return np.argsort(np.abs(a / np.sqrt(np.maximum(np.einsum("...kk->...k", cov), 1e-30))), axis=1, kind="stable")


def _taken(a: np.ndarray, cov: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Limits and covariances of each row in its order; those of one place lie side by side in memory."""
    rows, order = np.arange(len(a)), order.T
    i, j = order[:, None], order[None, :]
    return a[rows, order].T, np.moveaxis(cov[i, j] if cov.ndim == 2 else cov[rows, i, j], -1, 0)


def _finite(a: np.ndarray, cov: np.ndarray, method: str, draws: int, seed: int) -> np.ndarray:
    k = a.shape[1]
    if _is_exact(k, method):
        return exact(a, cov)
    if method in ("ssj", "exact", "scipy"):
        return simulated(a, cov, draws if method == "ssj" else 20_000, seed)
    a, cov = _taken(a, cov, _ordered(a, cov))
    return chained(list(a.T), _listed(cov), method)


def mvn_cdf_gradient(a: np.ndarray, cov: np.ndarray, method: str = "ovus") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(X <= a) by row, and its derivatives by limits (N, K) and covariances (N, K, K), of the very approximation.

    A covariance's derivative is shared between its two places.  Infinite limits have none.
    """
    a = np.asarray(a, float)
    n, k = a.shape
    cov = np.broadcast_to(np.asarray(cov, float), (n, k, k))
    value, by_limit, by_cov = np.zeros(n), np.zeros((n, k)), np.zeros((n, k, k))
    for at, use in _patterns(a):
        size = len(use)
        if not size:
            value[at] = 1.0
            continue
        part, c = a[np.ix_(at, use)], cov[at][:, use][:, :, use]
        if _is_exact(size, method):
            order, of = np.tile(np.arange(size), (len(at), 1)), lambda z, v, m: _factor(z, [x * 0.0 for x in z], v, len(z), m)
        elif method in METHODS:
            order, of = _ordered(part, c), lambda z, v, m: chained(z, v, method, m)
        else:
            raise ValueError(f"no closed gradient of {method!r} for {size} variables")
        value[at], d, s = gradient(*_taken(part, c, order), of)
        to = use[order]  # where each place of the ordered variables came from
        rows = at[:, None]
        by_limit[rows, to] = d
        by_cov[rows[:, :, None], to[:, :, None], to[:, None, :]] = s
    return value, by_limit, by_cov


def log_mvn_cdf(a: np.ndarray, cov: np.ndarray, method: str = "me") -> np.ndarray:
    return np.log(np.maximum(mvn_cdf(a, cov, method), TINY))


def truncated_moments(a: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of normals below their limits, variable after variable: each truncation moves all others.

    One truncation leaves a normal approximation, so more than one variable is approximate.
    """
    mean, cov = np.array(mean, float), np.array(np.broadcast_to(cov, (len(a), a.shape[1], a.shape[1])), float)
    for i in range(a.shape[1]):
        sd = np.sqrt(np.maximum(cov[:, i, i], 1e-15))
        w = (a[:, i] - mean[:, i]) / sd
        shift = -density(w) / np.maximum(phi(w), TINY)
        kept = np.maximum(1 + shift * (w - shift), 1e-15)
        along = cov[:, :, i] / sd[:, None]
        mean = mean + along * shift[:, None]
        cov = cov - (1 - kept)[:, None, None] * along[:, :, None] * along[:, None, :]
    return mean, cov


def greedy_order(a: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Order of one row's variables: next is always the one whose limit is least likely met, given those before."""
    left, mean, cov, out = list(range(len(a))), np.zeros(len(a)), np.array(cov, float), []
    while left:
        w = [(a[i] - mean[i]) / np.sqrt(max(cov[i, i], 1e-15)) for i in left]
        i = left.pop(int(np.argmin(w)))
        out.append(i)
        z = (a[i] - mean[i]) / np.sqrt(max(cov[i, i], 1e-15))
        shift = float(-density(np.array([z]))[0] / max(phi(np.array([z]))[0], TINY)) * np.sqrt(max(cov[i, i], 1e-15))
        slope = cov[:, i] / max(cov[i, i], 1e-15)
        mean, cov = mean + slope * shift, cov - np.outer(slope, cov[i])
    return np.array(out)


def halton(n: int, dims: int, seed: int = 0) -> np.ndarray:
    """Van der Corput sequences in the first primes, shifted at random modulo one."""
    primes: list[int] = []
    c = 2
    while len(primes) < dims:
        if all(c % p for p in primes):
            primes.append(c)
        c += 1
    out = np.zeros((n, dims))
    for j, p in enumerate(primes):
        i, scale = np.arange(1, n + 1), 1.0 / p
        while i.any():
            out[:, j] += (i % p) * scale
            i, scale = i // p, scale / p
    return (out + np.random.default_rng(seed).random(dims)) % 1.0


def simulated(a: np.ndarray, cov: np.ndarray, draws: int = 1000, seed: int = 0) -> np.ndarray:
    """Separation of variables over quasi-random points."""
    from prefero.functions.distributions import normal_ppf

    n, k = a.shape
    points = halton(draws, max(k - 1, 1), seed)
    low = np.broadcast_to(np.linalg.cholesky(cov + np.eye(k) * 1e-12), (n, k, k))
    y, mass = np.zeros((n, draws, k)), np.ones((n, draws))
    for i in range(k):
        e = phi((a[:, i, None] - np.einsum("ndj,nj->nd", y[:, :, :i], low[:, i, :i])) / low[:, i, i, None])
        mass *= e
        if i < k - 1:
            y[:, :, i] = np.clip(normal_ppf(np.clip(e * points[None, :, i], 1e-300, 1 - 1e-16)), -38, 38)
    return mass.mean(axis=1)


def mvn_rectangle(lower: np.ndarray, upper: np.ndarray, cov: np.ndarray, method: str = "ovus") -> np.ndarray:
    """P(lower < X <= upper) by inclusion and exclusion over the corners."""
    k = lower.shape[1]
    out = np.zeros(len(lower))
    for mask in range(1 << k):
        low = np.array([mask >> i & 1 for i in range(k)], bool)
        out += (-1) ** int(low.sum()) * mvn_cdf(np.where(low, lower, upper), cov, method)
    return np.clip(out, 0.0, 1.0)


def mvn_rectangle_gradient(lower: np.ndarray, upper: np.ndarray, cov: np.ndarray, method: str = "ovus") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P(lower < X <= upper) by row, and its derivatives by both limits (N, K) and by covariances (N, K, K).

    A sum of signed terms over the corners; a side of minus infinity has no corner, one of plus infinity drops its variable.
    """
    n, k = lower.shape
    value, by = np.zeros(n), np.zeros((2, n, k))
    by_cov = np.zeros((n, k, k))
    for mask in range(1 << k):
        low = np.array([mask >> i & 1 for i in range(k)], bool)
        sign = (-1) ** int(low.sum())
        p, d, s = mvn_cdf_gradient(np.where(low, lower, upper), cov, method)
        value += sign * p
        by[0][:, low] += sign * d[:, low]
        by[1][:, ~low] += sign * d[:, ~low]
        by_cov += sign * s
    return value, by[0], by[1], by_cov


def mvn_density(x: np.ndarray, cov: np.ndarray) -> np.ndarray:
    low = np.linalg.cholesky(np.broadcast_to(cov, (len(x), *cov.shape[-2:])))
    z = np.linalg.solve(low, x[:, :, None])[:, :, 0]
    return np.exp(-0.5 * (z * z).sum(axis=1)) / np.prod(np.einsum("nkk->nk", low), axis=1) / (2 * np.pi) ** (x.shape[1] / 2)


def truncated_mvn_density(x: np.ndarray, lower: np.ndarray, upper: np.ndarray, cov: np.ndarray, method: str = "me") -> np.ndarray:
    inside = ((x >= lower) & (x <= upper)).all(axis=1)
    return np.where(inside, mvn_density(x, cov) / np.maximum(mvn_rectangle(lower, upper, cov, method), TINY), 0.0)


def truncated_mvn_cdf(x: np.ndarray, lower: np.ndarray, upper: np.ndarray, cov: np.ndarray, method: str = "me") -> np.ndarray:
    top = np.minimum(x, upper)
    part = np.where((top > lower).all(axis=1), mvn_rectangle(lower, top, cov, method), 0.0)
    return part / np.maximum(mvn_rectangle(lower, upper, cov, method), TINY)


def partial_mvn(points: np.ndarray, limits: np.ndarray, cov: np.ndarray, method: str = "ovus") -> np.ndarray:
    """Density of the first variables at ``points`` times the probability of the others below ``limits`` given them."""
    d = points.shape[1]
    cov = np.broadcast_to(cov, (len(points), *cov.shape[-2:]))
    slope = np.linalg.solve(cov[:, :d, :d], cov[:, :d, d:])
    mean = np.einsum("ndr,nd->nr", slope, points)
    rest = cov[:, d:, d:] - np.einsum("ndr,nds->nrs", slope, cov[:, :d, d:])
    return mvn_density(points, cov[:, :d, :d]) * mvn_cdf(limits - mean, rest, method)
