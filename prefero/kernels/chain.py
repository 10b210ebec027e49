"""The conditioning recursion of multivariate normal probabilities, and its reverse sweep.

The recursion is written on one number per row for each mean, variance and covariance, over a
namespace ``m`` (see ``prefero.functions.algebra``): ``PLAIN`` takes arrays, ``TRACED`` takes ``Traced``
arrays, which remember how they came about.  ``gradient`` then sweeps back once and gives the
derivatives of the very approximation by all limits and covariances, whatever their number.
"""

from __future__ import annotations

import itertools

import numpy as np

from prefero.functions.algebra import ARRAYS
from prefero.functions.distributions import normal_cdf, normal_pdf

TINY = 1e-300
#: method: variables truncated at a time, variables in the first factor, further variables that each later factor looks at.
METHODS = {"me": (1, 1, 0), "ovus": (1, 2, 1), "ovbs": (1, 3, 2), "bme": (2, 2, 0), "tvbs": (2, 4, 0), "tg": (1, 1, 0), "tgbme": (2, 2, 0)}
#: Methods that take what is truncated as known: only means move, spread is the conditional one.
FIXED = ("tg", "tgbme")
#: Up to which |correlation| so many nodes do over the angle; beyond the last, panels narrow towards the end.
LEVELS, COUNTS = (0.3, 0.75, 0.85), (6, 12, 20)
RULES = [np.polynomial.legendre.leggauss(n) for n in COUNTS]
EDGES = (0.0, 0.5, 0.75, 0.875, 0.9375, 0.96875, 0.99, 1.0)
#: The same for integrals of three and four variables.
LONG_LEVELS = (0.3, 0.7)
#: A correlation matrix with no smaller eigenvalue is smooth enough for the first rule up to the last level: in trials over random matrices no error above 1e-15.
SMOOTH = 0.2


def phi(x: np.ndarray) -> np.ndarray:
    return normal_cdf(np.clip(x, -40, 40), ARRAYS)


def density(x: np.ndarray) -> np.ndarray:
    return normal_pdf(np.clip(x, -40, 40), ARRAYS)


def _panels(rule: tuple[np.ndarray, np.ndarray], edges: tuple[float, ...] = (0.0, 1.0)) -> list[tuple[float, float]]:
    """Places and weights on [0, 1]."""
    return [(a + (b - a) * (1 + x) / 2, w * (b - a) / 2) for a, b in itertools.pairwise(edges) for x, w in zip(*rule, strict=True)]


PLANS = [*map(_panels, RULES), _panels(RULES[-1], EDGES)]
LONG_PLANS = [_panels(np.polynomial.legendre.leggauss(14)), _panels(np.polynomial.legendre.leggauss(24)), _panels(np.polynomial.legendre.leggauss(24), EDGES)]


def _along_angle(h: np.ndarray, k: np.ndarray, rho: np.ndarray, plan: list[tuple[float, float]]) -> np.ndarray:
    end, both, squares = np.arcsin(rho), h * k, (h * h + k * k) / 2
    out = np.zeros(np.broadcast_shapes(both.shape, end.shape))
    for x, w in plan:
        s = np.sin(end * x)
        out += w * np.exp(np.minimum((s * both - squares) / (1 - s * s), 0.0))
    return end * out / (2 * np.pi)


def phi2(h: np.ndarray, k: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """Bivariate normal distribution by the integral over the angle; rows take as many nodes as their correlation asks for."""
    h, k, rho = np.clip(h, -40, 40), np.clip(k, -40, 40), np.clip(rho, -0.99999, 0.99999)
    out = phi(h) * phi(k)
    if rho.size and rho.min() == rho.max():  # one correlation for all rows
        one = rho.ravel()[0]
        return np.clip(out + _along_angle(h, k, one, PLANS[int(np.searchsorted(LEVELS, abs(one)))]), 0.0, 1.0)
    h, k, rho = np.broadcast_arrays(h, k, rho)
    out = np.broadcast_to(out, h.shape).copy()
    level = np.searchsorted(LEVELS, np.abs(rho))
    for x in np.unique(level):
        at = level == x
        out[at] += _along_angle(h[at], k[at], rho[at], PLANS[x])
    return np.clip(out, 0.0, 1.0)


def density2(h: np.ndarray, k: np.ndarray, rho: np.ndarray) -> np.ndarray:
    h, k, rho = np.clip(h, -40, 40), np.clip(k, -40, 40), np.clip(rho, -0.99999, 0.99999)
    q = 1 - rho * rho
    return np.exp(np.minimum(-(h * h - 2 * rho * h * k + k * k) / (2 * q), 0)) / (2 * np.pi * np.sqrt(q))


def _given_pair(z1, zk, za, r1k, r1a, rka) -> tuple[np.ndarray, np.ndarray]:
    """Limit of a third variable less its mean, and its variance, given that two stand at their limits."""
    q = np.maximum(1 - r1k * r1k, 1e-14)
    mean = (r1a - rka * r1k) / q * z1 + (rka - r1k * r1a) / q * zk
    var = 1 - (r1a * r1a - 2 * r1k * r1a * rka + rka * rka) / q
    return za - mean, np.maximum(var, 1e-14)


def _plackett(z: list, r: list[list], last, plan: list[tuple[float, float]]) -> np.ndarray:
    """What correlations of the first variable add: over each one's angle, the pair's density times ``last``, the rest given the pair.

    All correlations of the first variable grow together from zero, so each step is one integral.
    """
    n, out = len(z), 0.0
    for k in range(1, n):
        rho = r[0][k]
        end = np.arcsin(rho)
        safe = np.where(np.abs(rho) > 1e-12, rho, 1.0)
        rest = [i for i in range(1, n) if i != k]
        both, squares = z[0] * z[k], (z[0] * z[0] + z[k] * z[k]) / 2
        for x, w in plan:
            s = np.sin(end * x)
            t = np.where(np.abs(rho) > 1e-12, s / safe, 0.0)
            weight = np.exp(np.minimum((s * both - squares) / (1 - s * s), 0.0))
            of = [_given_pair(z[0], z[k], z[i], s, t * r[0][i], r[k][i]) for i in rest]
            if len(rest) == 2:
                a, b = rest
                cross = r[a][b] - (t * t * r[0][a] * r[0][b] - s * t * (r[0][a] * r[k][b] + r[k][a] * r[0][b]) + r[k][a] * r[k][b]) / np.maximum(1 - s * s, 1e-14)
                inside = last([u / np.sqrt(v) for u, v in of], cross / np.sqrt(of[0][1] * of[1][1]))
            else:
                inside = last([u / np.sqrt(v) for u, v in of], None)
            out = out + weight * inside * (end * w)
    return out / (2 * np.pi)


def _rearranged(z: list, r: list[list], first: np.ndarray) -> tuple[list, list[list]]:
    """The variables of each row with number ``first`` in front, the others in order."""
    n, rows = len(z), np.arange(len(z[0]))
    order = np.array([[f, *[i for i in range(n) if i != f]] for f in range(n)])[first]
    zs, rs = np.stack(z, axis=1), np.stack([np.stack([np.broadcast_to(x, len(rows)) for x in row], axis=1) for row in r], axis=1)
    take = [[rs[rows, order[:, i], order[:, j]] for j in range(n)] for i in range(n)]
    return [zs[rows, order[:, i]] for i in range(n)], take


def _front(r: list[list], n: int) -> np.ndarray:
    """The variable whose greatest correlation is least, by row."""
    return np.stack([np.max([np.abs(r[i][j]) for j in range(n) if j != i], axis=0) for i in range(n)], axis=1).argmin(axis=1)


def normal(z: list, r: list[list]) -> np.ndarray:
    """Distribution of up to four standard normal variables with correlations r[i][j].

    Three are one integral of univariate values and four one of bivariate values, beside the value with
    the first variable independent.
    """
    n = len(z)
    if n == 1:
        return phi(z[0])
    if n == 2:
        return phi2(z[0], z[1], r[0][1])
    z = [np.clip(np.asarray(x, float), -40, 40) for x in z]
    last = (lambda u, _: phi(u[0])) if n == 3 else (lambda u, c: phi2(u[0], u[1], np.clip(c, -0.99999, 0.99999)))
    if all(np.ndim(r[i][j]) == 0 for i in range(n) for j in range(n) if i != j):  # one correlation matrix for all rows
        one = np.array([[1.0 if i == j else np.clip(r[i][j], -0.99999, 0.99999) for j in range(n)] for i in range(n)])
        first = int(np.abs(one - np.eye(n)).max(axis=1).argmin())
        order = [first, *[i for i in range(n) if i != first]]
        z, one = [z[i] for i in order], one[np.ix_(order, order)]
        level = int(np.searchsorted(LONG_LEVELS, np.abs(one[0, 1:]).max()))
        if level == 1 and np.linalg.eigvalsh(one)[0] >= SMOOTH:
            level = 0
        return np.clip(phi(z[0]) * normal(z[1:], one[1:, 1:]) + _plackett(z, one, last, LONG_PLANS[level]), 0.0, 1.0)
    shape = np.broadcast_shapes(*[x.shape for x in z], *[np.shape(r[i][j]) for i in range(n) for j in range(i)])
    z, r = _rearranged([np.broadcast_to(x, shape) for x in z], [[np.broadcast_to(1.0 if i == j else np.clip(r[i][j], -0.99999, 0.99999), shape) for j in range(n)] for i in range(n)], np.broadcast_to(_front(r, n), shape))
    out = phi(z[0]) * normal(z[1:], [row[1:] for row in r[1:]])
    level = np.searchsorted(LONG_LEVELS, np.max([np.abs(r[0][k]) for k in range(1, n)], axis=0))
    for x in np.unique(level):  # rows take as many nodes as their correlations ask for
        at = level == x
        out[at] += _plackett([y[at] for y in z], [[y[at] for y in row] for row in r], last, LONG_PLANS[x])
    return np.clip(out, 0.0, 1.0)


def normal_slopes(z: list, r: list[list]) -> tuple[list, dict[tuple[int, int], np.ndarray]]:
    """Derivatives of ``normal`` by each limit and each correlation: densities times what is left given them."""
    n = len(z)
    by_limit, by_corr = [], {}
    for i in range(n):
        others = [j for j in range(n) if j != i]
        left = [np.sqrt(np.maximum(1 - r[i][j] ** 2, 1e-14)) for j in others]
        u = [(z[j] - r[i][j] * z[i]) / s for j, s in zip(others, left, strict=True)]
        part = [[1.0 if a == b else np.clip((r[a][b] - r[i][a] * r[i][b]) / (left[x] * left[y]), -0.99999, 0.99999) for y, b in enumerate(others)] for x, a in enumerate(others)]
        by_limit.append(density(z[i]) * (normal(u, part) if others else 1.0))
    for i, j in itertools.combinations(range(n), 2):
        others = [k for k in range(n) if k not in (i, j)]
        of = [_given_pair(z[i], z[j], z[k], r[i][j], r[i][k], r[j][k]) for k in others]
        u = [x / np.sqrt(v) for x, v in of]
        if len(others) == 2:
            a, b = others
            cross = r[a][b] - (r[i][a] * r[i][b] - r[i][j] * (r[i][a] * r[j][b] + r[j][a] * r[i][b]) + r[j][a] * r[j][b]) / np.maximum(1 - r[i][j] ** 2, 1e-14)
            given = phi2(u[0], u[1], np.clip(cross / np.sqrt(of[0][1] * of[1][1]), -0.99999, 0.99999))
        else:
            given = phi(u[0]) if others else 1.0
        by_corr[i, j] = density2(z[i], z[j], r[i][j]) * given
    return by_limit, by_corr


class Traced:
    """An array with what it was made of: pairs of a traced array and the derivative by it."""

    __slots__ = ("value", "of", "adjoint")

    def __init__(self, value: np.ndarray, of: tuple = ()) -> None:
        self.value, self.of, self.adjoint = value, of, None

    def __add__(self, other):
        return Traced(self.value + other.value, ((self, 1.0), (other, 1.0))) if isinstance(other, Traced) else Traced(self.value + other, ((self, 1.0),))

    def __mul__(self, other):
        return Traced(self.value * other.value, ((self, other.value), (other, self.value))) if isinstance(other, Traced) else Traced(self.value * other, ((self, other),))

    def __truediv__(self, other):
        if not isinstance(other, Traced):
            return self * (1.0 / other)
        ratio = self.value / other.value
        return Traced(ratio, ((self, 1.0 / other.value), (other, -ratio / other.value)))

    def __neg__(self):
        return Traced(-self.value, ((self, -1.0),))

    def __sub__(self, other):
        return self + (-other)

    def __rsub__(self, other):
        return (-self) + other

    __radd__, __rmul__ = __add__, __mul__


class Plain:
    """Arrays."""

    sqrt, phi, density, normal = staticmethod(np.sqrt), staticmethod(phi), staticmethod(density), staticmethod(normal)
    exp, atleast, clip, where = staticmethod(np.exp), staticmethod(np.maximum), staticmethod(np.clip), staticmethod(np.where)

    @staticmethod
    def raw(x):
        return x


class Tracing:
    """Traced arrays."""

    @staticmethod
    def raw(x):
        return x.value

    @staticmethod
    def sqrt(x):
        root = np.sqrt(x.value)
        return Traced(root, ((x, 0.5 / root),))

    @staticmethod
    def exp(x):
        e = np.exp(x.value)
        return Traced(e, ((x, e),))

    @staticmethod
    def phi(x):
        return Traced(phi(x.value), ((x, density(x.value)),))

    @staticmethod
    def density(x):
        d = density(x.value)
        return Traced(d, ((x, -x.value * d),))

    @staticmethod
    def atleast(x, least):
        return Traced(np.maximum(x.value, least), ((x, (x.value >= least).astype(float)),))

    @staticmethod
    def clip(x, low, high):
        return Traced(np.clip(x.value, low, high), ((x, ((x.value >= low) & (x.value <= high)).astype(float)),))

    @staticmethod
    def where(test, yes, no):
        return Traced(np.where(test, yes.value, no.value), ((yes, test.astype(float)), (no, 1.0 - test)))

    @staticmethod
    def normal(z, r):
        zs, rs = [x.value for x in z], [[1.0 if i == j else x.value for j, x in enumerate(row)] for i, row in enumerate(r)]
        by_limit, by_corr = normal_slopes(zs, rs)
        return Traced(normal(zs, rs), (*zip(z, by_limit, strict=True), *((r[i][j], d) for (i, j), d in by_corr.items())))


PLAIN, TRACED = Plain, Tracing


def sweep(out: Traced) -> None:
    """Fill in the adjoints of everything that ``out`` was made of."""
    order, seen, stack = [], set(), [(out, False)]
    while stack:
        x, done = stack.pop()
        if done:
            order.append(x)
        elif id(x) not in seen:
            seen.add(id(x))
            stack.append((x, True))
            stack += [(y, False) for y, _ in x.of]
    out.adjoint = np.ones_like(out.value)
    for x in reversed(order):
        if x.adjoint is not None:
            for y, slope in x.of:
                part = np.where(x.adjoint == 0, 0.0, x.adjoint * slope)  # what is cut off stays cut off, however steep it is
                y.adjoint = part if y.adjoint is None else y.adjoint + part


def _factor(a: list, mean: list, cov: list[list], n: int, m):
    """Probability of the first n variables below their limits."""
    n = min(n, len(a))
    sd = [m.sqrt(m.atleast(cov[i][i], 1e-30)) for i in range(n)]
    z = [(a[i] - mean[i]) / sd[i] for i in range(n)]
    low = [[m.clip(cov[i][j] / (sd[i] * sd[j]), -0.9999, 0.9999) for j in range(i)] for i in range(n)]
    return m.normal(z, [[low[max(i, j)][min(i, j)] if i != j else None for j in range(n)] for i in range(n)])


def _truncate_one(a: list, mean: list, cov: list[list], fixed: bool, m) -> tuple[list, list[list]]:
    """Means and covariances of the others, once the first variable lies below its limit."""
    k = len(a)
    sd = m.sqrt(m.atleast(cov[0][0], 1e-15))
    w = (a[0] - mean[0]) / sd
    shift = -(m.density(w) / m.atleast(m.phi(w), TINY))
    along = [cov[j][0] / sd for j in range(1, k)]
    lost = 1.0 if fixed else 1.0 - m.atleast(shift * (w - shift) + 1.0, 1e-15)
    means = [mean[j] + along[j - 1] * shift for j in range(1, k)]
    less = [x * lost for x in along]
    low = [[cov[i][j] - less[i - 1] * along[j - 1] for j in range(1, i + 1)] for i in range(1, k)]
    return means, _whole(low)


def _whole(low: list[list]) -> list[list]:
    return [[low[max(i, j)][min(i, j)] for j in range(len(low))] for i in range(len(low))]


def truncated_pair(a: list, mean: list, cov: list[list], m) -> tuple[list, list[list]]:
    """Means and covariances of a normal pair below its limits."""
    sd = [m.sqrt(m.atleast(cov[i][i], 1e-15)) for i in (0, 1)]
    w = [m.clip((a[i] - mean[i]) / sd[i], -37, 37) for i in (0, 1)]
    rho = m.clip(cov[0][1] / (sd[0] * sd[1]), -0.9999, 0.9999)
    square = rho * rho
    left = 1.0 - square
    root = m.sqrt(left)
    mass = m.atleast(m.normal(w, [[None, rho], [rho, None]]), TINY)
    f = [m.density(w[i]) * m.phi((w[1 - i] - rho * w[i]) / root) for i in (0, 1)]
    joint = m.exp(m.clip((rho * w[0] * w[1] * 2.0 - w[0] * w[0] - w[1] * w[1]) / (left * 2.0), -745.0, 0.0)) / (root * (2 * np.pi))
    moved = [-((f[i] + rho * f[1 - i]) / mass) for i in (0, 1)]
    second = [1.0 - (w[i] * f[i] + square * w[1 - i] * f[1 - i] - rho * left * joint) / mass for i in (0, 1)]
    cross = rho - (rho * w[0] * f[0] + rho * w[1] * f[1] - left * joint) / mass
    var = [m.atleast(second[i] - moved[i] * moved[i], 1e-15) * sd[i] * sd[i] for i in (0, 1)]
    off = (cross - moved[0] * moved[1]) * sd[0] * sd[1]
    return [mean[i] + moved[i] * sd[i] for i in (0, 1)], [[var[0], off], [off, var[1]]]


def _truncate_pair(a: list, mean: list, cov: list[list], fixed: bool, m) -> tuple[list, list[list]]:
    """Means and covariances of the others, once the first two variables lie below their limits."""
    k = len(a)
    new_mean, new_cov = truncated_pair(a[:2], mean[:2], cov, m)
    p, q, x = cov[0][0] + 1e-12, cov[1][1] + 1e-12, cov[0][1]
    det = p * q - x * x
    slope = [((q * cov[0][r] - x * cov[1][r]) / det, (p * cov[1][r] - x * cov[0][r]) / det) for r in range(2, k)]
    moved = [new_mean[i] - mean[i] for i in (0, 1)]
    less = [[cov[i][j] if fixed else cov[i][j] - new_cov[i][j] for j in (0, 1)] for i in (0, 1)]
    means = [mean[r] + s[0] * moved[0] + s[1] * moved[1] for r, s in zip(range(2, k), slope, strict=True)]
    taken = [(s[0] * less[0][0] + s[1] * less[1][0], s[0] * less[0][1] + s[1] * less[1][1]) for s in slope]
    low = [[cov[r][c] - (taken[r - 2][0] * slope[c - 2][0] + taken[r - 2][1] * slope[c - 2][1]) for c in range(2, r + 1)] for r in range(2, k)]
    return means, _whole(low)


def chained(a: list, cov: list[list], method: str, m=PLAIN):
    """Probability that all variables lie below their limits, by conditioning one, or one pair, after another."""
    k = len(a)
    step, start, ahead = METHODS[method]
    if method == "tvbs" and k == 3:
        start = 2
    mean = [x * 0.0 for x in a]
    out = m.atleast(_factor(a, mean, cov, start, m), TINY)
    known, done = start, 0  # variables that the factors so far cover, and that are truncated
    while known < k:
        n = min(step, len(a) - 1)
        mean, cov = (_truncate_one if n == 1 else _truncate_pair)(a, mean, cov, method in FIXED, m)
        a, done = a[n:], done + n
        have = known - done  # of those left, how many earlier factors cover
        if step == 2 and have >= 2:
            continue
        take = min(have + 1, len(a)) if step == 1 else min(2, len(a))
        factor = _factor(a, mean, cov, take, m)
        if have:
            below = _factor(a, mean, cov, have, m)
            alone = m.phi((a[0] - mean[0]) / m.sqrt(m.atleast(cov[0][0], 1e-15)))
            factor = m.where(m.raw(below) > TINY, factor / m.atleast(below, TINY), alone)
        out = out * m.atleast(factor, TINY)
        known = done + take
    return m.clip(out, 0.0, 1.0)


def gradient(a: np.ndarray, cov: np.ndarray, of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, derivatives by limits (N, K), and by covariances (N, K, K), of ``of(limits, covariances, m)``.

    The derivative by the covariance of two variables is shared between its two places.
    """
    n, k = a.shape
    limits = [Traced(a[:, i]) for i in range(k)]
    low = [[Traced(np.ascontiguousarray(cov[:, i, j])) for j in range(i + 1)] for i in range(k)]
    with np.errstate(all="ignore"):
        out = of(limits, _whole(low), TRACED)
        sweep(out)
    zero = lambda x: np.zeros(n) if x.adjoint is None else np.broadcast_to(x.adjoint, n)
    by_cov = np.empty((n, k, k))
    for i in range(k):
        for j in range(i + 1):
            by_cov[:, i, j] = by_cov[:, j, i] = zero(low[i][j]) / (1 if i == j else 2)
    return out.value, np.stack([zero(x) for x in limits], axis=1), by_cov
