"""Scalar distributions as formulas over an algebra (see ``prefero.functions.algebra``)."""

from __future__ import annotations

import math

import numpy as np

from prefero.functions.algebra import COLUMNS, total

# Coefficients of Hart's rational approximation of the normal tail, from the highest power.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_END = 7.07106781186547
ROOT_2PI = math.sqrt(2 * math.pi)
#: Nodes and weights of the bivariate integral: so many do up to each |rho|, and the most beyond.
RULES = tuple((most, list(zip(*(a.tolist() for a in np.polynomial.legendre.leggauss(n)), strict=True))) for most, n in ((0.3, 6), (0.75, 12), (1.0, 20)))


def _powers(coefficients: tuple, x: object) -> object:
    out = coefficients[0] * x + coefficients[1]
    for c in coefficients[2:]:  # in place where the algebra can
        out *= x
        out += c
    return out


def normal_pdf(x, m=COLUMNS):
    return m.exp(-(x * x) / 2.0) / ROOT_2PI


def normal_logpdf(x, m=COLUMNS):
    return -(x * x) / 2.0 - math.log(ROOT_2PI)


def normal_cdf(x, m=COLUMNS):
    """Hart's approximation, to the last digits of a double."""
    a = m.abs(m.lift(x))
    near = lambda a: m.exp(-(a * a) / 2.0) * _powers(HART_TOP, a) / _powers(HART_BOTTOM, a)
    far = lambda a: m.where(a > 37.0, 0.0, m.exp(-(a * a) / 2.0) / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / ROOT_2PI)
    tail = m.either(a < HART_END, near, far, a)
    return m.abs(m.where(m.lift(x) > 0.0, 1.0, 0.0) - tail)  # 1 - tail or tail; written once, it keeps generated methods short enough for the JVM to compile


def bivariate_normal_cdf(h, k, rho, m=COLUMNS):
    """P(X <= h, Y <= k): the product of the margins and Plackett's integral over the angle, for |rho| up to about 0.95.

    Of a correlation that is a number, the angles are numbers too, and a small one takes fewer nodes.
    """
    known = isinstance(rho, int | float)
    nodes = next(rule for most, rule in RULES if not known and most == 1.0 or known and abs(rho) <= most)
    angle = math.asin(rho) / 2.0 if known else m.asin(m.lift(rho)) / 2.0
    both, squares, terms = h * k, (h * h + k * k) / 2.0, []
    for x, w in nodes:
        s = math.sin(angle * (1.0 + x)) if known else m.sin(angle * (1.0 + x))
        terms.append(w * m.exp((s * both - squares) / (1.0 - s * s)))
    return normal_cdf(h, m) * normal_cdf(k, m) + angle * total(terms) / (2.0 * math.pi)


def logistic_pdf(x, m=COLUMNS):
    e = m.exp(-m.abs(x))
    return e / ((1.0 + e) * (1.0 + e))


def logistic_cdf(x, m=COLUMNS):
    e = m.exp(-m.abs(x))
    return m.where(x >= 0.0, 1.0 / (1.0 + e), e / (1.0 + e))


def gumbel_pdf(x, m=COLUMNS):
    return m.exp(-x - m.exp(-x))


def gumbel_cdf(x, m=COLUMNS):
    return m.exp(-m.exp(-x))


def reverse_gumbel_pdf(x, m=COLUMNS):
    return m.exp(x - m.exp(x))


def reverse_gumbel_cdf(x, m=COLUMNS):
    return 1.0 - m.exp(-m.exp(x))


def truncated_normal_pdf(x, lower, upper, mean=0.0, sd=1.0, m=COLUMNS):
    """Density of a normal kept to [lower, upper]."""
    z = (x - mean) / sd
    mass = normal_cdf(m.lift((upper - mean) / sd), m) - normal_cdf(m.lift((lower - mean) / sd), m)
    return m.where((x >= lower) & (x <= upper), normal_pdf(z, m) / sd / mass, 0.0)


def truncated_normal_cdf(x, lower, upper, mean=0.0, sd=1.0, m=COLUMNS):
    low = normal_cdf(m.lift((lower - mean) / sd), m)
    mass = normal_cdf(m.lift((upper - mean) / sd), m) - low
    return m.where(x <= lower, 0.0, m.where(x >= upper, 1.0, (normal_cdf((x - mean) / sd, m) - low) / mass))


def truncated_normal_mean(w, m=COLUMNS):
    """Mean of a standard normal below w."""
    return -normal_pdf(w, m) / m.greatest(normal_cdf(w, m), 1e-300)


def truncated_normal_variance(w, m=COLUMNS):
    """Variance of a standard normal below w."""
    mean = truncated_normal_mean(w, m)
    return m.greatest(1.0 + mean * (w - mean), 1e-15)


def skew_normal_pdf(x, shape, m=COLUMNS):
    return 2.0 * normal_pdf(x, m) * normal_cdf(shape * x, m)


def skew_normal_cdf(x, shape, m=COLUMNS):
    """By P(Z <= x, W <= 0) for normals of correlation -shape / sqrt(1 + shape^2)."""
    return 2.0 * bivariate_normal_cdf(x, m.lift(0.0), m.lift(-shape / math.sqrt(1 + shape * shape)), m)


def mv_logistic_cdf(xs: list, m=COLUMNS):
    """P(all X_k <= x_k) of the multivariate logistic: 1 / (1 + sum of e^-x)."""
    return 1.0 / (1.0 + total([m.exp(-x) for x in xs]))


def mv_logistic_pdf(xs: list, m=COLUMNS):
    """K! e^-sum(x) / (1 + sum of e^-x)^(K+1)."""
    return mv_logistic_mixed(xs, [], [], m)


def mv_logistic_partial(points: list, limits: list, m=COLUMNS):
    """Density in ``points`` times distribution in ``limits``: M! e^-sum(points) / (1 + all e^-x)^(M+1)."""
    return mv_logistic_mixed(points, limits, [], m)


def mv_logistic_survival(xs: list, m=COLUMNS):
    """P(all X_k > x_k)."""
    return mv_logistic_mixed([], [], xs, m)


def mv_logistic_mixed(points: list, below: list, above: list, m=COLUMNS):
    """Density at ``points``, distribution at ``below`` and tail at ``above``; the tail by inclusion and exclusion."""
    return _mixed_terms(points, below, above, m)[0]


def mv_logistic_gradient(points: list, below: list, above: list, m=COLUMNS) -> list:
    """Derivatives of ``mv_logistic_mixed`` by every argument, in the order given."""
    return _mixed_terms(points, below, above, m)[1]


def _mixed_terms(points: list, below: list, above: list, m) -> tuple:
    n = len(points)
    values, slopes = [], [[] for _ in range(n + len(below) + len(above))]
    for mask in range(1 << len(above)):
        some = [i for i in range(len(above)) if mask >> i & 1]
        xs = [*points, *below, *[above[i] for i in some]]
        if not xs:
            values.append(m.lift(1.0))
            continue
        e = [m.exp(-x) for x in xs]
        share = 1.0 / (1.0 + total(e))
        value = (-1.0) ** len(some) * math.factorial(n) * _power(share, n + 1)
        if n:
            value = value * m.exp(-total(points))
        values.append(value)
        at = [*range(n + len(below)), *[n + len(below) + i for i in some]]
        for k, (i, term) in enumerate(zip(at, e, strict=True)):
            slopes[i].append(value * ((n + 1.0) * term * share - (1.0 if k < n else 0.0)))
    return total(values), [total(s) for s in slopes]


def mv_logistic_rectangle(lower: list, upper: list, m=COLUMNS):
    """P(lower < X <= upper) by inclusion and exclusion over the corners."""
    out = []
    for mask in range(1 << len(lower)):
        corner = [lower[i] if mask >> i & 1 else upper[i] for i in range(len(lower))]
        out.append(m.lift((-1.0) ** bin(mask).count("1")) * mv_logistic_cdf(corner, m))
    return total(out)


def located(xs: list, mean: list, scale: list) -> list:
    """Arguments of a distribution with locations and scales; its density is divided by the scales of its points."""
    return [(x - mu) / s for x, mu, s in zip(xs, mean, scale, strict=True)]


def _power(x: object, n: int) -> object:
    out = x
    for _ in range(n - 1):
        out = out * x
    return out


def student_cdf(x: np.ndarray, freedom: float) -> np.ndarray:
    """Student's t distribution on arrays, by quadrature over the angle of its tangent."""
    x = np.asarray(x, float)
    end = np.arctan(x / math.sqrt(freedom))
    nodes, weights = np.polynomial.legendre.leggauss(64)
    angle = end[..., None] * (1 + nodes) / 2
    area = (weights * np.cos(angle) ** (freedom - 1)).sum(axis=-1) * end / 2
    return 0.5 + area * math.gamma((freedom + 1) / 2) / (math.gamma(freedom / 2) * math.sqrt(math.pi))


def skew_t_pdf(x: np.ndarray, shape: float = 0.0, freedom: float = 5.0) -> np.ndarray:
    """Skew-t density on arrays."""
    x = np.asarray(x, float)
    plain = math.gamma((freedom + 1) / 2) / (math.gamma(freedom / 2) * math.sqrt(freedom * math.pi)) * (1 + x * x / freedom) ** (-(freedom + 1) / 2)
    return 2 * plain * student_cdf(shape * x * np.sqrt((freedom + 1) / (freedom + x * x)), freedom + 1)


def owen_t(h: np.ndarray, a: float) -> np.ndarray:
    """Owen's T on arrays: the integral of e^(-h^2 (1 + x^2) / 2) / (1 + x^2) / 2 pi from 0 to a."""
    nodes, weights = np.polynomial.legendre.leggauss(64)
    x = a * (1 + nodes) / 2
    return (weights * np.exp(-0.5 * np.asarray(h, float)[..., None] ** 2 * (1 + x * x)) / (1 + x * x)).sum(axis=-1) * a / 2 / (2 * math.pi)


def normal_ppf(p: np.ndarray) -> np.ndarray:
    """Normal quantiles on arrays: a start from the tail's logarithm, then Newton steps on the distribution."""
    from prefero.functions.algebra import ARRAYS

    p = np.asarray(p, float)
    q = np.minimum(p, 1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(-2 * np.log(q))
        # fixed values: the rational start of a normal quantile
        x = -(t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308))))
        for _ in range(4):
            x = x - np.where((q > 0) & np.isfinite(x), (normal_cdf(x, ARRAYS) - q) / np.maximum(normal_pdf(x, ARRAYS), 1e-300), 0.0)
        x = np.where(p > 0.5, -x, x)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, np.where(p == 0.5, 0.0, x)))
