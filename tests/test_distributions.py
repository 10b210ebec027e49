import math

import numpy as np
import pytest

from prefero.functions import distributions as dist
from prefero.functions.algebra import ARRAYS, TEXT, Text
from prefero.kernels import mvn

# A covariance and limits whose probabilities are known, with how far each method may be from them.
COV = np.array([[1, 0.3, 0.1], [0.3, 1, 0.4], [0.1, 0.4, 1]])
A = np.array([[1.0, 0.5, 0.8]])


def test_normal_cdf_is_erfc():
    x = np.linspace(-8, 8, 801)
    np.testing.assert_allclose(dist.normal_cdf(x, ARRAYS), [0.5 * math.erfc(-t / math.sqrt(2)) for t in x], atol=1e-15)


def test_quantiles_invert():
    p = np.linspace(1e-6, 1 - 1e-6, 301)
    np.testing.assert_allclose(dist.normal_cdf(dist.normal_ppf(p), ARRAYS), p, atol=1e-14)
    assert dist.normal_ppf(np.array([0.0, 0.5, 1.0])).tolist() == [-np.inf, 0.0, np.inf]


def test_known_values():
    zero = np.array([0.0])
    assert dist.logistic_cdf(zero, ARRAYS)[0] == pytest.approx(0.5)
    assert dist.gumbel_cdf(zero, ARRAYS)[0] == pytest.approx(math.exp(-1))
    assert dist.reverse_gumbel_cdf(zero, ARRAYS)[0] == pytest.approx(1 - math.exp(-1))
    assert dist.bivariate_normal_cdf(zero, zero, 0.5, ARRAYS)[0] == pytest.approx(1 / 3, abs=1e-14)


def test_bivariate_closed_form_agrees_with_kernel():
    rng = np.random.default_rng(1)
    h, k = rng.normal(size=(2, 200))
    for rho in (-0.9, -0.3, 0.0, 0.5, 0.9):
        np.testing.assert_allclose(dist.bivariate_normal_cdf(h, k, rho, ARRAYS), mvn.phi2(h, k, np.full(200, rho)), atol=1e-7)


def test_densities_are_derivatives():
    x, e = np.linspace(-2, 2, 41), 1e-5
    for pdf, cdf in ((dist.normal_pdf, dist.normal_cdf), (dist.logistic_pdf, dist.logistic_cdf), (dist.gumbel_pdf, dist.gumbel_cdf), (dist.reverse_gumbel_pdf, dist.reverse_gumbel_cdf)):
        np.testing.assert_allclose((cdf(x + e, ARRAYS) - cdf(x - e, ARRAYS)) / (2 * e), pdf(x, ARRAYS), atol=1e-8)
    np.testing.assert_allclose((dist.skew_normal_cdf(x + e, 1.5, ARRAYS) - dist.skew_normal_cdf(x - e, 1.5, ARRAYS)) / (2 * e), dist.skew_normal_pdf(x, 1.5, ARRAYS), atol=1e-8)
    np.testing.assert_allclose(
        (dist.truncated_normal_cdf(x + e, -1.0, 1.5, 0.2, 1.3, ARRAYS) - dist.truncated_normal_cdf(x - e, -1.0, 1.5, 0.2, 1.3, ARRAYS))[11:34] / (2 * e), dist.truncated_normal_pdf(x, -1.0, 1.5, 0.2, 1.3, ARRAYS)[11:34], atol=1e-7
    )


def test_mv_logistic_parts():
    x, y, e = np.array([0.3]), np.array([-0.4]), 1e-5
    both = dist.mv_logistic_cdf([x, y], ARRAYS)
    assert dist.mv_logistic_survival([x, y], ARRAYS)[0] == pytest.approx(1 - dist.mv_logistic_cdf([x], ARRAYS)[0] - dist.mv_logistic_cdf([y], ARRAYS)[0] + both[0])
    slope = (dist.mv_logistic_cdf([x + e, y], ARRAYS) - dist.mv_logistic_cdf([x - e, y], ARRAYS)) / (2 * e)
    np.testing.assert_allclose(slope, dist.mv_logistic_partial([x], [y], ARRAYS), atol=1e-9)
    far = np.array([-700.0])
    np.testing.assert_allclose(dist.mv_logistic_rectangle([far, far], [x, y], ARRAYS), both, atol=1e-12)


def test_text_is_sql():
    import duckdb

    sql = str(dist.normal_cdf(Text("x"), TEXT))
    for x, p in duckdb.sql(f"SELECT x, {sql} FROM (VALUES (-1.5), (0.0), (2.0)) t(x)").fetchall():
        assert p == pytest.approx(0.5 * math.erfc(-float(x) / math.sqrt(2)), abs=1e-15)


@pytest.mark.parametrize(("method", "tolerance"), [("me", 0.03), ("ovus", 0.02), ("bme", 0.01), ("tvbs", 0.01), ("ovbs", 0.01), ("ssj", 0.01)])
def test_methods_near_exact(method, tolerance):
    assert mvn.mvn_cdf(A, COV, method)[0] == pytest.approx(mvn.mvn_cdf(A, COV, "exact")[0], rel=tolerance)


def test_exact_orthants():
    for k, p in ((2, 1 / 3), (3, 1 / 4), (4, 1 / 5)):
        half = 0.5 * np.eye(k) + 0.5
        assert mvn.mvn_cdf(np.zeros((1, k)), half, "exact")[0] == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize("method", [*mvn.METHODS, "exact", "ssj"])
def test_infinite_limits(method):
    inf = np.inf
    a = np.array([[1.0, inf, 0.8], [1.0, -inf, 0.8], [inf, inf, inf], [inf, 0.2, inf]])
    p = mvn.mvn_cdf(a, COV, method)
    assert p[0] == pytest.approx(mvn.phi2(np.array([1.0]), np.array([0.8]), np.array([0.1]))[0])
    assert p[1] == 0 and p[2] == 1
    assert p[3] == pytest.approx(dist.normal_cdf(np.array([0.2]), ARRAYS)[0])


@pytest.mark.parametrize("method", list(mvn.METHODS))
def test_batch_equals_rows(method):
    rng = np.random.default_rng(3)
    a, f = rng.normal(size=(20, 5)) + 0.5, rng.normal(size=(20, 5, 5))
    cov = f @ f.transpose(0, 2, 1) + np.eye(5)
    together = mvn.mvn_cdf(a, cov, method)
    alone = [mvn.mvn_cdf(a[i : i + 1], cov[i : i + 1], method)[0] for i in range(20)]
    np.testing.assert_allclose(together, alone, atol=1e-12)


@pytest.mark.parametrize("method", list(mvn.METHODS))
def test_independent_is_product(method):
    a = np.array([[0.3, -0.5, 1.2, 0.1, 0.9]])
    assert mvn.mvn_cdf(a, np.eye(5), method)[0] == pytest.approx(np.prod(dist.normal_cdf(a, ARRAYS)), rel=1e-9)


def test_truncated_pair_by_simulation():
    cov, a = np.array([[1.0, 0.5], [0.5, 2.0]]), np.array([0.4, 0.7])
    z = np.random.default_rng(0).multivariate_normal([0.1, -0.2], cov, 400_000)
    z = z[(z <= a).all(axis=1)]
    mean, c = mvn.truncated_pair(a[None], np.array([[0.1, -0.2]]), cov[None])
    np.testing.assert_allclose(mean[0], z.mean(axis=0), atol=0.01)
    np.testing.assert_allclose(c[0], np.cov(z.T), atol=0.02)


def test_rectangle_and_partial():
    low, up = np.array([[-1.0, -0.5]]), np.array([[0.5, 1.0]])
    cov = np.array([[1.0, 0.4], [0.4, 1.0]])
    z = np.random.default_rng(0).multivariate_normal([0, 0], cov, 400_000)
    assert mvn.mvn_rectangle(low, up, cov)[0] == pytest.approx(((z > low[0]) & (z <= up[0])).all(axis=1).mean(), abs=0.004)
    e = 1e-4
    slope = (mvn.mvn_cdf(np.array([[0.3 + e, 0.5]]), cov) - mvn.mvn_cdf(np.array([[0.3 - e, 0.5]]), cov)) / (2 * e)
    np.testing.assert_allclose(mvn.partial_mvn(np.array([[0.3]]), np.array([[0.5]]), cov), slope, atol=1e-7)
    inside = np.array([[0.1, 0.2]])
    assert mvn.truncated_mvn_cdf(up, low, up, cov)[0] == pytest.approx(1.0)
    assert mvn.truncated_mvn_density(inside, low, up, cov)[0] == pytest.approx(mvn.mvn_density(inside, cov)[0] / mvn.mvn_rectangle(low, up, cov, "me")[0])


def test_mv_logistic_gradient_by_differences():
    xs, e = [0.3, -0.4, 0.2, 0.6, -0.1], 1e-6
    f = lambda v: dist.mv_logistic_mixed(*[[np.array([x]) for x in part] for part in (v[:2], v[2:3], v[3:])], ARRAYS)[0]
    got = dist.mv_logistic_gradient(*[[np.array([x]) for x in part] for part in (xs[:2], xs[2:3], xs[3:])], ARRAYS)
    for i in range(5):
        up, down = ([x + s * e * (k == i) for k, x in enumerate(xs)] for s in (1, -1))
        assert got[i][0] == pytest.approx((f(up) - f(down)) / (2 * e), abs=1e-8)


def test_mvn_gradient_moments_and_order():
    a, cov = np.array([[0.4, 0.7]]), np.array([[1.0, 0.5], [0.5, 2.0]])
    _, by_limit, by_cov = mvn.mvn_cdf_gradient(a, cov)
    np.testing.assert_allclose(by_limit[0, 0], mvn.partial_mvn(a[:, :1], a[:, 1:], cov)[0], atol=1e-6)
    assert 2 * by_cov[0, 0, 1] == pytest.approx(mvn.mvn_density(a, cov)[0], abs=1e-9)  # d P / d covariance, in both its places, is the density
    mean, c = mvn.truncated_moments(np.array([[0.4, 40.0]]), np.zeros((1, 2)), cov)
    exact_mean, exact_cov = mvn.truncated_pair(np.array([[0.4, 40.0]]), np.zeros((1, 2)), cov[None])
    np.testing.assert_allclose(mean, exact_mean, atol=1e-6)
    np.testing.assert_allclose(c, exact_cov, atol=1e-6)
    assert mvn.greedy_order(np.array([1.0, -2.0, 0.5]), np.eye(3)).tolist() == [1, 2, 0]
    np.testing.assert_allclose(mvn.log_mvn_cdf(a, cov), np.log(mvn.mvn_cdf(a, cov)))


def test_student_skew_t_and_owen():
    x = np.linspace(-3, 3, 13)
    np.testing.assert_allclose(dist.student_cdf(x, 1.0), 0.5 + np.arctan(x) / np.pi, atol=1e-12)
    np.testing.assert_allclose(dist.student_cdf(x, 2.0), 0.5 + x / (2 * np.sqrt(2 + x * x)), atol=1e-12)
    z = np.linspace(-60, 60, 240_001)
    assert np.trapezoid(dist.skew_t_pdf(z, 1.5, 5.0), z) == pytest.approx(1, abs=1e-5)
    np.testing.assert_allclose(dist.normal_cdf(x, ARRAYS) - 2 * dist.owen_t(x, 1.5), dist.skew_normal_cdf(x, 1.5, ARRAYS), atol=1e-10)


def nested(z, r, panels=40):
    """Distribution of three or four variables by integrating out the first, on many panels."""
    x, w = np.polynomial.legendre.leggauss(20)
    edges = np.linspace(-8.5, min(z[0], 8.5), panels + 1)
    t = np.concatenate([(a + b) / 2 + (b - a) / 2 * x for a, b in zip(edges[:-1], edges[1:], strict=True)])
    weight = np.concatenate([(b - a) / 2 * w for a, b in zip(edges[:-1], edges[1:], strict=True)])
    rest = r[1:, 1:] - np.outer(r[1:, 0], r[0, 1:])
    sd = np.sqrt(np.diag(rest))
    u, c = (z[1:] - r[1:, 0] * t[:, None]) / sd, rest / np.outer(sd, sd)
    inside = mvn.phi2(u[:, 0], u[:, 1], np.full(len(t), c[0, 1])) if len(z) == 3 else np.array([nested(v, c, 20) for v in u])
    return float((weight * mvn.density(t) * inside).sum())


@pytest.mark.parametrize(("k", "n"), [(3, 60), (4, 4)])
def test_three_and_four_variables_by_nested_integrals(k, n):
    rng = np.random.default_rng(k)
    low = rng.normal(size=(n, k, k)) * 0.6 + np.eye(k) * 1.2
    cov = low @ low.transpose(0, 2, 1)
    a = rng.normal(size=(n, k)) * 1.2
    sd = np.sqrt(np.einsum("nkk->nk", cov))
    want = [nested(z, r) for z, r in zip(a / sd, cov / (sd[:, :, None] * sd[:, None, :]), strict=True)]
    np.testing.assert_allclose(mvn.exact(a, cov), want, atol=1e-8)


@pytest.mark.parametrize("method", [*mvn.METHODS, "exact"])
def test_gradients_by_differences(method):
    """One reverse sweep gives the derivatives of each approximation by all limits and covariances."""
    rng, h = np.random.default_rng(9), 1e-5
    for k in (1, 2, 3, 4, 5):
        if method == "exact" and k == 5:
            continue
        low = rng.normal(size=(20, k, k)) * 0.3 + np.eye(k)
        cov, a = low @ low.transpose(0, 2, 1), rng.normal(size=(20, k))
        a[3, 0], a[4, -1] = np.inf, -np.inf
        value, by_limit, by_cov = mvn.mvn_cdf_gradient(a, cov, method)
        np.testing.assert_allclose(value, mvn.mvn_cdf(a, cov, method), atol=1e-12)
        of = lambda x, c: mvn.mvn_cdf(x, c, method)  # noqa: B023, E731
        for i in range(k):
            e = np.eye(k)[i] * h
            np.testing.assert_allclose(by_limit[:, i], (of(a + e, cov) - of(a - e, cov)) / (2 * h), atol=2e-6)
            for j in range(i + 1):
                m = np.zeros((k, k))
                m[i, j] = m[j, i] = h
                np.testing.assert_allclose(by_cov[:, i, j] * (1 if i == j else 2), (of(a, cov + m) - of(a, cov - m)) / (2 * h), atol=2e-6)


def test_rectangle_gradient_by_differences():
    rng, h = np.random.default_rng(2), 1e-5
    low = rng.normal(size=(3, 3)) * 0.4 + np.eye(3)
    cov, a = low @ low.T, rng.normal(size=(10, 3)) - 0.5
    b = a + rng.uniform(0.3, 2, size=(10, 3))
    a[:4, 0], b[2:6, 1] = -np.inf, np.inf
    p, by_low, by_up, by_cov = mvn.mvn_rectangle_gradient(a, b, cov)
    of = lambda x, y, c: mvn.mvn_rectangle(x, y, c)
    np.testing.assert_allclose(p, of(a, b, cov), atol=1e-12)
    for i in range(3):
        e = np.eye(3)[i] * h
        np.testing.assert_allclose(by_low[:, i], (of(a + e, b, cov) - of(a - e, b, cov)) / (2 * h), atol=1e-6)
        np.testing.assert_allclose(by_up[:, i], (of(a, b + e, cov) - of(a, b - e, cov)) / (2 * h), atol=1e-6)
    m = np.zeros((3, 3))
    m[0, 1] = m[1, 0] = h
    np.testing.assert_allclose(2 * by_cov[:, 0, 1], (of(a, b, cov + m) - of(a, b, cov - m)) / (2 * h), atol=1e-6)


def test_normal_cdf_beyond_its_near_formula():
    x = np.array([-np.inf, -38.0, -36.0, -7.5, -7.0, 0.0, 7.0, 7.2, 36.0, 38.0, np.inf])
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) if abs(v) < 37 else float(v > 0) for v in x])
    np.testing.assert_allclose(mvn.phi(x), want, rtol=1e-7, atol=0)
    np.testing.assert_array_equal([float(mvn.phi(v)) for v in x], mvn.phi(x))


def test_far_tail_is_worked_out_for_far_rows_only():
    met = []
    out = ARRAYS.either(np.array([True, False, True]), lambda x: x + 1, lambda x: met.append(x) or -x, np.array([1.0, 2.0, 3.0]))
    np.testing.assert_array_equal(out, [2.0, -2.0, 4.0])
    np.testing.assert_array_equal(met, [[2.0]])


CORRELATIONS = {
    "smooth": [[1.0, 0.5, 0.4], [0.5, 1.0, 0.45], [0.4, 0.45, 1.0]],
    "slight": [[1.0, 0.2, -0.1], [0.2, 1.0, 0.25], [-0.1, 0.25, 1.0]],
    "nearly singular": [[1.0, 0.6, -0.6], [0.6, 1.0, 0.25], [-0.6, 0.25, 1.0]],
    "strong": [[1.0, 0.9, 0.85], [0.9, 1.0, 0.95], [0.85, 0.95, 1.0]],
    "four": [[1.0, 0.5, 0.4, 0.1], [0.5, 1.0, 0.45, 0.0], [0.4, 0.45, 1.0, -0.2], [0.1, 0.0, -0.2, 1.0]],
}


@pytest.mark.parametrize("kind", list(CORRELATIONS))
@pytest.mark.parametrize("method", ["exact", "ovus", "tvbs"])
def test_one_covariance_for_all_rows_equals_one_a_row(kind, method):
    cov = np.array(CORRELATIONS[kind]) * 1.7
    k = len(cov)
    a = np.random.default_rng(5).normal(size=(300, k)) * 2
    a[::7, 0], a[::11, k - 1], a[::13, 1] = np.inf, -np.inf, 30.0
    a[5], a[6] = np.inf, 0.0
    by_row = mvn.mvn_cdf(a, np.repeat(cov[None], len(a), axis=0), method)
    np.testing.assert_allclose(mvn.mvn_cdf(a, cov, method), by_row, rtol=0, atol=2e-15)
    assert len(mvn.mvn_cdf(a[:0], cov, method)) == 0


def test_one_covariance_is_not_spread_over_the_rows(monkeypatch):
    """Angles, conditional variances and the number of nodes are worked out once, not by row."""
    from prefero.kernels import chain

    seen, plackett = [], chain._plackett
    monkeypatch.setattr(chain, "_plackett", lambda z, r, last, plan: seen.append((np.ndim(r[0][1]), len(plan))) or plackett(z, r, last, plan))
    a = np.random.default_rng(6).normal(size=(50, 3))
    for kind, nodes in (("smooth", 14), ("slight", 14), ("nearly singular", 24), ("strong", 24 * (len(chain.EDGES) - 1))):
        mvn.mvn_cdf(a, np.array(CORRELATIONS[kind]), "exact")
        assert seen.pop() == (0, nodes) and not seen, kind
