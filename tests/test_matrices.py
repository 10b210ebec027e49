import numpy as np
import pytest

from prefero.kernels import matrices as m

A = np.array([[1.0, 2, 3], [2, 4, 5], [3, 5, 6]])
PD = np.array([[4.0, 2, 1], [2, 5, 3], [1, 3, 6]])


def test_half_vectors():
    assert m.half_vector(A).tolist() == [1, 2, 3, 4, 5, 6]
    assert m.half_vector(A, False).tolist() == [2, 3, 5]
    np.testing.assert_array_equal(m.from_half_vector(m.half_vector(A)), A)
    np.testing.assert_array_equal(m.from_half_vector(np.array([2.0, 3, 5]), False, True), [[1, 2, 3], [2, 1, 5], [3, 5, 1]])
    np.testing.assert_array_equal(m.symmetric(np.triu(A)), A)
    assert m.off_diagonal(A).tolist() == [2, 3, 2, 5, 3, 5]


def test_correlations_round_trip():
    for n in (2, 3, 5):
        theta = np.random.default_rng(n).normal(size=n * (n - 1) // 2)
        r = m.correlation_of_angles(theta)
        np.testing.assert_allclose(np.diag(r), 1)
        assert np.linalg.eigvalsh(r).min() > 0
        np.testing.assert_allclose(m.angles_of_correlation(r), theta, atol=1e-7)
    assert m.correlation_of_tanh(np.array([0.5]))[0, 1] == pytest.approx(np.tanh(0.5))


def test_derivatives():
    free = m.half_vector(PD)
    np.testing.assert_allclose(m.d_inverse(PD), m.jacobian(lambda v: m.half_vector(np.linalg.inv(m.from_half_vector(v))), free), atol=1e-8)
    a = np.random.default_rng(0).normal(size=(2, 3))
    np.testing.assert_allclose(m.d_sandwich_by_middle(a, PD), m.jacobian(lambda v: m.half_vector(a @ m.from_half_vector(v) @ a.T), free), atol=1e-6)
    sd, r = m.split_covariance(PD)
    both = lambda v: m.half_vector(m.from_half_vector(v[3:], False, True) * np.outer(v[:3], v[:3]))
    np.testing.assert_allclose(m.d_covariance(PD), m.jacobian(both, np.concatenate([sd, m.half_vector(r, False)])), atol=1e-7)
    np.testing.assert_allclose(m.chain(np.eye(2), np.array([[1.0, 2], [3, 4]])), [[1, 2], [3, 4]])


def test_ldlt_updates():
    low, d = m.ldlt(PD)
    np.testing.assert_allclose(low @ np.diag(d) @ low.T, PD)
    v = np.array([1.0, 0.5, -0.3])
    low1, d1 = m.ldlt_update(low, d, v, 0.7)
    np.testing.assert_allclose(low1 @ np.diag(d1) @ low1.T, PD + 0.7 * np.outer(v, v))
    two, mid = np.random.default_rng(1).normal(size=(3, 2)), np.array([[1.0, 0.2], [0.2, 0.5]])
    low2, d2 = m.ldlt_update(low, d, two, mid)
    np.testing.assert_allclose(low2 @ np.diag(d2) @ low2.T, PD + two @ mid @ two.T)
