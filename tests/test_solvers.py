import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newtonmill.plans import solvers as S


def test_cholesky_golden():
    low = np.array([[1.0, 0, 0], [4, 7, 0], [1, 2, 5]])
    assert np.allclose(S.cholesky(low @ low.T), low)
    assert np.allclose(low @ low.T, [[1, 4, 1], [4, 65, 18], [1, 18, 30]])
    assert S.cholesky(np.array([[1.0, 2], [4, 7]]) @ np.diag([1.0, -1])) is None


def test_systems_with_and_without_solution():
    x, null = S.gauss(np.array([[1.0, 2], [2, 4]]), np.array([5.0, 7]))
    assert x is None and null.shape == (2, 1)
    a = np.array([[1.0, 2, 2, 2], [2, 4, 6, 8], [3, 6, 8, 10], [0, 0, 2, 4]])
    x, null = S.gauss(a, np.zeros(4))
    assert null.shape[1] == 2 and np.allclose(a @ null, 0) and S.rank(a) == 2
    b = a @ np.array([1.0, 2, 3, 4])
    x, _ = S.gauss(a, b)
    assert np.allclose(a @ x, b)
    assert S.gauss(a, b + np.array([0, 0, 1.0, 0]))[0] is None


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10_000))
def test_solvers_agree(d, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(d, d))
    a, b = m @ m.T + d * np.eye(d), rng.normal(size=d)
    x = np.linalg.solve(a + 0.5 * np.eye(d), b)
    assert np.allclose(S.solve(a, b, 0.5), x)
    assert np.allclose(S.gauss(a + 0.5 * np.eye(d), b)[0], x)
    assert np.allclose(S.conjugate_gradient(a + 0.5 * np.eye(d), b), x, atol=1e-6)
    y = np.zeros(d)
    for _ in range(400):
        y = S.gauss_seidel(a, y, b)
    assert np.allclose(y, np.linalg.solve(a, b), atol=1e-6)
    q, rest, r = S.qr(m)
    assert np.allclose(q @ r, m) and np.allclose(q.T @ rest, 0)


def test_tridiagonal_diagonal_and_projection():
    n = 6
    low, own, up = np.full(n, -1.0), np.full(n, 4.0), np.full(n, -1.5)
    a = np.diag(own) + np.diag(low[1:], -1) + np.diag(up[:-1], 1)
    b = np.arange(n) + 1.0
    assert np.allclose(a @ S.tridiagonal(low, own, up, b), b)
    assert np.allclose(S.diagonal(np.array([2.0, 0]), np.array([4.0, 0])), [2, 0])
    assert S.diagonal(np.array([2.0, 0]), np.array([4.0, 1])) is None
    w = np.linalg.eigvalsh(S.project_above(np.diag([3.0, -2, 0.1]), 0.5))
    assert np.allclose(sorted(w), [0.5, 0.5, 3])


def test_unsolvable_raises():
    with pytest.raises(np.linalg.LinAlgError):
        S.solve(np.array([[1.0, 2], [2, 4]]), np.array([5.0, 7]))


def test_numeric_derivatives():
    a = np.array([[2.0, 1], [1, 5]])
    f = lambda x: 0.5 * x @ a @ x + x[0]
    x = np.array([0.3, -1.0])
    assert np.allclose(S.numeric_gradient(f, x), a @ x + [1, 0], atol=1e-6)
    assert np.allclose(S.numeric_hessian(f, x), a, atol=1e-4)
