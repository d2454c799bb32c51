"""Dense solvers and factorisations for the driver's small systems, in numpy."""

import numpy as np


def cholesky(a: np.ndarray, shift: float = 0.0) -> np.ndarray | None:
    """L with L Lᵀ = a + shift I, or None if that is not positive definite."""
    try:
        return np.linalg.cholesky(a + shift * np.eye(len(a)))
    except np.linalg.LinAlgError:
        return None


def forward(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.zeros(len(b))
    for i in range(len(b)):
        x[i] = (b[i] - lower[i, :i] @ x[:i]) / lower[i, i]
    return x


def backward(upper: np.ndarray, b: np.ndarray) -> np.ndarray:
    return forward(upper[::-1, ::-1], b[::-1])[::-1]


def solve(a: np.ndarray, b: np.ndarray, shift: float = 0.0) -> np.ndarray:
    """(a + shift I) x = b by Cholesky, else by elimination; raises if neither works."""
    lower = cholesky(a, shift)
    if lower is not None:
        return backward(lower.T, forward(lower, b))
    x, null = gauss(a + shift * np.eye(len(a)), b)
    if x is None or null.shape[1]:
        raise np.linalg.LinAlgError("the system has no single solution")
    return x


def gauss(a: np.ndarray, b: np.ndarray, eps: float = 1e-12) -> tuple[np.ndarray | None, np.ndarray]:
    """A solution of a x = b (None if there is none) and a basis of the null space as columns, by elimination with row pivots."""
    rows, n = a.shape
    m, pivots = np.hstack([a.astype(float), b.reshape(-1, 1).astype(float)]), []
    scale = max(1.0, float(np.abs(m).max(initial=0)))
    for column in range(n):
        r = len(pivots)
        if r == rows:
            break
        best = r + int(np.argmax(np.abs(m[r:, column])))
        if abs(m[best, column]) <= eps * scale:
            continue
        m[[r, best]] = m[[best, r]]
        m[r] /= m[r, column]
        others = np.arange(rows) != r
        m[others] -= np.outer(m[others, column], m[r])
        pivots.append(column)
    free = [c for c in range(n) if c not in pivots]
    null = np.zeros((n, len(free)))
    for k, c in enumerate(free):
        null[c, k] = 1
        null[pivots, k] = -m[: len(pivots), c]
    if np.any(np.abs(m[len(pivots) :, n]) > 1e-9 * scale):
        return None, null
    x = np.zeros(n)
    x[pivots] = m[: len(pivots), n]
    return x, null


def rank(a: np.ndarray) -> int:
    return a.shape[1] - gauss(a, np.zeros(len(a)))[1].shape[1]


#: The eight greatest primes below 2^31: a product of two remainders fits into 64 bits, and the product of all is above 2^247.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def whole(*parts: np.ndarray) -> bool:
    """Whether all items are whole numbers below 2^53, which doubles hold without rounding."""
    return all(bool(np.all((np.abs(x) < 2.0**53) & (x == np.floor(x)))) for x in parts)


def whole_ranks(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Ranks of a and of a with the column b, of whole numbers, without a tolerance: the greatest of those modulo PRIMES.

    A rank modulo a prime is never too great, and too small only if the prime divides all minors of the true rank's size. A minor other than 0 of up to four columns is below 2^216, so not all primes divide it; of larger ones all would have to by chance."""
    rows, n = a.shape
    start, found = np.column_stack([a, b]).astype(np.int64), (0, 0)
    for p in PRIMES:
        m, r = start % p, 0
        for column in range(n):
            at = r + np.flatnonzero(m[r:, column])
            if not len(at):
                continue
            m[[r, at[0]]] = m[[at[0], r]]
            m[r] = m[r] * pow(int(m[r, column]), -1, p) % p
            m[r + 1 :, column:] = (m[r + 1 :, column:] - m[r + 1 :, [column]] * m[r, column:]) % p
            r += 1
        found = max(found[0], r), max(found[1], r + int(m[r:, n].any()))
        if found == (min(rows, n), min(rows, n + 1)):
            break
    return found


def tridiagonal(low: np.ndarray, own: np.ndarray, up: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solves a system with the three diagonals given (low[0] and up[-1] unused) by two sweeps."""
    n = len(b)
    c, d = np.zeros(n), np.zeros(n)
    for i in range(n):
        below = own[i] - (low[i] * c[i - 1] if i else 0.0)
        c[i] = up[i] / below if i < n - 1 else 0.0
        d[i] = (b[i] - (low[i] * d[i - 1] if i else 0.0)) / below
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def diagonal(own: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """None if an empty row asks for something."""
    if np.any((own == 0) & (b != 0)):
        return None
    return np.divide(b, own, out=np.zeros(len(b)), where=own != 0)


def jacobi(a: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    own = np.diag(a)
    return (b - (a @ x - own * x)) / own


def gauss_seidel(a: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = x.copy()
    for i in range(len(b)):
        x[i] = (b[i] - a[i] @ x + a[i, i] * x[i]) / a[i, i]
    return x


def conjugate_gradient(a: np.ndarray, b: np.ndarray, steps: int | None = None, eps: float = 1e-12) -> np.ndarray:
    x, r = np.zeros(len(b)), b.astype(float).copy()
    p, rr = r.copy(), r @ r
    for _ in range(steps or len(b)):
        if rr <= eps * eps:
            break
        ap = a @ p
        t = rr / (p @ ap)
        x, r = x + t * p, r - t * ap
        before, rr = rr, r @ r
        p = r + rr / before * p
    return x


def qr(a: np.ndarray, eps: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orthonormal bases of the range and of its complement, and the coefficients: range @ coefficients = a."""
    basis: list[np.ndarray] = []
    for v in [*a.T, *np.eye(len(a))]:
        rest = v.astype(float).copy()
        for _ in range(2):
            for q in basis:
                rest -= (q @ rest) * q
        if np.linalg.norm(rest) > eps * max(1.0, np.linalg.norm(v)):
            basis.append(rest / np.linalg.norm(rest))
    q = np.array(basis).T
    r = rank(a)
    return q[:, :r], q[:, r:], q[:, :r].T @ a


def project_above(a: np.ndarray, mu: float) -> np.ndarray:
    """The nearest symmetric matrix whose eigenvalues are at least mu."""
    w, v = np.linalg.eigh((a + a.T) / 2)
    return (v * np.maximum(w, mu)) @ v.T


def numeric_gradient(f, x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    step = h * np.eye(len(x))
    return np.array([(f(x + s) - f(x - s)) / (2 * h) for s in step])


def numeric_hessian(f, x: np.ndarray, h: float = 1e-4) -> np.ndarray:
    step = h * np.eye(len(x))
    return np.array([[(f(x + s + t) - f(x + s - t) - f(x - s + t) + f(x - s - t)) / (4 * h * h) for t in step] for s in step])
