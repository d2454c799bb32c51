"""Methods to compare with, each a driver loop of vector algebra over the clients' oracles.

Every round is one distributed pass that brings each client's gradient (and Hessian where the method has one for each
client) to the driver; what the driver keeps for the clients is bounded by HELD numbers, larger problems are refused.
Compression happens on vectors with numpy generators, one stream for each client.
"""

from collections.abc import Callable

import numpy as np

from . import solvers
from .compressors import low_rank, packed, power_of_two_randomly, power_sgd, top_k, unpacked
from .problems import Logistic

#: Numbers that the driver may hold for all clients.
HELD = 50_000_000


class Vectors:
    """Vector compressors by name, with omega for the unbiased ones: E|C(v) - v|^2 <= omega |v|^2."""

    #: Other names of the same compressors. Fixed values.
    OTHER = {"rand_sparse": "randk", "rand_dithering": "dithering", "natural_comp": "natural", "no_comp": "none"}

    def __init__(self, name: str, d: int, k: int = 1) -> None:
        self.name, self.d, self.k = self.OTHER.get(name, name), d, k
        self.omega = {"none": 0.0, "randk": d / k - 1, "bernoulli": d / k - 1, "natural": 1 / 8, "dithering": min(d / k**2, d**0.5 / k)}.get(self.name)

    def __call__(self, v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        if self.name == "none":
            return v.copy()
        out = np.zeros(self.d)
        if self.name == "randk":
            at = rng.choice(self.d, self.k, replace=False)
            out[at] = v[at] * (self.d / self.k)
        elif self.name == "topk":
            at = top_k(v, self.k)
            out[at] = v[at]
        elif self.name == "bernoulli":
            out = np.where(rng.random(self.d) < self.k / self.d, v * (self.d / self.k), 0.0)
        elif self.name == "natural":
            out = power_of_two_randomly(v, rng.random(self.d))
        elif self.name == "dithering":
            norm = np.linalg.norm(v)
            out = np.sign(v) * norm * np.floor(self.k * np.abs(v) / norm + rng.random(self.d)) / self.k if norm else out
        else:
            raise ValueError(f"unknown compressor {self.name}")
        return out

    def bits(self) -> float:
        """Bits of one message, at 64 for a number and the entropy of a choice for its places."""
        if self.name == "randk":
            return 64 * self.k
        if self.name == "topk":
            return 64 * self.k + 32 * self.k
        if self.name == "bernoulli":
            p = self.k / self.d
            return 64 * self.k + self.d * (0 if p in (0, 1) else -p * np.log2(p) - (1 - p) * np.log2(1 - p))
        if self.name == "natural":
            return 12 * self.d
        if self.name == "dithering":
            return 64 + self.d * (1 + np.ceil(np.log2(self.k + 1)))
        return 64 * self.d


def biased_rounding(v: np.ndarray, base: float = 2.0) -> tuple[np.ndarray, float]:
    """To the nearest power of base, and the contraction 4 b / (b + 1)^2."""
    low = base ** np.floor(np.log(np.where(v == 0, 1, np.abs(v))) / np.log(base))
    near = np.where(np.abs(v) - low <= base * low - np.abs(v), low, base * low)
    return np.sign(v) * np.where(v == 0, 0, near), 4 * base / (base + 1) ** 2


class Run:
    """Iterates and gradient norms of a method."""

    def __init__(self, problem: Logistic, x0: np.ndarray | None, seed: int) -> None:
        self.p, self.x = problem, np.zeros(problem.d) if x0 is None else x0.astype(float)
        self.norms: list[float] = []
        self.rng = np.random.default_rng(seed)

    def clients(self, second: bool = False):
        found = list(self.p.clients(self.x, second).values())
        if len(found) * self.p.d * (self.p.d if second else 1) > HELD:
            raise ValueError("too many clients or features for a method whose states the driver holds")
        g = np.array([v[1] for v in found])
        self.norms.append(float(np.linalg.norm(g.mean(axis=0))))
        return found, g


def newton(problem: Logistic, rounds: int, x0=None) -> Run:
    run = Run(problem, x0, 0)
    for _ in range(rounds):
        found, g = run.clients(True)
        run.x = run.x - solvers.solve(np.mean([v[2] for v in found], axis=0), g.mean(axis=0))
    return run


def newton_star(problem: Logistic, best: np.ndarray, rounds: int, x0=None) -> Run:
    """Newton steps with the Hessian at the optimum, which only an oracle knows."""
    run, h = Run(problem, x0, 0), problem.hessian(best)
    for _ in range(rounds):
        run.x = run.x - solvers.solve(h, run.clients()[1].mean(axis=0))
    return run


def newton_zero(problem: Logistic, rounds: int, x0=None) -> Run:
    """Newton steps with the Hessian at the start."""
    run = Run(problem, x0, 0)
    h = problem.hessian(run.x)
    for _ in range(rounds):
        run.x = run.x - solvers.solve(h, run.clients()[1].mean(axis=0))
    return run


def gradient_descent(problem: Logistic, rounds: int, x0=None, line_search: bool = False, c: float = 0.5, gamma: float = 0.5) -> Run:
    from .training import mean_losses

    run, rate = Run(problem, x0, 0), 1 / problem.smoothness()
    for _ in range(rounds):
        g = run.clients()[1].mean(axis=0)
        t = rate
        if line_search:
            trials = [rate * 8 * gamma**i for i in range(8)]
            f = mean_losses(problem.samples, [run.x, *(run.x - s * g for s in trials)], problem.lam)
            t = next((s for s, v in zip(trials, f[1:]) if v <= f[0] - c * s * (g @ g)), trials[-1])
        run.x = run.x - t * g
    return run


def learned_newton(problem: Logistic, rounds: int, compress: Callable[[np.ndarray, np.random.Generator], np.ndarray], alpha: float = 1.0, x0=None, cubic: float | None = None, down: Vectors | None = None, eta: float = 1.0, chance: float = 1.0, seed: int = 0) -> Run:
    """Newton steps with learned client Hessians shifted by their mean error.

    cubic: the constant of a cubic model instead of the shift. down: the model is compressed on its way to the clients,
    which then learn from their own copy; gradients are sent with the given chance and else extrapolated by the Hessian."""
    run, d = Run(problem, x0, seed), problem.d
    found, _ = run.clients(True)
    run.norms.clear()
    h, seen = np.array([v[2] for v in found]), run.x.copy()
    anchor, anchor_g = seen.copy(), None
    for _ in range(rounds):
        run.x = seen
        found, g = run.clients(True)
        mean_h, grad = h.mean(axis=0), g.mean(axis=0)
        if anchor_g is None or run.rng.random() < chance:
            anchor, anchor_g = seen.copy(), grad
        else:
            grad = anchor_g + mean_h @ (seen - anchor)
        gaps = np.array([v[2] for v in found]) - h
        shift = float(np.mean([np.linalg.norm(x) for x in gaps]))
        h = h + alpha * np.array([compress(x, run.rng) for x in gaps])
        if cubic is not None:
            step = cubic_step(grad, mean_h + shift * np.eye(d), cubic)
        else:
            step = -solvers.solve(mean_h + shift * np.eye(d), grad)
        run.x = seen + step
        seen = run.x if down is None else seen + eta * down(run.x - seen, run.rng)
    return run


def cubic_step(g: np.ndarray, h: np.ndarray, m: float) -> np.ndarray:
    """The minimiser of g.s + s.H s / 2 + m |s|^3 / 6, by bisection on |s|."""
    w, v = np.linalg.eigh(h)
    rotated = v.T @ g
    size = lambda r: np.linalg.norm(rotated / (w + m * r / 2))
    low, high = max(0.0, -2 * w[0] / m + 1e-12), 1.0
    while size(high) > high:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if size(mid) > mid else (low, mid)
    return -v @ (rotated / (w + m * high / 2))


def matrix_compressor(name: str, d: int, k: int) -> Callable[[np.ndarray, np.random.Generator], np.ndarray]:
    """Compressors of symmetric matrices: topk, randk (unbiased: entries times their number over k), rank, and powersgd from a random start."""

    def apply(m: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        if name == "rank":
            return low_rank(m, k)
        if name == "powersgd":
            return power_sgd(m, rng.normal(size=(d, k)))
        v, n = packed(m), d * (d + 1) // 2
        at = top_k(v, k) if name == "topk" else rng.choice(n, k, replace=False)
        out = np.zeros(n)
        out[at] = v[at] * (n / k if name == "randk" else 1.0)
        return unpacked(out, d)

    if name not in ("topk", "randk", "rank", "powersgd"):
        raise ValueError(f"unknown compressor {name}")
    return apply


def contraction(name: str, m: np.ndarray, k: int) -> float:
    """The share of the squared norm that a compressor is sure to keep, or for rank what it keeps of this matrix; randk has n / k - 1 as its variance instead."""
    n = len(m) * (len(m) + 1) // 2
    if name == "rank":
        w = np.sort(np.abs(np.linalg.eigvalsh(m)))[::-1] ** 2
        return float(w[:k].sum() / w.sum()) if w.sum() else 0.0
    return {"topk": k / n, "powersgd": 0.1, "randk": n / k - 1}[name]


def diana(problem: Logistic, rounds: int, compress: Vectors, x0=None, down: Vectors | None = None, seed: int = 0) -> Run:
    """Gradient steps with compressed differences to learned shifts; with down, the step to the clients is compressed too (as in DORE and Artemis)."""
    run = Run(problem, x0, seed)
    found, g = run.clients()
    run.norms.clear()
    shifts, omega = np.zeros_like(g), compress.omega or 0.0
    alpha, rate = 1 / (1 + omega), 1 / (problem.smoothness() * (1 + 6 * omega / len(found)))
    error, seen = np.zeros(problem.d), run.x.copy()
    for _ in range(rounds):
        run.x = seen
        _, g = run.clients()
        sent = np.array([compress(a - b, run.rng) for a, b in zip(g, shifts)])
        estimate = shifts.mean(axis=0) + sent.mean(axis=0)
        shifts = shifts + alpha * sent
        step = -rate * estimate
        if down is not None:
            asked = step + error
            step = down(asked, run.rng) / (1 + (down.omega or 0.0))
            error = asked - step
        seen = seen + step
        run.x = seen
    return run


def dore(problem: Logistic, rounds: int, up: Vectors, down: Vectors, x0=None, seed: int = 0) -> Run:
    return diana(problem, rounds, up, x0, down, seed)


def artemis(problem: Logistic, rounds: int, up: Vectors, down: Vectors, x0=None, part: float = 1.0, seed: int = 0) -> Run:
    """As DIANA with both directions compressed, without error feedback; a client takes part with chance `part`."""
    run = Run(problem, x0, seed)
    found, g = run.clients()
    run.norms.clear()
    shifts, omega = np.zeros_like(g), up.omega or 0.0
    alpha, rate = 1 / (1 + omega), 1 / (2 * problem.smoothness() * (1 + omega / len(found)) * (1 + (down.omega or 0.0)))
    for _ in range(rounds):
        _, g = run.clients()
        active = run.rng.random(len(g)) < part
        sent = np.array([up(a - b, run.rng) if on else np.zeros(problem.d) for a, b, on in zip(g, shifts, active)])
        estimate = shifts.mean(axis=0) + sent.mean(axis=0) / part
        shifts = shifts + alpha * sent
        run.x = run.x - rate * down(estimate, run.rng)
    return run


def adiana(problem: Logistic, rounds: int, compress: Vectors, x0=None, seed: int = 0) -> Run:
    """DIANA with momentum: gradients at a mixture of two sequences, shifts at a third."""
    run = Run(problem, x0, seed)
    found, g0 = run.clients()
    run.norms.clear()
    n, mu, big, omega = len(found), problem.convexity(), problem.smoothness(), compress.omega or 0.0
    rate = min(1 / (2 * big), n / (64 * omega * (2 * (omega + 1)) ** 2 * big) if omega else 1 / (2 * big))
    theta1, theta2 = min(0.25, (rate * mu / 0.5) ** 0.5), 0.5
    chance, gamma = min(1.0, max(1.0, (omega / 32) ** 0.5 if n else 1.0) / (2 * (1 + omega))), rate / (2 * (theta1 + rate * mu))
    beta, alpha = 1 - gamma * mu, 1 / (1 + omega)
    y = z = w = run.x.copy()
    shifts = np.zeros_like(g0)
    for _ in range(rounds):
        mixed = theta1 * z + theta2 * w + (1 - theta1 - theta2) * y
        run.x = mixed
        _, g = run.clients()
        estimate = shifts.mean(axis=0) + np.mean([compress(a - b, run.rng) for a, b in zip(g, shifts)], axis=0)
        run.x, before = w, run.norms[:]
        _, gw = run.clients()
        run.norms = before
        shifts = shifts + alpha * np.array([compress(a - b, run.rng) for a, b in zip(gw, shifts)])
        y = mixed - rate * estimate
        z = beta * z + (1 - beta) * mixed + gamma / rate * (y - mixed)
        w = y if run.rng.random() < chance else w
        run.x = y
    return run


def nl1(problem: Logistic, rounds: int, k: int, weights: np.ndarray, rows: np.ndarray, x0=None, seed: int = 0) -> Run:
    """Newton steps with learned second-derivative weights of single samples; each client renews k of them a round.

    rows: clients x samples x features, label folded in; weights: the start's weights. For data that the driver can hold."""
    run, (n, m, d) = Run(problem, x0, seed), rows.shape
    if rows.size > HELD:
        raise ValueError("the samples are too many for the driver")
    learned = weights.copy()
    for _ in range(rounds):
        _, g = run.clients()
        h = np.einsum("cs,csi,csj->ij", learned, rows, rows) / (n * m) + problem.lam * np.eye(d)
        s = 1 / (1 + np.exp(-rows @ run.x))
        true = s * (1 - s)
        for c in range(n):
            at = run.rng.choice(m, k, replace=False)
            learned[c, at] = true[c, at]
        run.x = run.x - solvers.solve(h, g.mean(axis=0))
    return run


def dingo(problem: Logistic, rounds: int, theta: float = 1e-4, phi: float = 1e-6, rho: float = 1e-4, x0=None) -> Run:
    """Steps that reduce the gradient's norm, from each client's pseudo-inverse products, with a backtracking search on it."""
    run, d = Run(problem, x0, 0), problem.d
    for _ in range(rounds):
        found, g = run.clients(True)
        grad = g.mean(axis=0)
        mean_h = np.mean([v[2] for v in found], axis=0)
        descent = mean_h @ grad
        p = -np.mean([np.linalg.pinv(v[2]) @ grad for v in found], axis=0)
        if descent @ p > -theta * (grad @ grad):
            steps = []
            for v in found:
                own = -np.linalg.solve(v[2].T @ v[2] + phi**2 * np.eye(d), v[2].T @ grad)
                lack = descent @ own + theta * (grad @ grad)
                if lack > 0:
                    extra = np.linalg.solve(v[2].T @ v[2] + phi**2 * np.eye(d), descent)
                    own = own - lack / (descent @ extra) * extra
                steps.append(own)
            p = np.mean(steps, axis=0)
        t, base = 1.0, grad @ grad
        for _ in range(12):
            new = problem.gradient(run.x + t * p)
            if new @ new <= base + 2 * t * rho * (p @ descent):
                break
            t /= 2
        run.x = run.x + t * p
    return run
