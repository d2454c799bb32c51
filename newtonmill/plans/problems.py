"""Objectives behind one interface: value, gradient and Hessian at a point, with the constants that step sizes need."""

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from . import training
from .compressors import unpacked


class Problem(Protocol):
    d: int

    def value(self, x: np.ndarray) -> float: ...

    def gradient(self, x: np.ndarray) -> np.ndarray: ...

    def hessian(self, x: np.ndarray) -> np.ndarray: ...


class Quadratic:
    """x.A x / 2 + b.x + c with a symmetric A."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: float = 0.0) -> None:
        self.a, self.b, self.c, self.d = (a + a.T) / 2, b, c, len(b)

    def value(self, x: np.ndarray) -> float:
        return float(0.5 * (x @ self.a @ x) + self.b @ x + self.c)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        return self.a @ x + self.b

    def hessian(self, x: np.ndarray) -> np.ndarray:
        return self.a


class Logistic:
    """L2-regularised logistic loss, averaged over clients of equal size; each call is one pass over the samples."""

    def __init__(self, samples: DataFrame, lam: float, d: int) -> None:
        self.samples, self.lam, self.d = samples, lam, d

    def clients(self, x: np.ndarray, second: bool = True) -> dict[int, tuple[float, np.ndarray, np.ndarray | None]]:
        """(f, gradient, Hessian) of each client, for methods that keep a vector or matrix for each."""
        out = {}
        for r in training.client_sums(self.samples, x, second).toLocalIterator():
            h = unpacked(np.frombuffer(r.h) / r.n, self.d) + self.lam * np.eye(self.d) if second else None
            out[r.client_id] = (r.loss / r.n + self.lam / 2 * float(x @ x), np.frombuffer(r.g) / r.n + self.lam * x, h)
        return dict(sorted(out.items()))

    def _mean(self, x: np.ndarray, part: int, second: bool = False):
        own = [v[part] for v in self.clients(x, second).values()]
        return sum(own[1:], own[0]) / len(own)

    def value(self, x: np.ndarray) -> float:
        return float(training.mean_losses(self.samples, [x], self.lam)[0])

    def gradient(self, x: np.ndarray) -> np.ndarray:
        return self._mean(x, 1)

    def hessian(self, x: np.ndarray) -> np.ndarray:
        return self._mean(x, 2, True)

    def convexity(self) -> float:
        return self.lam

    def smoothness(self) -> float:
        return training.smoothness(self.samples, self.lam)
