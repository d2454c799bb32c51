"""Random streams in numpy for kernels: each starts from a seed, so a task that runs again draws the same numbers."""

import numpy as np

M64 = (1 << 64) - 1


class XorShift:
    """64-bit xorshift with a multiplication at the end."""

    def __init__(self, seed: int) -> None:
        self.state = seed & M64 or 1

    def integer(self) -> int:
        x = self.state
        x ^= x >> 12
        x ^= x << 25 & M64
        x ^= x >> 27
        self.state = x
        return x * 2685821657736338717 & M64

    def unit(self) -> float:
        return (self.integer() >> 11) / (1 << 53)

    def batch(self, n: int) -> np.ndarray:
        return np.array([self.unit() for _ in range(n)])


def mersenne(seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.MT19937(seed))


def shuffled(n: int, seed: int, first: int | None = None) -> np.ndarray:
    """A seeded order of n numbers, or its first ones."""
    return mersenne(seed).permutation(n)[:first]
