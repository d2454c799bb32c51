"""Compressors of packed upper triangles (by columns) as numpy kernels, with their sizes, step sizes and random streams."""

from dataclasses import dataclass

import numpy as np

NAMES = ("identical", "topk", "toplek", "randk", "seqk", "natural")
#: Multiplier and increment of the 32-bit generator. Fixed values.
LCG_A, LCG_C = 214013, 2531011


@dataclass
class Lcg:
    """A 32-bit linear congruential generator whose state travels with its client."""

    state: int

    def integer(self) -> int:
        self.state = (self.state * LCG_A + LCG_C) % (1 << 32)
        return self.state

    def unit(self) -> float:
        return self.integer() / ((1 << 32) - 1)

    def first_of_shuffle(self, n: int, k: int) -> np.ndarray:
        """k distinct numbers under n, by a partial shuffle that remembers only moved places."""
        moved: dict[int, int] = {}
        out = np.empty(k, np.int64)
        for i in range(k):
            j = i + min(int(self.unit() * (n - i)), n - i - 1)
            out[i] = moved.get(j, j)
            moved[j] = moved.get(i, i)
        return np.sort(out)


def packed(m: np.ndarray) -> np.ndarray:
    return m.T[np.tril_indices(len(m))]


def unpacked(v: np.ndarray, d: int) -> np.ndarray:
    m = np.zeros((d, d))
    m[np.tril_indices(d)] = v
    return m + np.tril(m, -1).T


def weights(d: int) -> np.ndarray:
    """2 for entries off the diagonal, which stand for two, and 1 on it."""
    i, j = np.tril_indices(d)
    return np.where(i == j, 1.0, 2.0)


def frobenius(v: np.ndarray, d: int) -> float:
    return float(np.sqrt(weights(d) @ (v * v)))


def power_of_two(v: np.ndarray) -> np.ndarray:
    """Sign and exponent alone; subnormals become 0."""
    return (v.view(np.int64) & np.int64(-(1 << 52))).view(np.float64) * (np.abs(v) >= np.finfo(float).tiny)


def power_of_two_randomly(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The power of two below or above, with the chance that keeps the mean."""
    low = power_of_two(v)
    up = np.divide(v - low, low, out=np.zeros(len(v)), where=low != 0)
    return np.where(u < up, 2 * low, low)


def top_k(v: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest magnitudes, in rising order; of equal ones the smaller position wins."""
    return np.sort(np.lexsort((np.arange(len(v)), -np.abs(v)))[:k])


def top_lek(v: np.ndarray, d: int, k: int, delta: float, u: float, slack: float = 0.1) -> np.ndarray:
    """As few of the k greatest as keep the residual within (1 - delta + slack) of the squared norm, rounded at random between the two sizes around it."""
    order = np.lexsort((np.arange(len(v)), -np.abs(v)))[:k]
    energy = weights(d) * v * v
    whole = energy.sum()
    residual = np.concatenate([[whole], whole - np.cumsum(energy[order])])
    bound = (1 - delta + slack) * whole
    m = int(np.argmax(residual <= bound)) if np.any(residual <= bound) else len(order)
    if m and residual[m - 1] > residual[m] and residual[m] <= bound:
        share = (residual[m - 1] - bound) / (residual[m - 1] - residual[m])
        m -= u >= share
    return np.sort(order[:m])


@dataclass(frozen=True)
class Compressor:
    name: str
    d: int
    k: int
    alpha: float

    @property
    def n(self) -> int:
        return self.d * (self.d + 1) // 2

    def apply(self, v: np.ndarray, rng: Lcg) -> tuple[np.ndarray, np.ndarray]:
        """Positions and values of the compressed triangle."""
        everything = np.arange(self.n)
        if self.name == "identical":
            return everything, v
        if self.name == "natural":
            return everything, power_of_two(v)
        if self.name == "topk":
            at = top_k(v, self.k)
        elif self.name == "toplek":
            at = top_lek(v, self.d, self.k, self.k / self.n, rng.unit())
        elif self.name == "randk":
            at = rng.first_of_shuffle(self.n, self.k)
            return at, v[at] * (self.n / self.k)
        elif self.name == "seqk":
            at = np.sort((rng.integer() % self.n + np.arange(self.k)) % self.n)
            return at, v[at] * (self.n / self.k)
        else:
            raise ValueError(f"unknown compressor {self.name}")
        return at, v[at]

    def message_bytes(self, sent: int, send_indices: bool = False) -> tuple[int, int]:
        """Bytes of values and of indices. Random positions are replayed from the seed, so they are not sent unless asked for."""
        if self.name == "natural":
            return -(-sent // 2) * 3, 0
        return 8 * sent, 4 * sent if self.name in ("topk", "toplek") or send_indices and self.name in ("randk", "seqk") else 0


def compressor(name: str, d: int, k_mult: float = 8.0, alpha: float | None = None, option: int = 2) -> Compressor:
    """k is k_mult * d, all entries for identical and natural. alpha: given, or by rule; option 1 or 2 for topk and toplek."""
    n = d * (d + 1) // 2
    k = n if name in ("identical", "natural") else int(k_mult * d)
    if not 0 < k <= n:
        raise ValueError(f"k = {k} is not within 1 and {n}")
    if alpha is None:
        omega, delta = n / k - 1, k / (d * d)
        alpha = {"identical": 1.0, "natural": 8 / 9, "randk": 1 / (omega + 1), "seqk": 1 / (omega + 1)}.get(name) or (1.0 if option == 2 else 1 - (1 - min(1.0, delta)) ** 0.5)
    return Compressor(name, d, k, alpha)


def pack_pairs(v: np.ndarray) -> bytes:
    """Values with sign and exponent alone, two in three bytes."""
    bits = (np.concatenate([v, np.zeros(len(v) % 2)]).view(np.int64) >> 52 & 0xFFF).astype(np.uint32).reshape(-1, 2)
    both = bits[:, 0] | bits[:, 1] << 12
    return np.stack([both & 255, both >> 8 & 255, both >> 16], axis=1).astype(np.uint8).tobytes()


def unpack_pairs(data: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64).reshape(-1, 3)
    both = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return (np.stack([both & 0xFFF, both >> 12], axis=1).reshape(-1)[:n] << 52).view(np.float64)


def low_rank(m: np.ndarray, r: int) -> np.ndarray:
    w, v = np.linalg.eigh(m)
    at = np.argsort(-np.abs(w))[:r]
    return (v[:, at] * w[at]) @ v[:, at].T


def power_sgd(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """One power step from the start q."""
    p = np.linalg.qr(m @ q)[0]
    return p @ (m.T @ p).T


def dithering(v: np.ndarray, levels: int, u: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v)
    return np.sign(v) * norm * np.floor(levels * np.abs(v) / norm + u) / levels if norm else np.zeros(len(v))
