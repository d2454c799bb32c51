"""Words and shingles of whole Arrow text columns as 64-bit hashes, without a Python loop over words.

A word is a maximal run of bytes outside space and tab to carriage return. Hashes are polynomials over a random
byte table, taken from prefix sums and finished by a mixer; equal words have equal hashes.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BASE = int(_rng.integers(1 << 62, dtype=np.int64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLAIN = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes whose words are hashed at a time.
_SLICE = 1 << 20
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and one past the last
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offset of each text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] :] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def scan(column: pa.Array, fold: bool = False) -> Words:
    """The words of each text; fold lower-cases A-Z."""
    data, offsets = text_bytes(column)
    inside = ~_SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), _hash(data, starts, ends, _FOLDED if fold else _PLAIN))


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, "right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = _power_tables(max(_SLICE, int(hi - lo)) + 1)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U)
        i = j
    return mix(out)


def joined(h: np.ndarray, length: int, target: int) -> np.ndarray:
    """From hashes of all runs of `length` words, those of `target` words, length < target <= 2 * length; the end of a text is not heeded."""
    gap = target - length
    return mix(h[: len(h) - gap] * U(0x9E3779B97F4A7C15) + mix(h[gap:] ^ U(target)))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (shorter by n - 1 than h), by doubling the length."""
    length = 1
    while length < n and len(h):
        target = min(2 * length, n)
        h, length = joined(h, length, target) if len(h) > target - length else h[:0], target
    return h


def whole(h: np.ndarray) -> int:
    """Hash of a sequence of any length."""
    return int(mix(np.sum(mix(h + np.arange(len(h), dtype=U) * U(0x9E3779B97F4A7C15)), dtype=U, keepdims=True) + np.full(1, len(h), U))[0])


def wholes(h: np.ndarray, n: int) -> np.ndarray:
    """whole() of the n values from each on; for small n."""
    last = len(h) - n + 1
    return mix(sum((mix(h[j : last + j] + U(j * 0x9E3779B97F4A7C15 % (1 << 64))) for j in range(n)), np.full(max(last, 0), n, U)))


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each text; a shorter text's whole sequence is its one shingle, no words give none."""
    grams, out = runs(words.hashes, n), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        else:
            out.append(np.array([whole(words.hashes[a:b])], U) if b > a else np.zeros(0, U))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
