"""Words of many texts at once, as arrays: where each begins and ends, and its hash."""

from __future__ import annotations

import numpy as np

from .common import CHUNK

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random number a byte value, and an odd base; the sums below are polynomials of them modulo 2**64.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX1)
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)))) for b in (BASE, INVERSE)]
    return _POWERS


class Tokens:
    """The tokens of some texts: where each begins and stops in `raw`, its hash, and which are ends of texts.

    The first token is an end too: it stands before the first text as the last text's end stands before the next.
    `ends` are the places of the ends among the tokens: text i is what lies between ends i and i + 1.
    """

    def __init__(self, texts: list[str | None], *, fold: bool = True):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b" \n " + b" \n ".join(parts) + b" \n "
        if fold:
            self.raw = self.raw.lower()
        a = np.frombuffer(self.raw, dtype=np.uint8)
        inside = ~SPACE[a]
        marks = np.concatenate(([1], 1 + np.cumsum([len(p) + 3 for p in parts], dtype=np.int64)))
        inside[marks] = True
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.stops = edges[::2], edges[1::2]
        up, down = powers(max(len(a), CHUNK * 2))
        sums = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(BYTES[a] * up[: len(a)], out=sums[1:])
        self.hashes = mixed((sums[self.stops] - sums[self.starts]) * down[self.starts] + (self.stops - self.starts).astype(np.uint64) * MIX2)
        self.ends = np.searchsorted(self.starts, marks)


def runs_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """Of every `length` hashes in a row, one hash."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[length:] - sums[:n]) * down[:n])
