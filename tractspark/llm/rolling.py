"""Polynomial hashes of windows of bytes or numbers, from prefix sums, for numpy arrays.

`Hashes` (modulo 2^64) only choose anchors and groups: texts can be built whose values are equal for every odd base, so equal values tell nothing.
`SafeHashes` (modulo two primes, with bases drawn for each run) are equal for different windows of n symbols with a chance of (n / 2^31)^2."""

from __future__ import annotations

import secrets

import numpy as np

_U = np.uint64
#: An odd multiplier.
BASE = 0x9E3779B97F4A7C15
PRIMES = (2**31 - 1, 2**31 - 19)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n, base, _U))))
        down = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n, pow(base, -1, 1 << 64), _U))))
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of each hash spread over all 64."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Hashes:
    """Hashes of any windows [start, stop) of an array."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        if base not in self.tables or len(self.tables[base][0]) < n + 1:
            self.tables[base] = _powers(base, n + n // 2 + 1)
        self.up, self.down = self.tables[base]
        self.sums = np.zeros(n + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * self.up[:n], out=self.sums[1:])

    def window(self, start, stop) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def draw_bases() -> tuple[int, int]:
    return tuple(2**20 + secrets.randbelow(p - 2**21) for p in PRIMES)


class SafeHashes:
    """Hashes of any windows [start, stop) of an array of bytes or of numbers from 0 on."""

    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, bases: tuple[int, int]):
        self.sums, self.down, n = [], [], len(data)
        # Sums of a byte's products stay whole in 63 bits up to this many.
        plain = data.dtype == np.uint8 and n < 1 << 22
        for p, base in zip(PRIMES, bases):
            up, down = self._powers(p, base, n + 1)
            terms = (data.astype(np.int64) + 1) * up[:n] if data.dtype == np.uint8 else (data % p + 1) * up[:n]
            self.sums.append(np.concatenate(([0], np.cumsum(terms if plain else terms % p))))
            self.down.append(down)

    def _powers(self, p: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables.get((p, base), ((),))[0]) < n:
            if len(self.tables) > 16:  # bases of earlier runs
                self.tables.clear()
            made = []
            for b in (base, pow(base, -1, p)):
                table = np.ones(1, np.int64)
                while len(table) < n:
                    table = np.concatenate([table, table * pow(b, len(table), p) % p])
                made.append(table)
            self.tables[p, base] = tuple(made)
        return self.tables[p, base]

    def window(self, start, stop) -> np.ndarray:
        one, two = (((s[stop] - s[start]) % p) * d[start] % p for s, d, p in zip(self.sums, self.down, PRIMES))
        return one << 31 | two
