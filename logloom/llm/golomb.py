"""Golomb-Rice coding of sorted integers, vectorised, and a Bloom filter of fixed size."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def encode(values: np.ndarray) -> bytes:
    """Sorted uint64 values (equal ones allowed) as: count, first value, Rice parameter, unary quotients, packed remainders.

    The Rice parameter is the power of two nearest below the mean gap, which is the optimum for hashes.
    """
    v = np.asarray(values, np.uint64)
    if not len(v):
        return np.array([0], np.uint64).tobytes()
    gaps = np.diff(v)
    mean = int(v[-1] - v[0]) // max(1, len(gaps))
    k = max(0, mean.bit_length() - 1)
    head = np.array([len(v), v[0], k], np.uint64).tobytes()
    if not len(gaps):
        return head
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = b""
    if k:
        rest = gaps & np.uint64((1 << k) - 1)
        width = (k + 7) // 8
        bits = np.unpackbits(rest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :], axis=1)[:, width * 8 - k :]
        low = np.packbits(bits.reshape(-1)).tobytes()
    return head + np.array([len(unary)], np.uint64).tobytes() + np.packbits(unary).tobytes() + low


def decode(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint64, 1)[0])
    if not n:
        return np.zeros(0, np.uint64)
    first, k = (int(x) for x in np.frombuffer(data, np.uint64, 2, 8))
    out = np.empty(n, np.uint64)
    out[0] = first
    if n > 1:
        length = int(np.frombuffer(data, np.uint64, 1, 24)[0])
        middle = 32 + (length + 7) // 8
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, middle - 32, 32), count=length))
        gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
        if k:
            width = (k + 7) // 8
            bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, middle), count=(n - 1) * k).reshape(n - 1, k)
            wide = np.zeros((n - 1, 64), np.uint8)
            wide[:, 64 - k :] = bits
            gaps += np.packbits(wide, axis=1).reshape(n - 1, 8).view(">u8").reshape(-1).astype(np.uint64)
            del width
        out[1:] = gaps
    return np.cumsum(out, dtype=np.uint64)


class Bloom:
    """Three probes into a table of 2**bits bits. A full table lets more pass, never fewer."""

    def __init__(self, bits: int, table: np.ndarray | None = None) -> None:
        self.bits, self.table = bits, np.zeros(1 << (bits - 3), np.uint8) if table is None else table

    def _probes(self, keys: np.ndarray) -> list[np.ndarray]:
        h = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return [(mix(h + np.uint64(i)) >> np.uint64(64 - self.bits)).astype(np.int64) for i in range(3)]

    def add(self, keys: np.ndarray) -> None:
        for p in self._probes(keys):
            np.bitwise_or.at(self.table, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in self._probes(keys):
            found &= (self.table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return found
