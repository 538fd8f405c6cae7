"""Hashes of all word shingles or byte strings of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be inverted
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread bits, so that order and ranges of hashes are as good as random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Rolling:
    """Prefix sums of a text's polynomial hash modulo 2**64; the hash of any span takes two look-ups."""

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._power) <= n:
            size = max(n + 1, 1 << 16)
            up, down = np.full(size, _BASE), np.full(size, _BACK)
            up[0] = down[0] = 1
            cls._power, cls._inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def __init__(self, raw: bytes):
        n = len(raw)
        self._grow(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * self._power[:n], out=self.sums[1:])

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self._inverse[first])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - 1 - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self._inverse[:n])


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-case (A-Z) words between ASCII white space."""
    return (raw or b"").translate(_LOWER).split()


def key_of(words: list[bytes]) -> tuple[int, int]:
    """128-bit key of a word sequence as two signed numbers."""
    d = hashlib.md5(b" ".join(words)).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shingle_sets(texts: list[list[bytes]], size: int = 5, buffer: int = 1 << 20) -> list[np.ndarray]:
    """Sorted distinct hashes of the `size`-word shingles of each word list; a shorter list is one shingle, none is empty."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        group, length = [], 0
        while at < len(texts) and (not group or length < buffer):
            joined = b" ".join(texts[at])
            group.append((joined, texts[at]))
            length += len(joined) + 1
            at += 1
        roll = Rolling(b"\n".join(j for j, _ in group))
        base = 0
        for joined, w in group:
            n = len(w)
            if n:
                ends = base + np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
                starts = np.concatenate(([base], ends[:-1] + 1))
                k = min(size, n)
                out.append(np.unique(roll.spans(starts[: n - k + 1], ends[k - 1 :])))
            else:
                out.append(np.zeros(0, np.uint64))
            base += len(joined) + 1
    return out
