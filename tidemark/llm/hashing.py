"""Vectorised word hashing over batches of texts.

A batch of texts is laid out as one byte buffer; words (maximal runs of bytes
outside space and 0x09-0x0D) are located and hashed with numpy, so that no
Python object is made per word.  Hashes are functions of the word's bytes
alone: equal on every executor, at every size, in every run.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), in place where possible."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on (position, seed) only."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = constants(256, 11)


class Words:
    """The words of a batch: start and stop bytes, 64-bit hashes, and for each text its span of words."""

    def __init__(self, texts, lower: bool, hashed: bool = True):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        if lower:
            raw = [r.translate(_LOWER) for r in raw]
        self.raw = raw
        buf = b"\n".join(raw)
        data = np.frombuffer(buf, np.uint8)
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1] if raw else np.zeros(0, np.int64)
        self.buf, self.begins = buf, begins
        space = np.ones(len(data) + 2, bool)
        if len(data):
            space[1:-1] = _IS_SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.stop = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, begins)
        self.last = np.append(self.first[1:], len(self.start))
        self.hash = self._hash(data) if hashed else None

    def _hash(self, data: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        size = self.stop - self.start
        powers = constants(int(size.max()), 23)
        out = np.empty(len(size), U64)
        step = 1 << 17  # words at a time, so the wide temporaries stay small
        for a in range(0, len(size), step):
            b = min(a + step, len(size))
            n = size[a:b]
            at = np.cumsum(n) - n
            within = np.arange(int(n.sum())) - np.repeat(at, n)
            at_byte = np.repeat(self.start[a:b], n) + within
            out[a:b] = np.add.reduceat(_BYTE[data[at_byte]] * powers[within], at)
        return mix64(out + size.astype(U64))

    def of(self, k: int) -> np.ndarray:
        """The word hashes of text k."""
        return self.hash[self.first[k] : self.last[k]]


def windows(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words (empty when there are fewer than n)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    c = constants(n, seed)
    out = words[:m] * c[0]
    for i in range(1, n):
        out += words[i : i + m] * c[i]
    return mix64(out)


def windows_rolling(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """As :func:`windows`, in time independent of n: prefix sums of word * base**i, times the inverse power."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    base = int(constants(1, seed)[0])
    inverse = pow(base, -1, 1 << 64)
    up = _powers(base, len(words))
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up, out=total[1:])
    return mix64((total[n:] - total[:-n]) * _powers(inverse, m))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = U64(base)
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]
