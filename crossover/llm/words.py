"""Words and windows of words of many texts at once, as arrays: places, 64-bit word hashes, window hashes, sliding minima.

Texts come normalised: UTF-8 words joined by single spaces. A window's hash is a polynomial over its words' mixed hashes, so all
windows of a slice cost a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
_PART = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z lower-cased, and all below 0x80 that is neither digit nor letter turned into a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: bytes, table: bytes | None = None) -> bytes:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, after ``table``, joined by single spaces."""
    return b" ".join((text.translate(table) if table else text).split())


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i below n, modulo 2**64."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (key, pow(key, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[key] = tuple(out)
    return _POWERS[key]


def range_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.uint64 = _Q) -> np.ndarray:
    """Polynomial hash of values[lo:hi] for each pair."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[hi] - sums[lo]) * down[lo]


@dataclass
class Words:
    """Words of several texts: ``buf`` holds them; word w is buf[starts[w]:ends[w]], text d has words first[d]:first[d + 1]."""

    buf: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        buf = b"\n".join(texts) + b"\n" if texts else b""
        a = np.frombuffer(buf, dtype=np.uint8)
        ends = np.flatnonzero((a == 32) | (a == 10))
        starts = np.empty_like(ends)
        if len(ends):
            starts[0] = 0
            starts[1:] = ends[:-1] + 1
        full = starts < ends
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], dtype=np.int64)
        return cls(buf, starts[full], ends[full], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.starts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        a = np.frombuffer(self.buf, dtype=np.uint8)
        out = np.empty(len(self), dtype=np.uint64)
        w = 0
        while w < len(self):
            at = self.starts[w]
            end = max(w + 1, int(np.searchsorted(self.ends, at + _PART, side="right")))
            part = _BYTE[a[at : self.ends[end - 1]]]
            out[w:end] = range_hashes(part, self.starts[w:end] - at, self.ends[w:end] - at, _P)
            w = end
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def windows(self, k: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First and end word of every window of k words; a text of fewer words, but not none, may count as one window."""
        n = np.diff(self.first)
        count = np.maximum(n - k + 1, ((n > 0) & (n < k)).astype(np.int64) if whole_if_short else 0)
        lo = np.arange(int(count.sum())) + np.repeat(self.first[:-1] - (np.cumsum(count) - count), count)
        return lo, np.minimum(lo + k, np.repeat(self.first[1:], count))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i:i + n] for each i."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each of n places lies in any lo:hi."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d[:-1]) > 0
