"""Words of whole texts as arrays of digests, computed for many texts at once.

A word is a maximal run of characters other than space and U+0009 to U+000D.
A word's digest is a 64-bit polynomial over its UTF-8 bytes, mixed; a window's
digest combines the digests of its words in order.  All work is done on arrays
over a chunk of texts, so its cost is a few passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK_BYTES = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for b in (int(BASE), pow(int(BASE), -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


class Words:
    """The words of some texts: digests, and the bounds of each text's words."""

    def __init__(self, texts: Sequence[str | None]):
        parts = [(t or "").encode("utf-8", "replace") for t in texts]
        data = b"\n".join(parts) + b"\n"
        self.data = data
        buf = np.frombuffer(data, np.uint8)
        space = SPACE[buf]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        text_starts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=text_starts[1:])
        self.bounds = np.searchsorted(self.starts, text_starts)
        if len(self.starts):
            power, inverse = _power(len(buf) + 1)
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(BYTE[buf] * power[: len(buf)], out=total[1:])
            self.digests = mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))
        else:
            self.digests = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def windows(digests: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Digest of the ``width`` words from each position on; the last ``width - 1`` positions are absent."""
    n = len(digests) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xA24BAED4963EE407 + 2 * seed * 0x9FB21C651E98DF25) % (1 << 64) | 1)
    out = None
    done = 0
    block, size = digests, 1  # digests of 1, 2, 4, ... words
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                part = block[done: done + n]
                out = part.copy() if out is None else mix(out * base) + part
                done += size
            if size * 2 > width:
                break
            block = mix(block[:-size] * base) + block[size:]
            size *= 2
    return mix(out + np.uint64(seed))


def inside(bounds: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n window positions lie within one text."""
    ok = np.ones(max(n, 0), bool)
    for back in range(1, width):
        at = bounds[1:-1] - back
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        k = len(t) if t else 0
        if size and size + k > limit:
            yield first, i
            first, size = i, 0
        size += k
    if first < len(texts):
        yield first, len(texts)
