"""Vectorised word finding, rolling hashes and content-defined sampling over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64


def _table(pattern_bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: Bytes of words [^\x20\x09-\x0D]+.
SPACED = _table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text.
ALNUM = _table(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any span, from prefix sums; an odd base has an inverse, so spans at different places agree."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n, base, U)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """The hash of each `width` consecutive values, for each start where they fit."""
        n = len(values) - width + 1
        if n <= 0:
            return np.zeros(0, U)
        p = self.prefix(values)
        return mix((p[width:] - p[:-width]) * self.down[:n])


#: Independent bases: words by the first two, sequences of words by the others.
WORD, WORD2, SEQUENCE, SEQUENCE2 = (Rolling(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row, and the index of each row's first word (with the total at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = letters[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rolling: Rolling = WORD) -> np.ndarray:
    return rolling.spans(rolling.prefix(data.astype(U) + U(1)), starts, ends)


def fitting(offsets: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of the `total` starts have `width` units in their own row."""
    sizes = np.diff(offsets)
    return np.arange(total) + width <= np.repeat(offsets[1:], sizes) if total else np.zeros(0, bool)


def least(keys: np.ndarray, span: int) -> np.ndarray:
    """For each start with `span` keys from it, the place of the least, the leftmost on ties: content alone decides it.

    Keys are compared by all but their lowest bits, as many as `span` takes; so the order is one for texts of every length.
    """
    n = len(keys)
    if n < span:
        return np.zeros(0, np.int64)
    low = U((1 << max(span - 1, 1).bit_length()) - 1)
    padded = np.full(-(-n // span) * span, ~U(0), U)
    padded[:n] = (keys & ~low) | (np.arange(n, dtype=U) % U(span))
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[span - 1 : n]
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[: n - span + 1]
    start = np.arange(n - span + 1)
    left = (back & ~low) <= (ahead & ~low)
    block = np.where(left, start, start + span - 1) // span * span
    return block + (np.where(left, back, ahead) & low).astype(np.int64)
