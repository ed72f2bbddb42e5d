"""Exact integer matrix products in float32 through a residue number system.

A product of integer matrices is taken modulo several small primes. Residues are balanced (at most half a prime either way) and the
primes so small that a sum over BLOCK components stays under 2**24, where float32 holds every integer; so each of
the products is one exact float32 GEMM. The signed values come back by Chinese remaindering (mixed radix digits, balanced too).
"""

from __future__ import annotations

import math

import numpy as np

#: Components of one float32 product; longer vectors take several, reduced in between.
BLOCK = 256
#: Values that a long holds with room for the last digit.
MOST = 1 << 61


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    """x (whole numbers in float32, under 2**24) to its balanced residue, in place."""
    x -= np.float32(p) * np.rint(x * np.float32(1 / p))
    return x


class Residues:
    """Primes for products of vectors of `dim` whole components whose values are at most `bound` either way."""

    def __init__(self, dim: int, bound: int) -> None:
        if bound > MOST:
            raise ValueError("scores do not fit a long")
        most = 2 * math.isqrt(((1 << 24) - 1) // max(1, min(dim, BLOCK))) + 1
        most = min(most, 4093)  # two residues multiply within 2**24 in the digits as well
        self.primes: list[int] = []
        at, product = most, 1
        # Four times the bound: the last digit of a value is never near half a prime, where rounding could choose either side.
        while product <= 4 * bound + 4:
            while any(at % k == 0 for k in range(2, math.isqrt(at) + 1)):
                at -= 1
            self.primes.append(at)
            product *= at
            at -= 1

    def of(self, x: np.ndarray) -> list[np.ndarray]:
        """The balanced residues of x (rows x dim, int64), one float32 matrix a prime."""
        out = []
        for p in self.primes:
            r = x % p
            out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        return out

    def _products(self, a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
        total = None
        for lo in range(0, a.shape[1], BLOCK):
            part = _reduced(a[:, lo : lo + BLOCK] @ b[:, lo : lo + BLOCK].T, p)
            total = part if total is None else _reduced(total + part, p)
        return total

    def scores(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """The exact inner products (int64) of every row of a with every row of b, both given by their residues."""
        digits: list[np.ndarray] = []
        for i, p in enumerate(self.primes):
            t = self._products(a[i], b[i], p)
            for q, digit in zip(self.primes, digits):
                inverse = pow(q, -1, p)
                t = _reduced((t - digit) * np.float32(inverse - p if inverse > p // 2 else inverse), p)
            digits.append(t)
        value, weight = digits[0].astype(np.int64), 1
        for p, digit in zip(self.primes, digits[1:]):
            weight *= p
            value += digit.astype(np.int64) * weight
        return value
