"""String scores 0-100 (L01-L03) over the longest common subsequence, for distinct pairs.

ratio(a, b) = 200 lcs / (|a| + |b|), 100 for two empty texts. Pairs are scored in batches: a pair, or a pair and a window, is a lane of numpy arrays of 64-bit words, and
one step takes the next character of every lane. Sorting tokens and building the token sets are done in Spark on each side or pair. `lcs`, `ratio` and `partial` say
the same for one pair, in plain Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lanes of one step at most, so that a task's arrays are bounded however many pairs a batch has.
LANES = 1 << 16


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit vector a row (Hyyrö 2004)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def _growing(a: str, b: str) -> list[int]:
    """The longest common subsequence of a with each beginning of b, in one pass."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    out = [0]
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
        out.append(len(a) - row.bit_count())
    return out


def partial(a: str, b: str) -> float:
    """The shorter text against every window of its length of the longer, and against the shorter windows at the longer's ends; of texts of one length, each against the other's."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 100.0 if not b else 0.0
    best = 0.0
    for k in range(len(b) - n + 1):
        best = max(best, 100.0 * lcs(a, b[k : k + n]) / n)
        if best == 100.0:
            return best
    sides = [(a, b), (a[::-1], b[::-1])]
    if len(b) == n:
        sides += [(b, a), (b[::-1], a[::-1])]
    for x, y in sides:
        best = max(best, *(200.0 * common / (n + i) for i, common in enumerate(_growing(x, y[: n - 1]))))
    return best


class Texts:
    """Distinct texts as character codes (`kinds` of them), one after another, and where each starts; `places` are the bit masks of a text's characters, a word for 64 of them."""

    def __init__(self, texts: list[str]) -> None:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.length) - self.length
        seen = np.zeros(int(points.max(initial=0)) + 1, bool)
        seen[points] = True
        self.kinds = max(1, int(seen.sum()))
        self.flat = (np.cumsum(seen) - 1)[points]
        back = np.repeat(2 * self.start + self.length - 1, self.length) - np.arange(len(points))
        self.backward = self.flat[back]
        self._places: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, a: np.ndarray, reverse: bool = False) -> np.ndarray:
        """places[word][text * kinds + character], made for the texts in a and those asked for before."""
        if reverse not in self._places:
            self._places[reverse] = np.zeros((-(-int(self.length.max(initial=1)) // 64), len(self.length) * self.kinds), np.uint64), np.zeros(len(self.length), bool)
        out, made = self._places[reverse]
        wanted = np.zeros(len(made), bool)
        wanted[a] = True
        new = np.flatnonzero(wanted & ~made)
        new = new[np.argsort(-self.length[new], kind="stable")]
        made[new] = True
        flat, length = self.backward if reverse else self.flat, -self.length[new]
        for k in range(int(-length.min(initial=0))):
            own = new[: np.searchsorted(length, -k, side="left")]
            out[k // 64][own * self.kinds + flat[self.start[own] + k]] |= np.uint64(1 << k % 64)
        return out

    def common(self, a: np.ndarray, start: np.ndarray, length: np.ndarray, reverse: bool = False, growing: bool = False) -> np.ndarray:
        """For each lane the longest common subsequence of text a with `length` codes from `start` on (of the texts written backward if reverse). growing: instead the best ratio of the whole text a with any beginning of these."""
        out = np.zeros(len(a), np.float64 if growing else np.int64)
        size = self.length[a]
        for words in np.unique((size + 63) // 64):  # texts of as many words together
            own = np.flatnonzero((size + 63) // 64 == words)
            if not words:
                continue
            for lo in range(0, len(own), LANES):
                part = own[lo : lo + LANES]
                part = part[np.argsort(-length[part], kind="stable")]  # lanes that are done are at the end
                out[part] = self._lanes(int(words), a[part], start[part], length[part], reverse, growing)
        return out

    def _lanes(self, words: int, a: np.ndarray, start: np.ndarray, length: np.ndarray, reverse: bool, growing: bool) -> np.ndarray:
        flat, places, base = self.backward if reverse else self.flat, self.places(a, reverse), a * self.kinds
        size = self.length[a]
        rows = [np.full(len(a), ~np.uint64(0)) for _ in range(words)]
        used = [np.where(size >= 64 * (w + 1), ~np.uint64(0), (np.uint64(1) << np.clip(size - 64 * w, 0, 63).astype(np.uint64)) - np.uint64(1)) for w in range(words)]
        best = np.zeros(len(a))
        live = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")  # lanes with at least so many codes
        for k, n in enumerate(live.tolist()):
            at, carry = base[:n] + flat[start[:n] + k], None
            for w in range(words):
                row = rows[w][:n]
                hit = row & places[w][at]
                total = row + hit
                if w + 1 < words or carry is not None:
                    over = total < row
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                rows[w][:n] = total | (row - hit)
            if growing:
                same = size[:n] - sum(np.bitwise_count(rows[w][:n] & used[w][:n]).astype(np.int64) for w in range(words))
                np.maximum(best[:n], 200.0 * same / (size[:n] + k + 1), out=best[:n])
        return best if growing else size - sum(np.bitwise_count(r & u).astype(np.int64) for r, u in zip(rows, used))


def _distinct(a, b) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct texts of both sides, and each side's places among them."""
    codes, texts = pd.factorize(np.concatenate([np.asarray(a, object), np.asarray(b, object)]))
    return texts.tolist(), codes[: len(a)], codes[len(a) :]


def ratios(a, b) -> np.ndarray:
    """ratio of every pair of two lists."""
    texts, left, right = _distinct(a, b)
    return ratios_of(Texts(texts), left, right)


def ratios_of(table: Texts, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    swap = table.length[left] > table.length[right]
    short, long = np.where(swap, right, left), np.where(swap, left, right)
    total = table.length[left] + table.length[right]
    same = np.where(left == right, table.length[left], -1)
    open_pairs = np.flatnonzero(same < 0)
    same[open_pairs] = table.common(short[open_pairs], table.start[long[open_pairs]], table.length[long[open_pairs]])
    return np.where(total > 0, 200.0 * same / np.maximum(total, 1), 100.0)


def partials(a, b) -> np.ndarray:
    """partial of every pair of two lists. A pair whose shorter text lies in the longer one is done with that; the others take a lane for each window."""
    texts, left, right = _distinct(a, b)
    table = Texts(texts)
    swap = table.length[left] > table.length[right]
    short, long = np.where(swap, right, left), np.where(swap, left, right)
    n, m = table.length[short], table.length[long]
    out = np.where(n == 0, np.where(m == 0, 100.0, 0.0), 0.0)
    inside = np.fromiter((texts[x] in texts[y] for x, y in zip(short.tolist(), long.tolist())), bool, len(short))
    out[inside & (n > 0)] = 100.0
    at = np.flatnonzero(~inside & (n > 0))
    for lo in range(0, len(at), LANES >> 4):
        i = at[lo : lo + (LANES >> 4)]
        count = m[i] - n[i] + 1
        lane = np.repeat(np.arange(len(i)), count)
        shift = np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)
        same = table.common(short[i][lane], table.start[long[i]][lane] + shift, n[i][lane])
        best = 100.0 * np.maximum.reduceat(same, np.cumsum(count) - count) / n[i]
        sides = [(short[i], long[i], np.arange(len(i)))]
        if (even := np.flatnonzero(n[i] == m[i])).size:
            sides.append((long[i][even], short[i][even], even))
        for x, y, to in sides:
            for reverse in (False, True):
                np.maximum.at(best, to, table.common(x, table.start[y], np.minimum(n[i][to] - 1, table.length[y]), reverse, True))
        out[i] = best
    return out


@F.pandas_udf(T.DoubleType())
def ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a, b))


@F.pandas_udf(T.DoubleType())
def partial_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(partials(a, b))


def _tokens(x: Column) -> Column:
    return F.filter(F.split(x, " +"), lambda w: w != "")


def token_sort(a: Column, b: Column) -> Column:
    """The ratio of the texts with their words sorted."""
    return ratio_of(F.array_join(F.array_sort(_tokens(a)), " "), F.array_join(F.array_sort(_tokens(b)), " "))


def token_set(a: Column, b: Column) -> Column:
    """0 if a side has no words, 100 if one side's words are among the other's, else the best ratio of shared words, shared and a's own, shared and b's own."""
    ta, tb = F.array_distinct(_tokens(a)), F.array_distinct(_tokens(b))
    both = F.array_sort(F.array_intersect(ta, tb))
    one, other = F.array_sort(F.array_except(ta, tb)), F.array_sort(F.array_except(tb, ta))
    s, sa, sb = F.array_join(both, " "), F.array_join(F.concat(both, one), " "), F.array_join(F.concat(both, other), " ")
    best = F.greatest(F.when(F.size(both) > 0, F.greatest(ratio_of(s, sa), ratio_of(s, sb))).otherwise(F.lit(0.0)), ratio_of(sa, sb))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).when((F.size(both) > 0) & ((F.size(one) == 0) | (F.size(other) == 0)), F.lit(100.0)).otherwise(best)
