"""Hamming self-joins by walking a binary trie against itself.

A node pair carries the bits that differ so far; each level gives the four child pairs, and a pair over the error
budget goes with all below it. The trie is a sorted array: a node is a range, its children meet where the next bit turns.
The top of the trie is cut into leaves of bounded size (`top`), the same walk over the top gives the leaf pairs that
can hold a match, and each leaf pair is one task's walk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantra.llm.common import frugal, ranges, released
from quantra.llm.texthash import U

BUCKET, FRONTIER, PAIRS, BLOCK = 16, 1 << 17, 1 << 20, 1 << 16


def walk(a: np.ndarray, b: np.ndarray | None, width: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys with at most `budget` differing bits. a, b: sorted distinct keys in the high `width` bits; b None: pairs within a."""
    alone = b is None
    b = a if alone else b
    if not len(a) or not len(b):
        return
    one = lambda x: np.array([x], np.int64)
    stack = [(0, one(0), one(len(a)), one(0), one(len(b)), one(0))]
    while stack:
        depth, al, ah, bl, bh, errors = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(depth, *(x[s] for x in (al, ah, bl, bh, errors))) for s in (slice(half), slice(half, None))]
            continue
        done = (ah - al) * (bh - bl) <= BUCKET if depth < width else np.ones(len(al), bool)
        if done.any():
            dal, dbl, na, nb = al[done], bl[done], (ah - al)[done], (bh - bl)[done]
            sizes, lo = na * nb, 0
            cut = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS, int(sizes.sum()) + PAIRS, PAIRS)) + 1
            for hi in np.unique(np.minimum(cut, len(sizes))):
                inside = ranges(np.zeros(hi - lo, np.int64), sizes[lo:hi])
                wide = np.repeat(nb[lo:hi], sizes[lo:hi])
                i, j = np.repeat(dal[lo:hi], sizes[lo:hi]) + inside // wide, np.repeat(dbl[lo:hi], sizes[lo:hi]) + inside % wide
                ok = np.bitwise_count(a[i] ^ b[j]) <= budget
                if alone:
                    ok &= i < j
                if ok.any():
                    yield i[ok], j[ok]
                lo = hi
        al, ah, bl, bh, errors = (x[~done] for x in (al, ah, bl, bh, errors))
        if not len(al):
            continue
        bit = U(1) << U(63 - depth)
        high = ~((bit << U(1)) - U(1)) if depth else U(0)
        am = np.clip(np.searchsorted(a, (a[al] & high) | bit), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] & high) | bit), bl, bh)
        twin = (al == bl) & (ah == bh) if alone else np.zeros(len(al), bool)
        children = []
        for (x0, x1), (y0, y1), cost in (((al, am), (bl, bm), 0), ((am, ah), (bm, bh), 0), ((al, am), (bm, bh), 1), ((am, ah), (bl, bm), 1)):
            ok = (x1 > x0) & (y1 > y0) & (errors + cost <= budget)
            if cost and x0 is am:
                ok &= ~twin  # the mirror image of the pair before
            children.append([x[ok] for x in (x0, x1, y0, y1, errors + cost)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*children))))


class Forest:
    """Union of links over 0..n-1, a block of links at a time; a label is the least member of its set."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            x, y = self.label[i], self.label[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        below = np.flatnonzero(self.label != np.arange(len(self.label)))
        return below, self.label[below]


def top(keys: DataFrame, width: int, leaf: int) -> list[tuple[int, int]]:
    """The trie's top: (prefix in the high bits, depth) of leaves with at most `leaf` keys each, in key order.

    keys: (seg int, key long), keys of all segs counted together. A level's counts go to the driver: 65,536 rows at
    most at first, then 16 for each of the nodes still too large, of which there are at most keys/leaf.
    """
    leaves, open_nodes, depth = [], None, 0
    while True:
        step = min(16 if open_nodes is None else 4, width - depth)
        prefix = F.shiftrightunsigned("key", 64 - depth - step)
        at = keys if open_nodes is None else keys.join(F.broadcast(keys.sparkSession.createDataFrame([(x,) for x in open_nodes], "node long")), F.shiftrightunsigned("key", 64 - depth) == F.col("node"), "left_semi")
        counts = {int(r[0]) & (1 << 64) - 1: r[1] for r in at.groupBy(prefix.alias("p")).count().toLocalIterator()}
        todo = [(x, depth) for x in ([0] if open_nodes is None else open_nodes)]
        sums = {depth + step: counts}
        for d in range(depth + step - 1, depth - 1, -1):
            sums[d] = {}
            for p, n in sums[d + 1].items():
                sums[d][p >> 1] = sums[d].get(p >> 1, 0) + n
        again = []
        while todo:
            p, d = todo.pop()
            if sums[d].get(p, 0) <= leaf or d == width:
                leaves.append((p << (64 - d) if d else 0, d))
            elif d == depth + step:
                again.append(p)
            else:
                todo += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        depth += step
        if not again:
            return sorted(leaves)
        open_nodes = again


def leaf_pairs(leaves: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """The walk over the top: leaf pairs (i <= j) whose known bits differ in at most `budget` places."""
    found = []
    starts = np.array([x for x, _ in leaves], U)

    def cut(lo: int, hi: int, depth: int) -> int:
        base = leaves[lo][0] >> (64 - depth) << (64 - depth)
        return int(np.searchsorted(starts[lo:hi], U(base | 1 << (63 - depth)))) + lo

    stack = [(0, len(leaves), 0, len(leaves), 0, 0)]
    while stack:
        al, ah, bl, bh, depth, errors = stack.pop()
        if ah - al == 1 and bh - bl == 1:
            found.append((al, bl)) if al <= bl else None
            continue
        sides = []
        for lo, hi in ((al, ah), (bl, bh)):
            if leaves[lo][1] <= depth:
                sides.append([(lo, hi, None)])
            else:
                m = cut(lo, hi, depth)
                sides.append([(lo, m, 0), (m, hi, 1)])
        for x0, x1, x in sides[0]:
            for y0, y1, y in sides[1]:
                e = errors + (x is not None and y is not None and x != y)
                if x1 > x0 and y1 > y0 and e <= budget and x0 <= y1 - 1:
                    stack.append((x0, x1, y0, y1, depth + 1, e))
    return sorted(set(found))


def links(items: DataFrame, width: int, budget: int, leaf: int, close: Callable[[np.ndarray, np.ndarray, int], np.ndarray] | None = None, payload: int = 0, every: bool = False) -> DataFrame:
    """Links (u, v) that join every two items whose keys of one seg differ in at most `budget` bits, as a forest in each task.

    items: (seg int, key long, id long, payload binary); the key is in the high `width` bits. close(x, y, seg), if given, gets the
    payloads (rows of `payload` 64-bit words) of such pairs and says which to link. every: not a forest, but each such pair (once for each seg, unless close drops it).
    """
    leaves = top(items.select("seg", "key"), width, leaf)
    pairs = leaf_pairs(leaves, budget)
    starts = np.array([x for x, _ in leaves], U)
    of_leaf: list[list[tuple[int, int]]] = [[] for _ in leaves]
    for k, (i, j) in enumerate(pairs):
        of_leaf[i].append((k, 0))
        if i != j:
            of_leaf[j].append((k, 1))
    shared = items.sparkSession.sparkContext.broadcast((starts, of_leaf))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, of_leaf = shared.value
        for batch in batches:
            seg, key, ids = (batch[k].to_numpy(zero_copy_only=False) for k in ("seg", "key", "id"))
            at = np.searchsorted(starts, key.view(U), side="right") - 1
            order = np.lexsort((at, seg))
            s, a = seg[order], at[order]
            heads = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (a[1:] != a[:-1])]) if len(s) else []
            rows = []
            for lo, hi in zip(heads, [*heads[1:], len(s)]):
                which = order[lo:hi]
                blob = (key[which].tobytes(), ids[which].tobytes(), b"".join(batch["payload"].take(pa.array(which)).to_pylist()) if payload else b"")
                rows += [(int(s[lo]), k, side, *blob) for k, side in of_leaf[a[lo]]]
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + 256]), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["seg", "pair", "side", "key", "id", "payload"])

    def join(table: pa.Table) -> pa.Table:
        sides, seg = [], table["seg"][0].as_py()
        for side in (0, 1):
            got = table.filter(pa.compute.equal(table["side"], side))
            whole = lambda k, t: np.frombuffer(b"".join(x.as_py() for x in got[k]), t)  # noqa: B023,E731
            key, ids, load = whole("key", U), whole("id", np.int64), whole("payload", U)
            order = np.argsort(key, kind="stable")
            distinct, first, counts = np.unique(key[order], return_index=True, return_counts=True)
            sides.append((distinct, first, counts, ids[order], load.reshape(len(key), payload)[order] if payload else None))
        within = not len(sides[1][3])
        a, b = sides[0], sides[0] if within else sides[1]
        n = len(a[3])
        forest = Forest(n if within else n + len(b[3]))

        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def check(i: np.ndarray, j: np.ndarray) -> None:
            if every:
                for lo in range(0, len(i), BLOCK):
                    x, y = i[lo : lo + BLOCK], j[lo : lo + BLOCK]
                    ok = x < y if within else np.ones(len(x), bool)
                    if close is not None:
                        ok[ok] = close(a[4][x[ok]], b[4][y[ok]], seg)
                    pairs.append((a[3][x[ok]], b[3][y[ok]]))
                return
            at = j if within else j + n
            apart = forest.label[i] != forest.label[at]  # what is one set already needs no look
            i, j, at = i[apart], j[apart], at[apart]
            if close is not None and len(i):
                ok = close(a[4][i], b[4][j], seg)
                i, at = i[ok], at[ok]
            if len(i):
                forest.add(i, at)

        def expand(x: np.ndarray, y: np.ndarray) -> None:
            sizes = a[2][x] * b[2][y]
            done = 0
            for lo in range(0, len(x), PAIRS):
                xs, ys, size = x[lo : lo + PAIRS], y[lo : lo + PAIRS], sizes[lo : lo + PAIRS]
                total = int(size.sum())
                ends = np.cumsum(size)
                for done in range(0, total, PAIRS):
                    k = np.arange(done, min(done + PAIRS, total))
                    g = np.searchsorted(ends, k, side="right")
                    inside, wide = k - (ends[g] - size[g]), b[2][ys[g]]
                    check(a[1][xs[g]] + inside // wide, b[1][ys[g]] + inside % wide)

        if within:
            same = np.flatnonzero(a[2] > 1)
            expand(same, same)
        for i, j in walk(a[0], None if within else b[0], width, budget):
            expand(i, j)
        if every:
            return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (zip(*pairs) if pairs else ((), ()))], ["u", "v"])
        ids = a[3] if within else np.concatenate([a[3], b[3]])
        below, root = forest.links()
        return pa.table([pa.array(ids[below]), pa.array(ids[root])], ["u", "v"])

    def joined(table: pa.Table) -> pa.Table:
        try:
            return join(table)
        finally:
            released()

    return items.select("seg", "key", "id", "payload").mapInArrow(frugal(deal), "seg int, pair int, side int, key binary, id binary, payload binary").groupBy("seg", "pair").applyInArrow(joined, "u long, v long")
