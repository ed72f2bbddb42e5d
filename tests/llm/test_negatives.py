"""Hard negatives and residue arithmetic against plain Python integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quantra.llm import negatives
from quantra.llm.residues import Residues


@pytest.mark.parametrize(("dim", "most"), [(64, 256), (1, 10**9), (700, 5000), (3, 2**29), (64, 2**27), (5, 0)])
def test_products_are_exact(dim, most):
    r = np.random.default_rng(dim)
    a, b = r.integers(-most, most + 1, (30, dim)), r.integers(-most, most + 1, (40, dim))
    system = Residues(dim, max(int((x.astype(object) ** 2).sum(axis=1).max()) for x in (a, b)))
    assert (system.scores(system.of(a), system.of(b)) == a.astype(object) @ b.astype(object).T).all()


def test_products_at_the_bound():
    a = np.array([[127] * 16, [-127] * 16])
    system = Residues(16, 127 * 127 * 16)
    assert system.scores(system.of(a), system.of(a)).tolist() == [[258064, -258064], [-258064, 258064]]
    with pytest.raises(ValueError):
        Residues(4, 1 << 62)


def brute(rows, is_anchor, positives=5, k=10):
    kept = list({(i, lb, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, lb, v in rows if i is not None and lb is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for a, la, va in (x for x in kept if is_anchor(x[0])):
        scored = sorted({(-sum(x * y for x, y in zip(va, v)), i, lb == la) for i, lb, v in kept if len(v) == len(va)})
        for s, p in [(-s, i) for s, i, same in scored if same and i != a][:positives]:
            window = [(-n, i) for n, i, same in scored if not same and 30 * s <= -100 * n <= 90 * s][:k]
            out += [(a, p, r + 1, i, s, n) for r, (n, i) in enumerate(window)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, lb, v, "x", "y") for i, lb, v in rows], "vec_id long, label int, embedding array<float>, slot string, score string").repartition(3)


def same(got, want):
    assert sorted(map(tuple, got)) == sorted(want)


def test_matches_brute_force_with_odd_rows(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(3, 8))
    rows = [(i, int(i % 3), (centre[i % 3] * 0.5 + r.normal(size=8)).astype("float32").tolist()) for i in range(300)]
    rows += [(400 + i, 1, [0.5] * 8) for i in range(40)] + [(500 + i, 2, [0.25] * 8) for i in range(40)]  # ties
    rows += [(600, 1, None), (601, 1, []), (602, None, [0.1] * 8), (None, 1, [0.1] * 8), (700, 0, [None] + [0.1] * 7), (800, 0, [float("nan")] + [0.1] * 7), (900, 0, [float("inf")] * 8)]
    rows += [rows[0], rows[100], rows[5], (1000, 1, [0.5] * 8), (1100, 2, [0.5, 0.5]), (1101, 2, [0.5, 0.25]), (1102, 0, [0.25, 0.25]), (1200, 9, [1.0] * 8)]
    df = table(spark, rows)
    got = negatives.hard_negatives(df, df.where("vec_id % 100 = 0")).collect()
    want = brute(rows, lambda i: i % 100 == 0)
    assert len(want) > 100
    same(got, want)


def test_blocks_and_small_tiles(spark, monkeypatch):
    for name in ("ANCHOR_BLOCK", "ROWS", "ANCHORS"):
        monkeypatch.setattr(negatives, name, 7)
    r = np.random.default_rng(6)
    rows = [(i, int(i % 4), r.normal(size=5).astype("float32").tolist()) for i in range(120)]
    df = table(spark, rows)
    same(negatives.hard_negatives(df, df.where("vec_id % 5 = 0"), positives=3, k=4).collect(), brute(rows, lambda i: i % 5 == 0, 3, 4))


def test_empty_tables_and_lone_anchors(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0])]
    df = table(spark, rows)
    assert negatives.hard_negatives(df.limit(0), df.limit(0)).count() == 0
    assert negatives.hard_negatives(df, df).count() == 0  # no other row of an anchor's label
