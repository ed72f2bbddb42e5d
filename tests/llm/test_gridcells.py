"""Vector codes against plain rounds of assignment and averaging."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from quantra.llm import gridcells
from quantra.llm.gridcells import Cells, encode_vectors


def test_cells_find_the_nearest_entry_and_prune(monkeypatch):
    r = np.random.default_rng(1)
    book = r.integers(-400, 400, (64, 6))
    x = np.concatenate([r.integers(-500, 500, (3000, 6)), np.repeat(r.integers(-90, 90, (5, 6)), 300, axis=0), [[10**6] * 6, [-(10**6)] * 6]])
    want = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    for width in (1, 25, 10**7):
        cells = Cells(book, width)
        code, error = cells.nearest(x)
        assert (code == want.argmin(axis=1)).all() and (error == want.min(axis=1)).all()
        if width == 25:
            assert cells.exact < len(x) * len(book) / 4 and cells.bounded < 3050
            before = cells.bounded
            cells.nearest(x)
            assert cells.bounded == before  # every cell was remembered
    monkeypatch.setattr(gridcells, "CACHE", 1000)
    cells = Cells(book, 25)
    for lo in range(0, len(x), 500):
        code, error = cells.nearest(x[lo : lo + 500])
        assert (code == want[lo : lo + 500].argmin(axis=1)).all() and len(cells.keys) <= 1000


def test_cells_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(gridcells, "mix", lambda keys: keys % np.uint64(3))
    r = np.random.default_rng(2)
    book, x = r.integers(-50, 50, (16, 3)), r.integers(-60, 60, (200, 3))
    want = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    cells = Cells(book, 4)
    for _ in range(2):
        code, error = cells.nearest(x)
        assert (code == want.argmin(axis=1)).all() and (error == want.min(axis=1)).all()


def test_ties_go_to_the_first_entry():
    cells = Cells(np.array([[4, 0], [0, 0], [0, 0], [2, 2]]), 3)
    code, error = cells.nearest(np.array([[0, 0], [2, 0], [4, 4]]))
    assert code.tolist() == [1, 0, 3] and error.tolist() == [0, 4, 8]


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lb, [math.floor(1024 * float(np.float32(x))) for x in v], v) for i, lb, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[3]]))
    out, labels = [], {}
    for dim in {len(r[2]) for r in kept}:
        own = [r for r in kept if len(r[2]) == dim]
        size, more = divmod(dim, parts)
        ends = [sum(size + (q < more) for q in range(p + 1)) for p in range(parts)]
        cut = lambda v: [v[a:b] for a, b in zip([0, *ends], ends)]
        split = [cut(r[2]) for r in own]
        books = [[list(s[p]) for s in split[:entries]] for p in range(parts)]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
        for _ in range(rounds):
            for p in range(parts):
                got = {}
                for s in split:
                    got.setdefault(near(s[p], books[p])[1], []).append(s[p])
                for k, members in got.items():
                    books[p][k] = [sum(c) // len(members) for c in zip(*members)]
        sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
        for r, s in zip(own, split):
            best = [near(x, b) for x, b in zip(s, books)]
            error = sum(d for d, _ in best)
            labels[r[1]] = labels.get(r[1], 0) + error
            out.append((r[0], r[1], "".join(f"{k:02x}" for _, k in best), error, sha))
    return [(i, code, error, labels[lb], sha) for i, lb, code, error, sha in out]


def table(spark, rows):
    return spark.createDataFrame([(i, lb, v, "x", 1) for i, lb, v in rows], "vec_id long, label int, embedding array<float>, code string, error long").repartition(3)


def same(got, want):
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_matches_plain_rounds_with_odd_rows(spark):
    r = np.random.default_rng(3)
    vector = lambda n: (r.normal(size=n) * 0.2).astype("float32").tolist()
    rows = [(int(i), None if i % 9 == 0 else int(i % 4), vector(8)) for i in r.permutation(400) - 50]
    rows += [(500, 1, None), (501, 1, [None] + [0.1] * 7), (502, 2, [float("nan")] * 8), (None, 3, vector(8)), (None, None, vector(8))]
    rows += [rows[0], rows[0], (rows[1][0], 2, vector(8)), (600, 7, [0.5] * 8), (601, 7, [0.5] * 8), (700, 1, vector(6)), (701, 1, vector(6)), (702, 8, []), (703, 8, [0.1])]
    same(encode_vectors(table(spark, rows)).collect(), brute(rows))


def test_few_entries_more_rounds_and_hot_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, 0, (r.normal(size=4) * 0.3).astype("float32").tolist()) for i in range(100)] + [(200 + i, 1, [0.25, 0.5, 0.5, 0.25]) for i in range(80)]
    same(encode_vectors(table(spark, rows), parts=2, entries=5, rounds=6).collect(), brute(rows, 2, 5, 6))


def test_empty_tables_and_bounds(spark):
    none = table(spark, [(1, 1, None)])
    assert encode_vectors(none).count() == 0 and encode_vectors(none.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        encode_vectors(table(spark, [(1, 1, [1e9, 1.0])]))
    with pytest.raises(ValueError):
        encode_vectors(none, entries=257)
