"""Quality rules: counts against plain Python, trees against a walk row by row, monotonic scores, held-out accuracy and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quantra.llm import quality
from quantra.llm.common import text_bytes
from quantra.llm.queries import QUERIES

ODD = [None, "", " \n\t ", "one", "one two", "a b c a b c", "x\ny\nx\nx\n\n \n \n", "x\r\nx\r\n", "ä ö ü\nä ö ü", "#*$%&|<> é#", "a " * 3000, "w " * 49, " ".join(f"w{i}" for i in range(50)), "tail\n", "\nhead", "é" * 4000, "a\x0bb\x0cc a b c", "same line here\n" * 40]


def brute(text: str | None) -> list[int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def failed(c: list[int]) -> bool:
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def prose(r: random.Random, good: bool, n: int = 120) -> str:
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(n)]
    if not good:
        kind = r.randrange(3)
        words = [w + r.choice(["###", "$$$", "%%%"]) for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else words[:10] + ["spam"] * n
    return " ".join(w + ("\n" if r.random() < 0.05 else "") for w in words)


def test_counts_match_plain_python():
    r = random.Random(1)
    texts = ODD + [prose(r, k % 2 == 0) for k in range(40)] + ["\n".join(r.choice(["a b", "c", "", " ", "a b "]) for _ in range(30)) for _ in range(20)]
    counts, x = quality.statistics(*text_bytes(pa.array(texts)))
    assert counts.tolist() == [brute(t) for t in texts]
    assert x.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(x).all()
    alone = [quality.statistics(*text_bytes(pa.array([t], pa.string()))) for t in texts]
    assert all(np.array_equal(a[0][0], c) and np.array_equal(a[1][0], v) for a, c, v in zip(alone, counts, x))


def sample(n: int = 600):
    r = np.random.default_rng(2)
    x = r.random((n, 4))
    y = ((x[:, 0] < 0.6) & (x[:, 1] + 0.1 * r.normal(size=n) > 0.3)).astype(float)
    return x, y


def walked(trees, row) -> float:
    out = trees.base
    for t in range(len(trees.feature)):
        at = 0
        while trees.left[t][at] != at:
            at = trees.left[t][at] if row[trees.feature[t][at]] <= trees.limit[t][at] else trees.right[t][at]
        out += trees.value[t][at]
    return out


def test_flat_trees_score_like_a_walk_and_learn():
    x, y = sample()
    trees = quality.boost(x[:400], y[:400], [0])
    assert np.allclose(trees.margin(x), [walked(trees, row) for row in x])
    assert ((trees.score(x[400:]) >= 0.5) == y[400:]).mean() > 0.93


@pytest.mark.parametrize("falling", [[0], [0, 1], [3]])
def test_scores_never_rise_with_falling_features(falling):
    x, y = sample()  # feature 1 raises the label, so a free fit would rise with it
    trees = quality.boost(x, y, falling)
    for j in falling:
        z = x[:200].copy()
        last = np.full(len(z), np.inf)
        for v in np.linspace(-0.1, 1.1, 60):
            z[:, j] = v
            now = trees.margin(z)
            assert (now <= last + 1e-12).all()
            last = now
    if 1 not in falling:
        assert np.corrcoef(trees.margin(x), x[:, 1])[0, 1] > 0.2


def test_degenerate_fits():
    assert quality.boost(np.zeros((0, 3)), np.zeros(0), []).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = quality.boost(np.ones((50, 3)), np.r_[np.zeros(10), np.ones(40)], [0])
    assert np.allclose(one.score(np.ones((1, 3))), 0.8, atol=0.02)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    return [(k, prose(r, k % 3 > 0), int(k % 3 > 0)) for k in range(400)]


SCHEMA = "doc_id long, text string, n_words string, score string, row_key string"


def test_whole_results_and_held_out_accuracy(spark, rows):
    table = [(i, t, "a", "b", "c") for i, t, _ in rows] + [(1000 + k, t, "a", "b", "c") for k, t in enumerate(ODD)] + [(None, rows[1][1], "a", "b", "c"), (7, rows[7][1], "a", "b", "c"), (7, "other", "a", "b", "c")]
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (99999, 1, 0), (1003, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge_quality(docs, labels, share=(1, 2, 3, 4)).collect()
    assert len(got) == len(table)
    plain = sorted((str(i), *brute(t), failed(brute(t))) for i, t, *_ in table)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == plain
    assert all(r.kept == (not r.base_failed and r.score >= 0.5) for r in got)
    trees = quality.fit_quality(docs, labels, share=(1, 2, 3, 4))
    _, x = quality.statistics(*text_bytes(pa.array([t for _, t, *_ in table])))
    want = sorted(round(1 / (1 + np.exp(-walked(trees, row))), 9) for row in x)
    assert np.allclose(sorted(r.score for r in got), want, atol=1e-6)
    import zlib

    held = {r.doc_id: r.kept for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id != 7}
    assert sum(held[i] == bool(q) for i, _, q in rows if i in held) / len(held) > 0.95


def test_without_labels_and_empty(spark, rows):
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t, _ in rows[:30]] + [(900, None, "", "", "")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge_quality(docs, labels).collect()
    assert all(r.score == 1.0 and r.kept == (not r.base_failed) for r in got) and len(got) == 31
    one_kind = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit_quality(docs, one_kind) is None
    assert quality.judge_quality(docs.limit(0), labels).count() == 0


def test_registered_query(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_quality_rules"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and sum(got[i].kept == bool(q) for i, _, q in rows) / len(rows) > 0.98
