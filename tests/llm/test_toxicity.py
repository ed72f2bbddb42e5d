"""Toxicity features and scores against plain Python over whole numbers and sets."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa

from quantra.llm import toxicity
from quantra.llm.common import text_bytes

ALL = (1 << 64) - 1


def mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


def hashed(word: bytes) -> int:
    return mix(sum((b + 1) * pow(toxicity.WORD.base, k, 1 << 64) for k, b in enumerate(word)) & ALL)


def places(text: str | None) -> set[int]:
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    h = [hashed(w) for w in words]
    keys = set(h)
    for size, salt in toxicity.STEMS.items():
        keys |= {mix(hashed(w[:size]) * int(salt) & ALL) for w in words if len(w) > size}
    for gap, salt in ((1, toxicity.PAIR), (2, toxicity.SKIP)):
        keys |= {mix((a * int(salt) + b) & ALL) for a, b in zip(h, h[gap:])}
    return {k >> (64 - toxicity.BITS) for k in keys}


TEXTS = [None, "", " ", "one", "Two words", "a b a b a", "été ÉTÉ Straße longerwords", "x" * 40, "mixed-UP, punctuation; and_under scores 12 3a", "日本 語 text", "word " * 400]


def test_features_match_plain_python():
    at, n = toxicity.features(*text_bytes(pa.array(TEXTS)))
    cut = np.cumsum(n)
    assert [set(at[b - k : b].tolist()) for b, k in zip(cut, n)] == [places(t) for t in TEXTS]


def test_whole_scores_match_plain_python(spark):
    r = random.Random(3)
    words = [f"plain{k}" for k in range(60)]
    rows = []
    for k in range(300):
        text = [r.choice(words) for _ in range(20)]
        if k % 4 == 0:
            text[r.randrange(20)] = r.choice(["nasty", "vileness"])
        rows.append((k, " ".join(text), int(k % 4 == 0)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(None, "nasty")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    at, w = toxicity.fit_toxicity(docs, labels)
    weight = dict(zip(at.tolist(), w.tolist()))
    got = sorted((str(x.doc_id), x.score, x.predicted) for x in toxicity.score_toxicity(docs, labels).collect())
    margin = lambda t: weight.get(toxicity.BIAS, 0.0) + sum(weight.get(p, 0.0) for p in places(t))
    want = sorted((str(k), 1 / (1 + math.exp(-margin(t)))) for k, t in [(k, t) for k, t, _ in rows] + [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(None, "nasty")])
    assert [g[0] for g in got] == [x[0] for x in want] and np.allclose([g[1] for g in got], [x[1] for x in want], atol=1e-9)
    assert all(p == int(s >= 0.5) for _, s, p in got) and sum(p for _, _, p in got) > 60
