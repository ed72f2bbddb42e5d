"""Batched string scores and the text index against plain versions."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantra.functions import scores
from quantra.operators import matching, textindex
from quantra.operators.textindex import Costs, Index, set_scores

COSTS = Costs(8, 4, 6, 22.5, 5, 65)


def test_batches_score_like_single_pairs():
    r = random.Random(1)
    sizes = [0, 1, 2, 5, 10, 30, 63, 64, 65, 100, 128, 130, 200]
    make = lambda: "".join(r.choice("abcde é") for _ in range(r.choice(sizes)))
    a, b = [make() for _ in range(1500)] + ["", "", "日本 語"], [make() for _ in range(1500)] + ["", "x", "日本"]
    assert scores.ratios(a, b).tolist() == [scores.ratio(x, y) for x, y in zip(a, b)]
    assert scores.partials(a, b).tolist() == [scores.partial(x, y) for x, y in zip(a, b)]
    assert len(scores.ratios([], [])) == len(scores.partials([], [])) == 0


def test_lanes_in_small_steps(monkeypatch):
    monkeypatch.setattr(scores, "LANES", 48)
    r = random.Random(2)
    a, b = (["".join(r.choice("abc") for _ in range(r.randrange(40))) for _ in range(200)] for _ in "xy")
    assert scores.ratios(a, b).tolist() == [scores.ratio(x, y) for x, y in zip(a, b)]
    assert scores.partials(a, b).tolist() == [scores.partial(x, y) for x, y in zip(a, b)]


def plain_set(a: str, b: str) -> float:
    one, other = sorted(set(a.split())), sorted(set(b.split()))
    if not one or not other:
        return 0.0
    both = [w for w in one if w in other]
    x, y = [w for w in one if w not in both], [w for w in other if w not in both]
    if both and not (x and y):
        return 100.0
    s, sa, sb = (" ".join(v) for v in (both, both + x, both + y))
    return max(scores.ratio(sa, sb), *((scores.ratio(s, sa), scores.ratio(s, sb)) if both else (0.0,)))


def whole(q: str, t: str) -> float:
    return scores.ratio(" ".join(sorted(q.split())), " ".join(sorted(t.split()))) * 0.45 + scores.partial(q, t) * 0.20 + plain_set(q, t) * 0.35


def test_set_scores():
    r = random.Random(3)
    make = lambda: " ".join(r.choice(["ab", "abc", "b", "cd", "a"]) for _ in range(r.randrange(5)))
    a, b = [make() for _ in range(500)], [make() for _ in range(500)]
    assert set_scores([sorted(set(x.split())) for x in a], [sorted(set(x.split())) for x in b]).tolist() == [plain_set(x, y) for x, y in zip(a, b)]


def tables(seed: int, n_texts: int, n_keys: int):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(max(60, n_texts // 5))]
    text = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 6)))
    texts = sorted({text() for _ in range(n_texts)})

    def near(t: str) -> str:
        words, kind = t.split(), r.randrange(4)
        if kind == 0:
            r.shuffle(words)
        elif kind == 1:
            words[r.randrange(len(words))] = r.choice(vocabulary)[:-1]
        elif kind == 2:
            words += [words[0], r.choice(vocabulary)]
        return " ".join(words) if kind < 3 else text()

    rows = [(t, r.choice(["a", "b", ""]), r.choice(["n", "s"]), r.choice(["m2", "nr", ""]), float(r.randrange(7))) for t in texts for _ in range(r.choice([1, 1, 1, 6]))]
    keys = pd.DataFrame({"query": ["", "zzz qqq"] + [near(r.choice(texts)) for _ in range(n_keys)]})
    for name, values in (("section", ["a", "b", "c", ""]), ("region", ["n", "s", "x", ""]), ("unit", ["m2", "nr", "day", ""]), ("more", [0.0, 5.0, 15.0])):
        keys[name] = [r.choice(values) for _ in range(len(keys))]
    hints = defaultdict(list)
    for t, *_, hint in rows:
        hints[t].append(hint)
    return rows, {t: sorted(x)[-4] if len(x) > 3 else None for t, x in hints.items()}, keys


@pytest.mark.parametrize(("seed", "cells"), [(1, 1 << 20), (2, 700), (3, 5000)])
def test_the_index_finds_all_that_counts(seed, cells, monkeypatch):
    monkeypatch.setattr(textindex, "CELLS", cells)
    rows, fourth, keys = tables(seed, 150, 60)
    index = Index(rows, fourth, COSTS)
    found = index.reach(keys)
    for at, key in keys.iterrows():
        score = {t: whole(key["query"], t) for t in {x[0] for x in rows}}
        totals = []
        for n, (t, section, region, unit, hint) in enumerate(rows):
            plus = (8 if section and section == key.section else 0) + (4 if region and region == key.region else 0) + hint
            plus += (6 if unit == key.unit else -22.5) if unit and key.unit else 0
            totals.append((-(score[t] + plus), n, t))
        totals.sort()
        needed = {totals[0][2]} | {t for s, _, t in totals[1:4] if key.more - s >= 65}
        got = found.loc[[at]] if at in found.index else found.iloc[:0]
        assert needed <= set(got.item_text)
        for x in got.itertuples():
            assert x.sort_score * 0.45 + x.partial_score * 0.20 + x.set_score * 0.35 == pytest.approx(score[x.item_text], abs=1e-9)


def test_few_pairs_are_scored_where_texts_differ():
    rows, fourth, keys = tables(5, 20_000, 150)
    index = Index(rows, fourth, COSTS)
    assert len(index.reach(keys)) and len({r[0] for r in rows}) > 18_000
    assert index.bounded > 2_500_000 and index.scored < index.bounded / 10


def test_best_matches_without_a_product(spark, monkeypatch):
    """Two thousand texts in three blocks, against every item for every line; and no product of tables in the plan."""
    monkeypatch.setattr(textindex, "BLOCK_TEXTS", 400)
    rows, _, keys = tables(7, 1000, 40)
    items = [(n, f"I{n}", t, s, u, 10, g, "", h, True) for n, (t, s, g, u, h) in enumerate(rows)]
    lib = spark.createDataFrame(items, "ordinal int, item_code string, description string, section string, unit string, rate int, region string, basis string, confidence_hint double, active boolean")
    lines = spark.createDataFrame([(n, "s", n, k.query, k.unit, k.section, k.region) for n, k in enumerate(keys.itertuples())], "boq_id int, sheet_name string, row_number int, query string, unit string, inferred_section string, region string")
    best = matching.best_matches(lines.withColumn("alias_hits", F.array().cast("array<struct<a:string,b:string>>")), lib)
    plan = best._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = {x.boq_id: x for x in best.collect()}
    for n, key in keys.iterrows():
        ranked = []
        for k, (t, section, region, unit, hint) in enumerate(rows):
            plus = (8 if section and section == key.section else 0) + (4 if region and region == key.region else 0)
            plus += (6 if unit == key.unit else -22.5) if unit and key.unit else 0
            ranked.append((-round(whole(key["query"], t) + plus + hint, 9), k))
        ranked.sort()
        assert got[n].raw_score == pytest.approx(-ranked[0][0]) and got[n].matched_item_code == f"I{ranked[0][1]}"
        assert [a.split(" | ")[0] for a in got[n].alternates] == [f"I{k}" for s, k in ranked[1:4] if -s >= 65]


def test_an_empty_library(spark):
    lib = spark.createDataFrame([], "ordinal int, item_code string, description string, section string, unit string, rate int, region string, basis string, confidence_hint double, active boolean")
    lines = spark.createDataFrame([(1, "s", 1, "red ring", "m2", "", "")], "boq_id int, sheet_name string, row_number int, query string, unit string, inferred_section string, region string")
    (got,) = matching.best_matches(lines.withColumn("alias_hits", F.array().cast("array<struct<a:string,b:string>>")), lib).collect()
    assert got.decision == "unmatched" and got.matched_item_code is None


def test_a_text_scores_all_windows_of_longer_keys_at_once():
    r = random.Random(7)
    for size in (1, 2, 5, 16, 17, 32, 33, 64):
        text = "".join(r.choice("abc d") for _ in range(size))
        keys = ["".join(r.choice("abcx d") for _ in range(size + r.randint(1, 40))) for _ in range(20)]
        alphabet = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        points = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
        codes = np.array([alphabet.tolist().index(p) if p in alphabet else len(alphabet) for p in points.tolist()])
        sizes = np.array([len(k) for k in keys])
        assert textindex._dense_partials(text, alphabet, codes, np.cumsum(sizes) - sizes, sizes) == pytest.approx([scores.partial(text, k) for k in keys])


@pytest.mark.parametrize(("windows", "few"), [(1 << 18, 1 << 10), (300, 1 << 10), (1 << 18, 0)])
def test_long_keys_are_scored_against_few_texts(windows, few, monkeypatch):
    monkeypatch.setattr(textindex, "WINDOWS", windows)
    monkeypatch.setattr(textindex, "FEW", few)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeghilmnoprst") for _ in range(r.randint(3, 7)))
    texts = sorted({f"{word()} {word()}" for _ in range(64)})
    queries = [" ".join(word() for _ in range(30)) for _ in range(40)]
    index = Index([(t, "", "", "", 0.0) for t in texts], {}, COSTS)
    keys = pd.DataFrame({"query": queries, "section": "", "region": "", "unit": "", "more": 0.0})
    got = index.reach(keys).groupby("query")["item_text"].agg(set)
    for q in queries:
        assert max(texts, key=lambda t: whole(q, t)) in got[q]
    assert index.scored <= len(queries) * 24  # of 64; all of them without the windows


def test_matches_go_by_the_number_of_a_key(spark):
    """Queries may be whole document lines: what is ranked and grouped carries a key's number, not its text."""
    lib = spark.createDataFrame([(1, "I1", "red ring", "A", "m2", 10, "", "", 0.0, True)], "ordinal int, item_code string, description string, section string, unit string, rate int, region string, basis string, confidence_hint double, active boolean")
    lines = spark.createDataFrame([(n, "s", n, q, "m2", "", "") for n, q in enumerate(("red ring", "red rings", "red ring"))], "boq_id int, sheet_name string, row_number int, query string, unit string, inferred_section string, region string")
    best = matching.best_matches(lines.withColumn("alias_hits", F.array().cast("array<struct<a:string,b:string>>")), lib)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(key_id" in plan and "windowspecdefinition(query" not in plan
    assert [(r.boq_id, r.matched_item_code, r.decision) for r in best.orderBy("boq_id").collect()] == [(0, "I1", "matched"), (1, "I1", "matched"), (2, "I1", "matched")]
