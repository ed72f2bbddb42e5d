"""The phrase automaton against plain search, alone and over tables."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from quantra.functions import phrases
from quantra.functions.phrases import Automaton, occurring, replaced


def test_finds_what_plain_search_finds(monkeypatch):
    r = random.Random(1)
    for lanes, piece in ((1 << 16, 1024), (7, 16)):
        monkeypatch.setattr(phrases, "LANES", lanes)
        monkeypatch.setattr(phrases, "PIECE", piece)
        for _ in range(30):
            given = [(n, "".join(r.choice("abc é日") for _ in range(r.randrange(5)))) for n in range(r.randrange(1, 40))]
            texts = ["".join(r.choice("abcdé日 ") for _ in range(r.choice([0, 1, 5, 15, 16, 17, 30, 1023, 1024, 1025, 2100]))) for _ in range(15)]
            row, number = Automaton(given).find(texts)
            assert list(zip(row.tolist(), number.tolist())) == [(i, n) for i, t in enumerate(texts) for n, p in given if p and p in t]
    assert [len(x) for x in Automaton([(0, "")]).find(["abc"])] == [0, 0] and [len(x) for x in Automaton([(0, "a")]).find([])] == [0, 0]


def test_many_phrases_cost_about_as_much_as_few():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 10))) for _ in range(5000)]
    texts = [" ".join(r.choice(words) for _ in range(12)) for _ in range(5000)]
    took = {}
    for n in (10, 10_000):
        automaton = Automaton([(k, " ".join(r.choice(words) for _ in range(2))) for k in range(n)])
        runs = []
        for _ in range(3):
            began = time.process_time()
            automaton.find(texts)
            runs.append(time.process_time() - began)
        took[n] = min(runs)
    assert took[10_000] < 4 * took[10] + 0.05


def test_tables_split_over_automata(spark, monkeypatch):
    table = spark.createDataFrame([(3, "tion", "x", None), (1, "fill", "y", 1.5), (2, "", "z", 2.0), (4, "fill", "w", 3.0), (5, "É", "v", None)], "ordinal int, phrase string, owner string, weight double")
    texts = spark.createDataFrame([(1, "a filled section"), (2, None), (3, ""), (4, "été"), (5, "fill" * 900)], "id int, text string").repartition(3)
    want = {1: [(1, "y", 1.5), (3, "x", None), (4, "w", 3.0)], 4: [(5, "v", None)], 5: [(1, "y", 1.5), (4, "w", 3.0)]}
    for cells in (1 << 24, 1):
        monkeypatch.setattr(phrases, "CELLS", cells)
        hits = texts.withColumn("hits", occurring(F.lower("text"), table, F.lower("phrase"), "ordinal"))
        got = {r.id: [(h.ordinal, h.owner, h.weight) for h in r.hits] for r in hits.where("size(hits) > 0").collect()}
        assert got == want
    assert texts.withColumn("hits", occurring(F.col("text"), table.limit(0), F.col("phrase"), "ordinal")).where("size(hits) = 0").count() == 5


def fold(text: str, table: list[tuple]) -> tuple[str, list]:
    hits = []
    for _, old, new, bias in sorted(table):
        if old and old in text:
            hits.append((old, bias))
            text = re.sub(rf"\b{re.escape(old)}\b", lambda _, to=new: to, text)
    return text, hits


def test_replacements_follow_each_other(spark):
    r = random.Random(3)
    words = ["a", "ab", "b", "bc", "a b", "c", "1.5", "", "ab c"]
    for seed in range(3):
        r.seed(seed)
        table = [(n, r.choice(words), r.choice(words), r.choice(["s", ""])) for n in range(8)]
        texts = [" ".join(r.choice(["a", "ab", "b", "abc", "1.5", "bc"]) for _ in range(r.randrange(6))) for _ in range(40)]
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        aliases = spark.createDataFrame(table, "ordinal int, alias string, term string, bias string").repartition(2)
        got = {x.id: (x.d.t, [(h.a, h.b) for h in x.d.h]) for x in rows.select("id", replaced(F.col("text"), aliases, F.col("alias"), F.col("term"), F.col("bias"), "ordinal").alias("d")).collect()}
        assert got == {n: fold(t, table) for n, t in enumerate(texts)}


def test_self_expansion(spark):
    aliases = spark.createDataFrame([(1, "tipper", "tipper lorry", "Dayworks"), (2, "lorry lorry", "lorry", "")], "ordinal int, alias string, term string, bias string")
    row = spark.createDataFrame([("tipper lorry",)], "text string").select(replaced(F.col("text"), aliases, F.col("alias"), F.col("term"), F.col("bias"), "ordinal").alias("d")).first()
    assert (row.d.t, [h.a for h in row.d.h]) == ("tipper lorry", ["tipper", "lorry lorry"])
