"""The pipeline's stages on a small corpus with planted toxic rows, copies and a benchmark passage."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(4)
    say = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    rows = [(i, say(60), "en", f"s{i % 3}", 0) for i in range(300)]
    toxic = {i for i in range(0, 300, 5)}
    rows = [(i, f"vile {t} nasty awful" if i in toxic else t, a, b, c) for i, t, a, b, c in rows]
    item = say(30)
    rows += [(1000, rows[1][1], "en", "s0", 0), (1001, rows[2][1] + " tail", "en", "s1", 0), (1002, f"{say(10)} {item}", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, left, str(tmp_path)).write.parquet(str(tmp_path / f"stage-{k}"))
        left = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        seen.append((name, left.columns, sorted(x.doc_id for x in left.collect())))
    ids = [set(x[2]) for x in seen]
    clean = {x[0] for x in rows} - toxic
    assert all(x[1] == docs.columns for x in seen[:-1]) and len(ids[0] & toxic) <= 3 and clean <= ids[0]
    assert ids[1] == ids[0] - {1000, 1001} and ids[2] == ids[1] - {1002}
    assert ids[3] <= ids[2] and seen[3][2] == seen[4][2] and len(seen[3][2]) > len(ids[3])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {x[0]: x[1] for x in rows}
    assert all(x.n_tokens == len(tokenizer.encode(texts[x.doc_id]).ids) + 1 for x in left.collect())
    again = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert again == sorted(map(tuple, left.collect()))


def test_odd_rows_pass_all_stages(spark, tmp_path):
    r = random.Random(6)
    say = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    rows = [(i, say(40), "s", "x", "y", 1.0) for i in range(30)] + [(100, None, "s", None, None, None), (101, "", None, "x", "y", 1.0), (None, say(30), "s", "x", "y", 1.0), (102, say(60_000), "s", "x", "y", 1.0)]
    rows += [rows[0], rows[0], (103, "one", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row_key string, fp string, score double")
    none = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, columns in none.items():
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    for k, table in enumerate((docs, docs.limit(0))):
        left = table
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, left, str(tmp_path)).write.parquet(path)
            left = spark.read.parquet(path)
            if name != "token_output":
                assert left.columns == docs.columns
            if name in ("toxicity", "decontamination") or k:
                assert left.count() == (len(rows) if name == "toxicity" and not k else left.count()) and (not k or left.isEmpty())
        if not k:
            assert {None, 101, 102, 103} - {x.doc_id for x in left.collect()} <= {None, 101, 103}
