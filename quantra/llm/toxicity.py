"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

Features are the distinct single words, word pairs and pairs around one skipped word (`w _ w`) of a text, lower-cased, and the stems of its
words (the first STEMS bytes of words that go on after them, for languages that build their words), hashed into 2**BITS places. Each coordinate has its own learning rate (from the sum of its squared gradients), and the L1 term keeps most
weights at exactly zero: the model that is broadcast is the few non-zero weights.

Training: FTRL is a sequential method, so one task runs it, ROUNDS times over a bounded sample of the labelled rows (about SAMPLE
of each label at most, drawn by a hash of the id). Averaging the states of parallel learners was tried: it left more weights
and missed more toxic rows. A toxic row's gradient counts for the ratio of the classes to the power CLASS_POWER.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantra.llm.common import chunks, frugal, stored, text_bytes
from quantra.llm.texthash import ALNUM, LOWER, WORD, U, mix, words

BITS = 20
#: Bound on the labelled rows used from each class.
SAMPLE = 8000
ROUNDS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 24.0, 0.5
PAIR, SKIP = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)
STEMS = {5: U(0x8EBC6AF09C88C6E3), 6: U(0x589965CC75374CC3), 7: U(0x1D8E4E27C47D124F)}
BIAS = 1 << BITS
CLASS_POWER = 1.25


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of every feature of every row, rows in order, and each row's count (repeats included)."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets, ALNUM)
    prefix = WORD.prefix(data.astype(U) + U(1))
    h = WORD.spans(prefix, starts, ends)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    keys, rows = [h], [row]
    for size, salt in STEMS.items():
        long = ends - starts > size
        keys.append(mix(WORD.spans(prefix, starts[long], starts[long] + size) * salt))
        rows.append(row[long])
    for gap, salt in ((1, PAIR), (2, SKIP)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            keys.append(mix(h[:-gap] * salt + h[gap:])[same])
            rows.append(row[gap:][same])
    at = (np.concatenate(keys) >> U(64 - BITS)).astype(np.int64)
    order = np.argsort(np.concatenate(rows), kind="stable")
    return at[order], np.bincount(np.concatenate(rows), minlength=len(n))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        for lo, hi, part, off in chunks(data, offsets):
            at, n = features(part, off)
            cut = np.cumsum(n)
            blobs = [np.unique(at[b - k : b]).astype("<u4").tobytes() for b, k in zip(cut, n)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], batch["label"][lo:hi], pa.array(blobs, pa.binary())], ["doc_id", "label", "places"])


class Ftrl:
    """The state (z, n) of every coordinate; the last is the bias."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None) -> None:
        self.z = np.zeros(BIAS + 1) if z is None else z
        self.n = np.zeros(BIAS + 1) if n is None else n

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float, weight: float = 1.0) -> None:
        at = np.append(at.astype(np.int64), BIAS)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(rows: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """rows: (doc_id long, label int, places binary) of a bounded sample -> places and values of the non-zero weights."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("places", "ascending")])
        places = [np.frombuffer(x, "<u4") for x in table["places"].to_pylist()]
        labels = table["label"].to_numpy()
        toxic = max(1, int(labels.sum()))
        weight = max(1.0, (len(labels) - toxic) / toxic) ** CLASS_POWER
        state = Ftrl()
        for turn in range(rounds):
            for i in np.random.default_rng(turn).permutation(len(places)):
                state.learn(places[i], labels[i], weight if labels[i] else 1.0)
        w = state.weights()
        at = np.flatnonzero(w)
        return pa.table([pa.array([at.tobytes()]), pa.array([w[at].tobytes()])], ["at", "w"])

    got = rows.groupBy().applyInArrow(fit, "at binary, w binary").collect()  # one row: the sparse weights
    return (np.frombuffer(got[0]["at"], np.int64), np.frombuffer(got[0]["w"])) if got else (np.zeros(0, np.int64), np.zeros(0))


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The weights from the labelled rows whose crc32(doc_id as text) mod 5 is not 0. Null ids, labels and texts are left out; a document labelled twice counts as toxic if one label says so."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(remainder() != 0).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003
    wanted = F.lit(False)
    for label, n in counts.items():
        wanted |= (F.col("label") == label) & (draw < min(1.0, sample / n))
    chosen = F.broadcast(known.where(wanted))  # about `sample` rows a label
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id")
    rows = rows.select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(frugal(_feature_rows), "doc_id long, label int, places binary")
    return train(stored(rows, "toxicity-sample"))


def _scores(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(BIAS + 1)
        at, w = model.value
        weights[at] = w
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            sums = []
            for lo, hi, part, off in chunks(data, offsets):
                places, n = features(part, off)
                value = weights[places]
                row = np.repeat(np.arange(len(n)), n)
                hit = value != 0  # few; each distinct place counts once a text
                both = np.unique(row[hit] << (BITS + 1) | places[hit])
                sums.append(np.bincount(both >> (BITS + 1), weights[both & ((1 << BITS + 1) - 1)], len(n)))
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(sums or [np.zeros(0)]) + weights[BIAS], -35, 35)))
            rest = [k for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in rest), pa.array(score)], [*rest, "score"])

    return rows


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id long, text string; labels: doc_id, toxic).

    Null and empty texts score by the bias alone, very long ones by all their words; a null doc_id is not held out (and never trained on). With no labelled
    rows every score is 0.5. Repeated rows score alike, ties stay ties, and an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, sample))
    scored = docs.select("doc_id", "text").mapInArrow(frugal(_scores(model)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that score `threshold` or more; columns as given, whatever their names.

    A null or empty text stays if the bias alone does; repeated rows stay or go together; rows with a null doc_id are judged like any other. Without
    labelled rows, or if no weight is left, docs stay as they are. An empty table stays empty.
    """
    at, w = fit_toxicity(docs, labels, sample)
    if not len(at):
        return docs
    model = docs.sparkSession.sparkContext.broadcast((at, w))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(model)
        for batch in batches:
            (got,) = score(iter([pa.RecordBatch.from_arrays([batch["text"]], ["text"])]))
            yield batch.filter(pa.array(got["score"].to_numpy() < threshold))

    return docs.mapInArrow(frugal(rows), docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
