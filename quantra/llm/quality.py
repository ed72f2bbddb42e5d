"""Quality rules learnt by gradient-boosted trees over statistics of each document.

Each text gives FEATURES, all counted over the whole text. Trees are fitted to the labelled documents by second-order gradient
boosting over histograms, in one task over a bounded sample (about SAMPLE rows a class at most), and flattened into numpy arrays of nodes; scoring walks all rows through
a tree level by level, without a branch a row. For the features in FALLING the score never rises with the value: a split that would break
this is not taken, and both sides are held to their half of the parent's range, so it holds for the whole sum of trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantra.llm.common import chunks, frugal, row_key, stored, text_bytes
from quantra.llm.texthash import SEQUENCE, SPACED, WORD, U, _table, fitting, mix, words

#: The characters that count as symbols.
SYMBOLS = _table(b"#*$%&|<>")
UPPER, DIGITS, STOPS = _table(range(65, 91)), _table(range(48, 58)), _table(b".!?")
HIGH = _table(range(128, 256))
#: What base rules and results name, then what the trees use besides.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "distinct_share", "stop_share", "longest_word", "words_a_line", "one_letter_share", "exclaim_share",
]
FALLING = ["symbol_share", "dup_line_share", "repeat_share"]
#: Bound on the labelled rows used from each class.
SAMPLE = 8000
NODES = ["feature", "limit", "left", "right", "value"]
TREES, DEPTH, RATE, BINS, L2, LEAST_ROWS = 60, 3, 0.15, 64, 1.0, 5


def _by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of flags over the bytes (or words) of each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur in their row before, and which occur in it more than once."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((keys, row))
    new = np.r_[True, (keys[order][1:] != keys[order][:-1]) | (row[order][1:] != row[order][:-1])]
    size = np.diff(np.append(np.flatnonzero(new), len(keys)))
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order], many[order] = ~new, np.repeat(size > 1, size)
    return later, many


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and FEATURES (rows x names) of texts given by their bytes and where each begins."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets, SPACED)
    prefix = WORD.prefix(data.astype(U) + U(1))
    n_words = np.diff(first)
    row = np.repeat(np.arange(n), n_words)
    begins = (data & 0xC0) != 0x80  # code points
    word_chars = _by_row(begins & SPACED[data], offsets)
    symbols = _by_row(SYMBOLS[data], offsets)
    # lines, of which those with a word count
    breaks = np.flatnonzero(data == 10)
    heads = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    heads = heads[heads < len(data)]
    own = np.searchsorted(offsets, heads, side="right") - 1
    stops = np.minimum(np.append(heads[1:], len(data)), offsets[own + 1])
    stops -= (stops > heads) & (data[np.maximum(stops - 1, 0)] == 10)
    filled = np.searchsorted(starts, stops) > np.searchsorted(starts, heads)
    heads, stops, own = heads[filled], stops[filled], own[filled]
    later, _ = _again(own, WORD.spans(prefix, heads, stops) ^ mix((stops - heads).astype(U)))
    dup_lines, lines = np.bincount(own, later, n).astype(np.int64), np.bincount(own, minlength=n)
    # words in repeated windows of three
    h = WORD.spans(prefix, starts, ends)
    at = np.flatnonzero(fitting(first, 3, len(h))[: max(len(h) - 2, 0)])
    _, twice = _again(row[at], SEQUENCE.windows(h, 3)[at])
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    repeats = np.bincount(row, covered, n).astype(np.int64)
    counts = np.stack([n_words, word_chars, symbols, dup_lines, repeats], axis=1)
    word_again, _ = _again(row, h)
    total = np.cumsum(np.r_[0, begins])
    size = total[ends] - total[starts]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, size)
    some = np.maximum(n_words, 1)
    chars = np.maximum(word_chars, 1)
    letters = np.maximum(_by_row(~(DIGITS[data]) & SPACED[data] & begins & ~SYMBOLS[data], offsets), 1)
    shares = [
        np.log1p(n_words), word_chars / some, symbols / chars, dup_lines / np.maximum(lines, 1), repeats / some, _by_row(UPPER[data], offsets) / letters, _by_row(DIGITS[data], offsets) / chars,
        1 - np.bincount(row, word_again, n) / some, _by_row(STOPS[data], offsets) / some, longest, n_words / np.maximum(lines, 1), np.bincount(row, size == 1, n) / some, _by_row(data == 33, offsets) / some,
    ]
    return counts, np.stack(shares, axis=1)


@dataclass
class Trees:
    """Boosted trees as arrays of nodes (trees x nodes): a row goes left where its feature is at most the limit; leaves lead to themselves."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                low = x[rows, self.feature[t][at]] <= self.limit[t][at]
                at = np.where(low, self.left[t][at], self.right[t][at])
            out += self.value[t][at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def boost(x: np.ndarray, y: np.ndarray, falling: list[int], trees: int = TREES) -> Trees:
    """Trees for rows x and labels y (0 or 1), with scores that never rise with the features in `falling`."""
    nodes = (1 << DEPTH + 1) - 1
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) if len(x) else np.zeros(x.shape, np.int64)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    out = Trees(float(np.log(mean / (1 - mean))), *(np.zeros((trees, nodes), t) for t in (np.int64, np.float64, np.int64, np.int64, np.float64)))
    out.left[:] = out.right[:] = np.arange(nodes)
    margin = np.full(len(x), out.base)
    signs = np.zeros(x.shape[1])
    signs[falling] = -1
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        out.value[t][0] = np.clip(-g.sum() / (h.sum() + L2), -np.inf, np.inf) if len(x) else 0.0
        for node in range((1 << DEPTH) - 1):
            own = np.flatnonzero(at == node)
            best = _split(bins[own], g[own], h[own], edges, signs, low[node], high[node]) if len(own) >= 2 * LEAST_ROWS else None
            if best is None:
                continue
            j, cut, values = best
            left, right = 2 * node + 1, 2 * node + 2
            out.feature[t][node], out.limit[t][node], out.left[t][node], out.right[t][node] = j, edges[j][cut], left, right
            out.value[t][left], out.value[t][right] = values
            low[[left, right]], high[[left, right]] = low[node], high[node]
            if signs[j]:  # the left side has the smaller values of a falling feature, so the higher scores
                middle = sum(values) / 2
                low[left], high[right] = max(low[left], middle), min(high[right], middle)
            at[own] = np.where(bins[own, j] <= cut, left, right)
        out.value[t] *= RATE
        margin += out.value[t][at]
    return out


def _split(bins: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], signs: np.ndarray, low: float, high: float):
    """The feature, bin and both sides' values of the split that gains most, or None."""
    best, found = 1e-9, None
    value = lambda gs, hs: np.clip(-gs / (hs + L2), low, high)
    loss = lambda gs, hs, v: gs * v + 0.5 * (hs + L2) * v * v
    whole = loss(g.sum(), h.sum(), value(g.sum(), h.sum()))
    for j, e in enumerate(edges):
        if not len(e):
            continue
        gs, hs, n = (np.cumsum(np.bincount(bins[:, j], w, len(e) + 1))[:-1] for w in (g, h, None))
        gr, hr = g.sum() - gs, h.sum() - hs
        a, b = value(gs, hs), value(gr, hr)
        gain = whole - loss(gs, hs, a) - loss(gr, hr, b)
        fine = (n >= LEAST_ROWS) & (len(bins) - n >= LEAST_ROWS) & (signs[j] * (b - a) >= 0)
        gain = np.where(fine, gain, -np.inf)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (j, k, (float(a[k]), float(b[k])))
    return found


def _label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        for lo, hi, part, off in chunks(data, offsets):
            _, x = statistics(part, off)
            yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], batch["row_key"][lo:hi], batch["label"][lo:hi], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "row_key", "label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, share: tuple[int, ...] = (0, 1, 2, 3, 4)) -> Trees | None:
    """Trees from the labelled rows whose crc32(doc_id as text) mod 5 is in `share`, all of them as given. None without labels of both kinds.

    labels: doc_id long, quality int (1 is good). Null ids, labels and texts are left out; a document labelled twice is good only if all its labels say so.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold.isin(*share)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label")).where("label IN (0, 1)")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_003)) / 1_000_003
    wanted = F.lit(False)
    for label, n in counts.items():
        wanted |= (F.col("label") == label) & (draw < min(1.0, sample / n))
    chosen = F.broadcast(known.where(wanted))  # about `sample` rows a label
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id").select("doc_id", row_key().alias("row_key"), "label", "text")
    rows = stored(rows.mapInArrow(frugal(_label_rows), "doc_id long, row_key long, label int, x binary"), "quality-sample")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row_key", "ascending")])
        x = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(-1, len(FEATURES))
        made = boost(x, table["label"].to_numpy().astype(np.float64), [FEATURES.index(f) for f in FALLING])
        return pa.table([pa.array([made.base]), *(pa.array([getattr(made, k).tobytes()]) for k in NODES)], ["base", *NODES])

    got = rows.groupBy().applyInArrow(fit, "base double, " + ", ".join(f"{k} binary" for k in NODES)).collect()  # one row: the trees
    if not got:
        return None
    kinds = {k: np.float64 if k in ("limit", "value") else np.int64 for k in NODES}
    return Trees(got[0]["base"], *(np.frombuffer(got[0][k], kinds[k]).reshape(-1, (1 << DEPTH + 1) - 1) for k in NODES))



def _judged(model, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            for lo, hi, part, off in chunks(data, offsets):
                counts, x = statistics(part, off)
                failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
                score = trees.score(x) if trees else np.ones(len(x))
                yield pa.RecordBatch.from_arrays([*(batch[k][lo:hi] for k in batch.schema.names if k != "text"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], [*(k for k in batch.schema.names if k != "text"), *COUNTS, "base_failed", "score", "kept"])

    return frugal(rows)


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, share: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """One row for each of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    docs: doc_id long, text string. Null and empty texts have zeros, fail the base rules (under 50 words, or over half of them in repeated windows of three) and are not kept; very
    long texts count whole. Repeated rows are judged alike, rows with a null doc_id like any other. Without labels of both kinds, score is 1 and the base
    rules decide alone. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, sample, share))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judged(model, threshold), schema)


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
