"""Hard negatives of anchors: rows of other labels whose score lies in a window under the score of a positive.

Vectors become whole numbers, and every score is an exact inner product from a residue number system (residues.py). Anchors go out in
broadcast blocks of about ANCHOR_BLOCK, against all rows twice: the first scan keeps the best rows of an anchor's own label (its positives), the
second, for each positive, the best rows of other labels within its window. A task keeps only `k` rows for an anchor or positive, so its
memory is bounded by the block; what the tasks found is ranked by Spark, which cuts each task's share to k before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantra.llm.common import frugal, stored
from quantra.llm.residues import Residues

SCALE, ANCHOR_BLOCK, ROWS, ANCHORS = 256, 4096, 2048, 512
NONE = np.iinfo(np.int64).min
FOUND = "slot int, vec_id long, score long"


def _integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(scale * values).astype(np.int64).reshape(len(column), dim)


class Best:
    """The k best candidates of every slot: higher scores first, then smaller ids; equal id and score count once."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.floor = k, np.full(slots, NONE)
        self.slot, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if len(slot):
            self.waiting.append((slot, ids, score))
            self.count += len(slot)
            if self.count > 1 << 16:
                self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        slot, ids, score = (np.concatenate(x) for x in zip((self.slot, self.id, self.score), *self.waiting))
        self.waiting, self.count = [], 0
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        new = np.r_[True, (slot[1:] != slot[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])]
        slot, ids, score = slot[new], ids[new], score[new]
        head = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        turn = np.arange(len(slot)) - np.repeat(head, np.diff(np.append(head, len(slot))))
        last = turn == self.k - 1
        self.floor[slot[last]] = score[last]
        kept = turn < self.k
        self.slot, self.id, self.score = slot[kept], ids[kept], score[kept]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        if len(self.slot):
            yield pa.RecordBatch.from_arrays([pa.array(self.slot, pa.int32()), pa.array(self.id), pa.array(self.score)], ["slot", "vec_id", "score"])


def _scan(shared, dim: int, scale: int, k: int, collect):
    """Rows meet all anchors in tiles; collect(best, anchors' places, scores, same label, ids) adds what may be among the best."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, anchor_labels, anchors, slots, context = shared.value
        best = Best(slots, k)
        of = system.of(anchors)
        parts = [(np.arange(lo, min(lo + ANCHORS, len(anchors))), [r[lo : lo + ANCHORS] for r in of]) for lo in range(0, len(anchors), ANCHORS)]
        for batch in batches:
            ids, labels = (batch[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            for lo in range(0, len(ids), ROWS):
                cut = slice(lo, lo + ROWS)
                own = system.of(_integers(batch["embedding"][cut], dim, scale))
                for at, a in parts:
                    collect(best, at, system, a, own, anchor_labels[at], labels[cut], ids[cut], context)
        yield from best.batches()

    return frugal(rows)


def _same_label(best: Best, at, system, a, own, anchor_labels, labels, ids, anchor_ids) -> None:
    for label in np.intersect1d(anchor_labels, labels):
        i, j = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
        score = system.scores([x[i] for x in a], [x[j] for x in own])
        slot, own_ids = at[i], ids[j]
        score[anchor_ids[slot][:, None] == own_ids[None, :]] = NONE
        _reaching(best, slot, score, own_ids)


def _other_label(best: Best, at, system, a, own, anchor_labels, labels, ids, windows) -> None:
    score = system.scores(a, own)
    score[anchor_labels[:, None] == labels[None, :]] = NONE
    first, low, high = windows  # slots of an anchor: first[anchor] to first[anchor + 1]
    for turn in range(int(np.diff(first).max(initial=0))):
        has = np.flatnonzero(first[at] + turn < first[at + 1])
        slot = first[at[has]] + turn
        inside = np.where(score[has] <= high[slot][:, None], score[has], NONE)
        inside[inside < low[slot][:, None]] = NONE
        _reaching(best, slot, inside, ids)


def _reaching(best: Best, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Add what reaches each slot's k-th best so far; where much does, the k-th best of this tile bounds it first (if no id repeats in it, as repeated rows count once)."""
    hit = (score >= best.floor[slot][:, None]) & (score > NONE)
    many = np.flatnonzero(hit.sum(axis=1) > 4 * best.k)
    if len(many) and len(np.unique(ids)) == len(ids):
        some = score[many]
        hit[many] &= some >= np.partition(some, some.shape[1] - best.k, axis=1)[:, -best.k][:, None]
    i, j = np.nonzero(hit)
    best.add(slot[i], ids[j], score[i, j])
    if len(many):
        best.fold()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(rows: DataFrame, anchors: DataFrame, dim: int, scale: int, system: Residues, positives: int, k: int, low: int, high: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    got = [(r.vec_id, r.label, r.embedding) for r in anchors.toLocalIterator()]  # about ANCHOR_BLOCK rows
    ids, labels = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.int64)
    whole = np.floor(scale * np.array([r[2] for r in got], np.float64)).astype(np.int64).reshape(len(got), dim)
    first = context.broadcast((system, labels, whole, len(got), ids))
    near = _ranked(rows.mapInArrow(_scan(first, dim, scale, positives, _same_label), FOUND), positives).collect()  # `positives` rows an anchor at most
    near.sort(key=lambda r: (r.slot, r["rank"]))
    slot, score = np.array([r.slot for r in near], np.int64), np.array([r.score for r in near], np.int64)
    starts = np.searchsorted(slot, np.arange(len(got) + 1))
    windows = starts, -((-low * score) // 100), (high * score) // 100
    second = context.broadcast((system, labels, whole, len(near), windows))
    hard = _ranked(rows.mapInArrow(_scan(second, dim, scale, k, _other_label), FOUND), k)
    pairs = rows.sparkSession.createDataFrame([(n, int(ids[r.slot]), r.vec_id, r.score) for n, r in enumerate(near)], "slot int, anchor_id long, positive_id long, positive_score long")
    return hard.join(F.broadcast(pairs), "slot").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's `positives` best rows of its label, the k best rows of other labels scoring low to high percent of it.

    vectors, anchors: vec_id long, label int, embedding array<float or double>; a component x counts as floor(scale * x), scores are exact inner
    products, higher ones first, ties to the smaller vec_id. Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part; vectors
    meet anchors of their own length. A row with the anchor's id is no candidate of it as a positive. Repeated rows count once (candidates of equal id and score), so a repeated anchor
    gives its rows once. An anchor without positives, and a positive without rows in its window, give no rows; so does a score of zero or
    less, whose window is empty or zero alone. Scores beyond 2**61 are an error. Other columns are ignored.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = lambda df: df.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0").where(fine)
    rows, chosen = plain(vectors), stored(plain(anchors).distinct(), "anchors")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"), 2))
    longest = {r.dim: r.most for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.max(square).alias("most")).collect()}
    found = []
    for dim, n in sorted(chosen.groupBy(F.size("embedding")).count().collect()):
        most = max(longest.get(dim, 0.0), chosen.where(F.size("embedding") == dim).agg(F.max(square)).first()[0])
        if most * 1.001 > 1 << 61:
            raise ValueError("scores do not fit a long")
        system = Residues(dim, int(most * 1.001) + 1)  # no product exceeds the longest vector's square
        blocks = -(-n // ANCHOR_BLOCK)
        for b in range(blocks):
            part = chosen.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b))
            got = _block(rows.where(F.size("embedding") == dim), part, dim, scale, system, positives, k, low, high)
            found.append(stored(got, "hard-negatives") if blocks > 1 else got)
    if not found:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label)
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
