"""Exact top-k search by inner product over vector-approximation files.

Every component is cut into 256 cells between its least and greatest value; the approximation file holds a byte a component.
A query block (at most QUERY_BLOCK queries, broadcast) scans the approximations: a cell bounds the component from both
sides, so it bounds the score. With the widest cells, a score is at most its upper bound and at least that less the
query's gap; whatever is under the k-th best such lower bound goes. The rest is read exactly in the order of the bounds: first
the 2k best bounds, then only those whose bound still reaches the k-th exact score, after which the result is certain.

Of vectors that are equal in every component only the k+1 least ids can be in any result (ties go to the smaller id, and the query's
own row is one at most), so the scan keeps those; this bounds what a common vector gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantra.llm.common import small, stored

SCALE, CELLS, QUERY_BLOCK, ROWS = 1024, 256, 4096, 2048


def _whole(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are finite vectors of `dim` components, and their components as floor(SCALE * x)."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    values = column.take(pa.array(at)).flatten().cast(pa.float64())
    x = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    fine = np.isfinite(x).all(axis=1)
    return at[fine], np.floor(SCALE * x[fine])


def _limits(dim: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            _, x = _whole(batch["embedding"], dim)
            if len(x):
                lo, hi = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
        if np.isfinite(lo).all():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(lo), pa.array(hi)], ["at", "lo", "hi"])

    return rows


def _edges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer of every cell of every component."""
    span = (hi - lo + 1)[:, None]
    first = lo[:, None] + np.ceil(np.arange(CELLS + 1) * span / CELLS)
    return first[:, :-1], np.maximum(first[:, 1:] - 1, first[:, :-1])


def _approximate(dim: int, first: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _whole(batch["embedding"], dim)
            cells = np.stack([np.searchsorted(first[j], x[:, j], side="right") - 1 for j in range(dim)], axis=1).astype(np.uint8)
            digest = [xxhash.xxh3_128_digest(row.tobytes()) for row in x]
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(at)), pa.array(digest, pa.binary()), pa.array([c.tobytes() for c in cells], pa.binary())], ["vec_id", "digest", "cells"])

    return rows


def approximation_file(vectors: DataFrame, dim: int, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(vec_id, cells) of the vectors that can be in a result, and the cells' edges."""
    bounds = {r["at"]: (r.lo, r.hi) for r in vectors.mapInArrow(_limits(dim), "at int, lo double, hi double").groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    lo, hi = (np.array([bounds.get(j, (0.0, 0.0))[i] for j in range(dim)]) for i in (0, 1))
    first, last = _edges(lo, hi)
    cells = vectors.mapInArrow(_approximate(dim, first), "vec_id long, digest binary, cells binary").distinct()
    turn = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    kept = cells.withColumn("turn", turn).where(F.col("turn") <= k + 1).select("vec_id", "cells")
    return stored(kept, "approximations"), first, last


def _scan(shared, dim: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, first, last = shared.value
        sides = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        width = (last - first).max(axis=1)
        slack = 1e-12 * np.abs(q) @ np.maximum(np.abs(first), np.abs(last)).max(axis=1)
        gap = np.abs(q) @ width + 2 * slack
        best = np.full((len(q), k), -np.inf)
        found: list[list[np.ndarray]] = []
        row_of = np.arange(dim)
        for batch in batches:
            ids = batch["vec_id"].to_numpy(zero_copy_only=False)
            cells = np.frombuffer(b"".join(batch["cells"].to_pylist()), np.uint8).reshape(len(ids), dim)
            for lo in range(0, len(ids), ROWS):
                c, own = cells[lo : lo + ROWS], ids[lo : lo + ROWS]
                ends = np.concatenate([last[row_of, c], first[row_of, c]], axis=1)
                for a in range(0, len(q), 1024):
                    part = slice(a, a + 1024)
                    upper = sides[part] @ ends.T + slack[part, None]
                    upper[query_ids[part, None] == own[None, :]] = -np.inf
                    top = np.concatenate([best[part], upper], axis=1)
                    best[part] = -np.partition(-top, k - 1, axis=1)[:, :k]
                    i, j = np.nonzero(upper >= (best[part].min(axis=1) - gap[part])[:, None])
                    fine = np.isfinite(upper[i, j])
                    i, j = i[fine], j[fine]
                    found.append([i + a, own[j], upper[i, j]])
            if sum(len(x[0]) for x in found) > 1 << 20:
                found = [_reaching(found, best, gap)]
        if found:
            i, ids, upper = _reaching(found, best, gap)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[i]), pa.array(ids), pa.array(upper), pa.array(gap[i])], ["query_id", "vec_id", "upper", "gap"])

    return rows


def _reaching(found, best, gap) -> list[np.ndarray]:
    i, ids, upper = (np.concatenate(x) for x in zip(*found))
    ok = upper >= best.min(axis=1)[i] - gap[i]
    return [i[ok], ids[ok], upper[ok]]


def _integers(name: str):
    return F.transform(name, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def _exact(candidates: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds score to (query_id, vec_id, ...): the exact vectors are read for these rows alone."""
    with_vector = vectors.select("vec_id", F.col("embedding").alias("v")).join(small(candidates, 1_000_000), "vec_id")
    both = with_vector.join(queries, "query_id").where(F.size("v") == F.size("q"))
    score = F.aggregate(F.zip_with(_integers("q"), _integers("v"), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    return both.select(*candidates.columns, score.alias("score")).distinct()


def _block(vectors: DataFrame, approx: DataFrame, first, last, queries: DataFrame, dim: int, k: int) -> DataFrame:
    spark = vectors.sparkSession
    got = [(r.query_id, r.q) for r in queries.toLocalIterator()]
    ids = np.array([i for i, _ in got], np.int64)
    q = np.floor(SCALE * np.array([x for _, x in got], np.float64)).reshape(len(got), dim)
    shared = spark.sparkContext.broadcast((ids, q, first, last))
    scanned = approx.mapInArrow(_scan(shared, dim, k), "query_id long, vec_id long, upper double, gap double")
    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    kth = F.max(F.when(F.col("turn") == k, F.col("upper") - F.col("gap"))).over(Window.partitionBy("query_id"))
    ranked = scanned.withColumn("turn", F.row_number().over(order)).withColumn("least", kth)
    ranked = stored(ranked.where("least IS NULL OR upper >= least").select("query_id", "vec_id", "upper", "turn"), "candidates")
    sure = stored(_exact(ranked.where(F.col("turn") <= 2 * k).select("query_id", "vec_id"), vectors, queries), "exact")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    limit = sure.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select("query_id", F.col("score").alias("limit"))
    open_rows = ranked.where(F.col("turn") > 2 * k).join(limit, "query_id").where("upper >= limit").select("query_id", "vec_id")
    every = sure.unionByName(_exact(open_rows, vectors, queries))
    return every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(1024 x) for each query, ties to the smaller vec_id.

    vectors: vec_id long, embedding array<float or double>; queries: the same columns. A query's own vec_id is no candidate of it. Rows with a
    null id or vector, or a null or non-finite component, and empty vectors take no part; vectors are compared with queries of
    their own length. Rows that repeat id and vector count once. Fewer than k candidates: all of them. Components are exact while
    products and their sums fit in a long.
    """
    vectors = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).where("query_id IS NOT NULL AND size(q) > 0")
    queries = stored(queries.where(F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).distinct(), "queries")
    vectors = vectors.where(fine)
    found = []
    for dim, n in sorted(queries.groupBy(F.size("q")).count().collect()):
        approx, first, last = approximation_file(vectors, dim, k)
        blocks = -(-n // QUERY_BLOCK)
        for b in range(blocks):
            part = queries.where((F.size("q") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
            rows = _block(vectors, approx, first, last, part, dim, k)
            found.append(stored(rows, "found") if blocks > 1 else rows)
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op1_vector_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
