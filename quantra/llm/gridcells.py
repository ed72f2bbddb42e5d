"""Compression of vectors to codes of their parts (product quantisation), with memoised grid cells for the nearest entry.

A vector of whole components is cut into consecutive parts, each with a codebook that rounds of assignment and averaging fit over all rows.
To assign a part, its coarse grid cell is hashed. For a cell not seen before, every entry's least and greatest distance to the cell's box
is taken; entries whose least distance is over the smallest greatest distance are dominated everywhere in the box, and the others are
cached under the cell. Only these are evaluated exactly. Bounds and distances are whole numbers, so ties are exact as well.

A distance to a box is a sum over components, and what a component adds depends on its own cell alone; so these terms are looked up,
not computed again for each box. A task's cache holds at most CACHE cells a part and starts anew when it is full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantra.llm.common import frugal, lists, ranges, small, stored
from quantra.llm.texthash import U, mix

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Cells are this many to the spread of the first codebook, in every component of a part.
CELLS = 32
CACHE, ROWS, PAIRS, TILE = 1 << 14, 2048, 1 << 17, 128
#: Whole components are at most this far from zero, so that a part's distances fit a long for up to 2**20 components.
MOST = 1 << 20


def _cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where each part begins and ends; if dim is no multiple of parts the first ones are longer by one."""
    size, more = divmod(dim, parts)
    ends = np.cumsum([size + (p < more) for p in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def _integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(scale * values).astype(np.int64).reshape(len(column), dim)


class Cells:
    """The nearest entry of one part's codebook, by cells whose candidates are cached. `exact` counts the distances evaluated, `bounded` the cells whose bounds were taken."""

    def __init__(self, book: np.ndarray, width: int) -> None:
        self.book, self.width, self.exact, self.bounded = book, max(1, width), 0, 0
        r = np.random.default_rng(0)
        self.salts = r.integers(1, 1 << 63, max(1, book.shape[1]), dtype=np.int64).astype(U) * U(2) + U(1)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.order = np.zeros(0, U), np.zeros(0, np.int64)
        self.coarse = np.zeros((0, self.book.shape[1]), np.int64)
        self.starts, self.counts, self.candidates = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)

    def _candidates(self, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries not dominated across each cell's box, concatenated, and how many each cell has."""
        terms = []
        most = 0
        for j in range(coarse.shape[1]):
            seen, at = np.unique(coarse[:, j], return_inverse=True)
            low = (seen * self.width)[:, None] - self.book[None, :, j]  # from an entry to the box's lower end, and to its upper
            high = low + (self.width - 1)
            inside, outside = np.maximum(np.maximum(low, -high), 0), np.maximum(np.abs(low), np.abs(high))
            terms.append((at, inside * inside, outside * outside))
            most += int(terms[-1][2].max(initial=0))
        kind = np.int32 if most < 1 << 31 else np.int64
        terms = [(at, near.astype(kind), far.astype(kind)) for at, near, far in terms]
        self.bounded += len(coarse)
        entries, counts = [], []
        for lo in range(0, len(coarse), TILE):
            size = min(TILE, len(coarse) - lo)
            near, far = np.zeros((size, len(self.book)), kind), np.zeros((size, len(self.book)), kind)
            for at, inside, outside in terms:
                near += inside.take(at[lo : lo + size], axis=0)
                far += outside.take(at[lo : lo + size], axis=0)
            open_entries = near <= far.min(axis=1)[:, None]
            entries.append(np.nonzero(open_entries)[1].astype(np.int16))
            counts.append(np.count_nonzero(open_entries, axis=1))
        return np.concatenate(entries), np.concatenate(counts)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys in the cache, -1 where they are not in it."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def _remember(self, keys: np.ndarray, coarse: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHE:
            self._clear()
        entry, counts = self._candidates(coarse)
        self.starts = np.append(self.starts, len(self.candidates) + np.cumsum(counts) - counts)
        self.counts, self.candidates = np.append(self.counts, counts), np.append(self.candidates, entry)
        both, place = np.append(self.keys, keys), np.append(self.order, len(self.coarse) + np.arange(len(keys)))
        self.coarse = np.concatenate([self.coarse, coarse])
        order = np.argsort(both, kind="stable")
        self.keys, self.order = both[order], place[order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the nearest entry, the first on ties, and the squared distance."""
        coarse = x // self.width
        keys = mix((coarse.astype(U) * self.salts[: x.shape[1]]).sum(axis=1, dtype=U))
        unique, first, of = np.unique(keys, return_index=True, return_inverse=True)
        place = self._find(unique)
        if (new := place < 0).any():
            known = unique if len(self.keys) + np.count_nonzero(new) > CACHE else unique[new]  # a full cache is cleared: what this step needs is bounded again
            self._remember(known, coarse[first[np.isin(unique, known)]])
            place = self._find(unique)
        place = place[of]
        other = np.flatnonzero((self.coarse[place] != coarse).any(axis=1))  # another cell of the same hash: all entries
        counts, starts = self.counts[place], self.starts[place]
        code, error = self._least(x, counts, starts, self.candidates)
        if len(other):
            every = np.arange(len(self.book), dtype=np.int16)
            code[other], error[other] = self._least(x[other], np.full(len(other), len(every)), np.zeros(len(other), np.int64), every)
        return code, error

    def _least(self, x: np.ndarray, counts: np.ndarray, starts: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        ends = np.cumsum(counts)
        lo = 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            n = counts[lo:hi]
            entry = candidates[ranges(starts[lo:hi], n)].astype(np.int64)
            row = np.repeat(np.arange(hi - lo), n)
            gap = x[lo:hi][row] - self.book[entry]
            distance = (gap * gap).sum(axis=1)
            head = np.cumsum(n) - n
            least = np.minimum.reduceat(distance, head)
            hit = np.flatnonzero(distance == least[row])
            _, at = np.unique(row[hit], return_index=True)
            code[lo:hi], error[lo:hi] = entry[hit[at]], least
            self.exact += len(entry)
            lo = hi
        return code, error


def _assigned(shared, dim: int, scale: int, use):
    """use(rows' batch or None at the end, codes, errors, whole components) yields what a task gives."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, widths = shared.value
        cuts = _cuts(dim, len(books))
        cells = [Cells(book, width) for book, width in zip(books, widths)]
        state = use(books)
        next(state)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = _integers(part["embedding"], dim, scale)
                found = [c.nearest(x[:, a:b]) for c, (a, b) in zip(cells, cuts)]
                made = state.send((part, x, found))
                if made is not None:
                    yield made
        if (made := state.send(None)) is not None:
            yield made

    return frugal(rows)


def _sums(dim: int, parts: int):
    """Sums and counts of the parts that each entry has."""
    wide = max(b - a for a, b in _cuts(dim, parts))

    def use(books):
        cuts = _cuts(dim, len(books))
        total = [np.zeros((len(b), y - x), np.int64) for b, (x, y) in zip(books, cuts)]
        count = [np.zeros(len(b), np.int64) for b in books]
        got = yield
        while got is not None:
            _, x, found = got
            for p, ((code, _), (a, b)) in enumerate(zip(found, cuts)):
                order = np.argsort(code, kind="stable")
                entry, head = np.unique(code[order], return_index=True)
                if b > a:
                    total[p][entry] += np.add.reduceat(x[order, a:b], head, axis=0)
                count[p] += np.bincount(code, minlength=len(count[p]))
            got = yield None
        used = [np.flatnonzero(c) for c in count]
        part = np.repeat(np.arange(len(books)), [len(u) for u in used])
        sums = np.concatenate([np.pad(t[u], ((0, 0), (0, wide - t.shape[1]))) for t, u in zip(total, used)])
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.concatenate(used), pa.int32()), pa.array(np.concatenate([c[u] for c, u in zip(count, used)])), lists(sums.ravel(), np.full(len(sums), wide), pa.int64())], ["part", "entry", "n", "sums"])

    return use, wide


def _codes(books):
    got = yield
    while got is not None:
        part, _, found = got
        code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
        text = [c.tobytes().hex() for c in code]
        got = yield pa.RecordBatch.from_arrays([part["vec_id"], part["label"], pa.array(text), pa.array(sum(e for _, e in found))], ["vec_id", "label", "code", "error"])
    yield None


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows whose vector is there and has neither null nor non-finite components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "label", "embedding").where("embedding IS NOT NULL").where(fine)


def fit_codebooks(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[list[np.ndarray], list[int]]:
    """A codebook for each part, and the width of its cells, from rows (of whole_vectors) of `dim` components: `parts` x `entries` x dim/parts numbers in all."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()
    whole = np.floor(scale * np.array([r.embedding for r in first], np.float64)).astype(np.int64).reshape(len(first), dim)
    books = [whole[:, a:b].copy() for a, b in _cuts(dim, parts)]
    widths = [int((b.max(axis=0) - b.min(axis=0)).max(initial=0)) // CELLS + 1 for b in books]
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((books, widths))
        use, wide = _sums(dim, parts)
        made = rows.select("embedding").mapInArrow(_assigned(shared, dim, scale, use), "part int, entry int, n long, sums array<long>")
        totals = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(wide)))
        books = [b.copy() for b in books]
        for r in totals.collect():  # parts x entries rows
            book = books[r["part"]]
            book[r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(book.shape[1])]
        shared.unpersist()
    return books, widths


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Of all components as decimal integers, by part, entry and position, with commas between them."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distances to the entries, summed over the parts), label_error (error summed over equal labels, nulls together), codebooks_sha256.

    vectors: vec_id long, label of any type that groups, embedding array<float or double>; a component x counts as floor(scale * x). Rows whose vector is null or holds a null or
    non-finite component are dropped; rows with a null vec_id stay and come last among the first entries, equal ids by their vectors. Repeated rows are rows of their own with one code.
    Fewer than `entries` rows: a smaller codebook, with repeated entries if rows repeat, of which the first is used. Vectors of different lengths have codebooks of their own; a length that is no multiple of
    `parts` gives the first parts one component more, and an empty vector has code zero and error zero. An empty table gives an empty result.
    Components over 2**20 in size after scaling are an error. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    rows = whole_vectors(vectors)
    most = F.array_max(F.transform("embedding", lambda x: F.abs(F.lit(float(scale)) * x.cast("double"))))
    lengths = sorted((r.dim, r.most) for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.max(most).alias("most")).collect())
    if any((m or 0) > MOST for _, m in lengths):
        raise ValueError("components over 2**20 after scaling")
    found = []
    for dim, _ in lengths:
        own = rows.where(F.size("embedding") == dim)
        books, widths = fit_codebooks(own, dim, parts, entries, rounds, scale)
        shared = rows.sparkSession.sparkContext.broadcast((books, widths))
        coded = own.mapInArrow(_assigned(shared, dim, scale, _codes), _coded_schema(vectors))
        found.append(coded.withColumn("codebooks_sha256", F.lit(codebooks_sha256(books))))
    if not found:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = stored(out, "codes")
    by_label = out.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error"))
    joined = out.join(small(by_label, 100_000), F.col("label").eqNullSafe(F.col("its_label")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _coded_schema(vectors: DataFrame) -> str:
    return f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _distance(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _oracle(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> str:
    """The same in SQL, for vectors whose length is a multiple of the parts."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS MATERIALIZED (SELECT n, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS x FROM v, range({parts}) AS t(p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS k, x AS c FROM x WHERE n <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT n, p, min(({_distance('x', 'c')}, k)) AS best, any_value(x) AS x FROM x JOIN b{i} USING (p) GROUP BY n, p)")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT p, k, list(m ORDER BY place) AS c FROM (SELECT p, best[2] AS k, place, CAST(floor(sum(x[place]) / count(*)) AS BIGINT) AS m FROM a{i}, range(1, 1 + len(x)) AS t(place) GROUP BY p, k, place) GROUP BY p, k),
b{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (p, k))""")
    steps.append(f"""h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds}),
f AS (SELECT n, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY n)""")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (n), h"


OP13_SQL = _oracle()
