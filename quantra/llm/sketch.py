"""Count-min sketches: each partition counts its own keys, shards of cells are merged, and the cells over a bound become bit maps.

Estimates are never under the true counts, so a filter by them loses nothing. The width follows the number of
keys up to MOST_CELLS (what is broadcast is depth * width / 8 bytes for each bound, 256 MB at most by default); beyond it
more keys pass the filter, and the results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantra.llm.texthash import U, mix

DEPTH, SHARDS, LEAST_CELLS, MOST_CELLS = 2, 64, 1 << 16, 1 << 30
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
COUNT_MOST = 65535


def width_bits(keys: float) -> int:
    """Cells: eight for each key, within LEAST_CELLS and MOST_CELLS."""
    return int(np.clip(np.ceil(np.log2(max(8 * keys, 1))), np.log2(LEAST_CELLS), np.log2(MOST_CELLS)))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys ^ U(SEEDS[row])) >> U(64 - bits)).astype(np.int64)


def merged(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, bounds: tuple[int, ...], depth: int = DEPTH) -> list[list[np.ndarray]]:
    """bitmaps[bound][row]: packed bits, set where the merged sketch counts at least that bound."""
    per = (1 << bits) // SHARDS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sketch of one partition, its empty cells left out."""
        held: list[list[np.ndarray]] = [[] for _ in range(depth)]
        sums: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * depth

        def fold() -> None:
            for r in range(depth):
                at, n = sums[r]
                got, m = np.unique(np.concatenate(held[r] or [np.zeros(0, np.int64)]), return_counts=True)
                both, where = np.unique(np.concatenate([at, got]), return_inverse=True)
                sums[r] = both, np.minimum(np.bincount(where, np.concatenate([n, m]), len(both)).astype(np.int64), COUNT_MOST)
                held[r] = []

        waiting = 0
        for batch in batches:
            for keys in keys_of(batch):
                for r in range(depth):
                    held[r].append(cells(keys, r, bits))
                waiting += len(keys)
                if waiting > 1 << 20:
                    fold()
                    waiting = 0
        fold()
        out = []
        for r, (at, n) in enumerate(sums):
            cut = np.searchsorted(at, np.arange(SHARDS + 1) * per)
            out += [(r, s, (at[a:b] - s * per).astype("<u4").tobytes(), n[a:b].astype("<u2").tobytes()) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["row", "shard", "at", "n"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(per, np.int64)
        for at, n in zip(table["at"], table["n"]):
            total[np.frombuffer(at.as_py(), "<u4")] += np.frombuffer(n.as_py(), "<u2")
        one = lambda k: pa.array([table[k][0].as_py()], pa.int32())
        return pa.table([one("row"), one("shard"), *(pa.array([np.packbits(total >= b).tobytes()]) for b in bounds)], ["row", "shard", *(f"b{b}" for b in bounds)])

    parts = docs.mapInArrow(partial, "row int, shard int, at binary, n binary")
    shards = parts.groupBy("row", "shard").applyInArrow(merge, "row int, shard int, " + ", ".join(f"b{b} binary" for b in bounds))
    maps = [[np.zeros((1 << bits) // 8, np.uint8) for _ in range(depth)] for _ in bounds]
    for got in shards.toLocalIterator():  # depth * SHARDS rows, each of a fixed size
        for i, b in enumerate(bounds):
            piece = np.frombuffer(got[f"b{b}"], np.uint8)
            maps[i][got["row"]][got["shard"] * per // 8 :][: len(piece)] = piece
    return maps


def at_least(keys: np.ndarray, bitmap: list[np.ndarray], bits: int) -> np.ndarray:
    """Which keys the sketch estimates at the bitmap's bound or over."""
    out = np.ones(len(keys), bool)
    for r, packed in enumerate(bitmap):
        c = cells(keys, r, bits)
        out &= (packed[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return out
